"""Operator 4: quality rules as learned decision lists (native).

Statistics of each document are Spark expressions.  Labelled statistics (a
bounded sample) teach an ordered list of rules "reject if a and b ...": by
sequential covering, each rule grows threshold conditions that gain most
information on a growing part of the rows, loses the last conditions while that
helps on a pruning part, and stays if it is right there more often than not;
the rows it covers go and the next rule follows.  The list is emitted as one
ordered conditional expression, so scoring is whole-stage Spark without Python.

Statistics (``statistics``): words are maximal runs without ASCII white space.
``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (of
``#*$%&|<>``); ``n_dup_lines`` (lines with a word that equal an earlier line);
``n_repeat_words`` (words in 3-word windows found twice or more, the first
included).  Repeated windows are found by sorting the window hashes with their
positions, so a text of n words costs n log n.

Rows: a NULL or blank text has no words and fails the base rule; without labels
of both kinds the list is empty and the base rule decides alone; ties between
conditions go to the first statistic and the smaller threshold; repeated rows
get the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, checked_broadcast, saved

#: Labelled rows that teach the list: those with the smallest hashed ids.
TRAIN_ROWS = 8_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 24
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_row``, a struct of the columns ``keep`` of ``docs`` (all of them), and ``_s``, a struct of the statistics.

    Characters are counted as what is left without runs of the others, and no
    step carries the text beyond the first, so a row makes little garbage.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda cls: F.length(F.regexp_replace(t, f"[^{cls}]+", ""))
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("_row"),
        F.filter(F.split(t, WORD_SPLIT), lambda w: w != "").alias("_s_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_s_lines"),
        (F.length(t) - count(r"\x20\x09-\x0D")).alias("_s_chars"), count(r"#*$%&|<>").alias("_s_symbols"),
        count(r"\p{Lu}").alias("_s_upper"), count(r"!?").alias("_s_marks"), count(r"0-9").alias("_s_digits"))
    df = df.withColumn("_s_n", F.size("_s_w")).withColumn("_s_h", F.transform("_s_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_s_n_lines", F.size("_s_lines")).withColumn("_s_dup", F.size("_s_lines") - F.size(F.array_distinct("_s_lines"))).drop("_s_w", "_s_lines")
    df = df.withColumn("_s_win", F.expr("transform(slice(_s_h, 1, greatest(_s_n - 2, 0)), (x, i) -> xxhash64(x, _s_h[i + 1], _s_h[i + 2]))"))
    df = df.withColumn("_s_distinct", F.size(F.array_distinct("_s_h"))).drop("_s_h")
    repeated = F.size(F.array_distinct("_s_win")) < F.size("_s_win")
    df = df.withColumn("_s_sorted", F.when(repeated, F.sort_array(F.transform("_s_win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_s_win")
    hits = F.zip_with("_s_sorted", F.slice("_s_sorted", F.lit(2), F.greatest(F.size("_s_sorted"), F.lit(1))),
                      lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    df = df.withColumn("_s_at", F.sort_array(F.array_distinct(F.flatten(F.filter(hits, lambda p: p.isNotNull()))))).drop("_s_sorted")
    steps = F.zip_with("_s_at", F.slice("_s_at", F.lit(2), F.greatest(F.size("_s_at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    df = df.withColumn("_s_rep", F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)))
    names = {"n_words": "_s_n", "word_chars": "_s_chars", "n_symbols": "_s_symbols", "n_dup_lines": "_s_dup", "n_repeat_words": "_s_rep", "n_lines": "_s_n_lines",
             "n_distinct": "_s_distinct", "n_upper": "_s_upper", "n_marks": "_s_marks", "n_digits": "_s_digits"}
    return df.select("_row", F.struct(*[F.col(c).cast("long").alias(n) for n, c in names.items()]).alias("_s"))


def _ratios() -> dict[str, str]:
    """What conditions may test, as SQL over the struct of statistics."""
    per = lambda a, b: f"_s.{a} / greatest(_s.{b}, 1)"
    return {"symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"),
            "distinct_share": per("n_distinct", "n_words"), "upper_share": per("n_upper", "word_chars"),
            "marks_per_word": per("n_marks", "n_words"), "digit_share": per("n_digits", "word_chars")}


@dataclass(frozen=True)
class Rule:
    """Reject if every condition (statistic, sign, threshold) holds."""
    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Which rows of a matrix of statistics (columns as in ``_ratios``) the rule covers."""
        names, out = list(_ratios()), np.ones(len(x), bool)
        for f, sign, v in self.conditions:
            col = x[:, names.index(f)]
            out &= col >= v if sign == ">=" else col <= v
        return out

    def sql(self) -> str:
        return " AND ".join(f"({_ratios()[f]} {sign} {v!r}D)" for f, sign, v in self.conditions)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's information gain of a condition that leaves (p1, n1) of (p0, n0)."""
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def _grow(x: np.ndarray, y: np.ndarray) -> list[tuple[str, str, float]]:
    """Add the condition of the highest gain until no row to keep is covered or nothing gains."""
    names, rule = list(_ratios()), []
    steps = np.linspace(0, 1, CUTS + 1)  # cuts at quantiles of the rows to reject and of those to keep
    cuts = [np.unique(np.concatenate([np.quantile(x[y == k, f], steps, method="lower") for k in (0, 1) if (y == k).any()])) for f in range(len(names))]
    while len(rule) < MAX_CONDITIONS and 0 < (p0 := int(y.sum())) < len(y):
        best = (1e-9, None)
        for f, name in enumerate(names):
            every, bad = np.sort(x[:, f]), np.sort(x[y == 1, f])
            for v in cuts[f]:
                k, p = len(y) - int(np.searchsorted(every, v)), p0 - int(np.searchsorted(bad, v))
                lk, lp = int(np.searchsorted(every, v, "right")), int(np.searchsorted(bad, v, "right"))
                for sign, total, hit in ((">=", k, p), ("<=", lk, lp)):
                    g = _gain(p0, len(y) - p0, hit, total - hit)
                    if g > best[0] + 1e-9:
                        best = (g, (name, sign, float(v)))
        if best[1] is None:
            break
        rule.append(best[1])
        covered = Rule((best[1],)).holds(x)
        x, y = x[covered], y[covered]
    return rule


def _prune(rule: list, x: np.ndarray, y: np.ndarray) -> tuple[list, float]:
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning rows."""
    worth = []
    for k in range(1, len(rule) + 1):
        hit = y[Rule(tuple(rule[:k])).holds(x)]
        worth.append((2 * float(hit.mean()) - 1 if len(hit) else -1.0, k))
    best = max(worth, key=lambda w: (w[0], -w[1]), default=(-1.0, 0))
    return rule[:best[1]], best[0]


def learn(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Sequential covering over rows of statistics and 1 if to reject; every third row prunes."""
    part = np.arange(len(y)) % 3 == 0
    (gx, gy), (px, py) = (x[~part], y[~part]), (x[part], y[part])
    out: list[Rule] = []
    while len(out) < MAX_RULES and gy.any():
        conditions, worth = _prune(_grow(gx, gy), px, py)
        if not conditions or worth <= 0:
            break
        out.append(Rule(tuple(conditions)))
        left, rest = ~out[-1].holds(gx), ~out[-1].holds(px)
        gx, gy, px, py = gx[left], gy[left], px[rest], py[rest]
    return out


def fit(docs: DataFrame, labelled: DataFrame) -> list[Rule]:
    """Rules from (doc_id, quality) labels: 0 is to be rejected."""
    sample = (labelled.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))
    sample = saved(sample.select("doc_id", F.col("quality").alias("_s_q")), "quality_ids")
    seen = statistics(docs.select("doc_id", "text").join(checked_broadcast(sample, 32), "doc_id"), keep=["doc_id", "_s_q"])
    seen = saved(seen.select("_row.doc_id", "_row._s_q", "_s"), "quality_stats").where(~F.expr(BASE_FAILED))
    rows = seen.select("_s_q", "doc_id", *[F.expr(sql).alias(f) for f, sql in _ratios().items()]).orderBy(F.xxhash64("doc_id"), "doc_id", *_ratios()).limit(2 * TRAIN_ROWS)
    rows = rows.collect()
    return learn(np.array([[r[f] for f in _ratios()] for r in rows], float).reshape(-1, len(_ratios())), np.array([int(r["_s_q"] == 0) for r in rows], int))


BASE_FAILED = f"(_s.n_words < {MIN_WORDS} OR 100 * _s.n_repeat_words > {MAX_REPEAT_PERCENT} * _s.n_words)"


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional: the number of the first rule that rejects, 0 if none does."""
    out = "CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END" if rules else "0"
    return F.expr(out)


def judged(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``_row`` (the columns ``keep`` of ``docs``, else all), ``_s``, ``failed`` (base rule), ``rule`` (rejecting rule, 0 if none) and ``kept``."""
    rules = fit(docs, labelled)
    out = statistics(docs, keep=keep).withColumn("failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the number of the rejecting rule, per row."""
    base = [F.col(f"_s.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(docs, labelled, ["doc_id"]).select(F.col("_row.doc_id").cast("long").alias("doc_id"), *base, F.col("failed").alias("base_failed"), "kept", "rule")


def good(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.

    The row number keeps the filter above the projection: pushed below it, the
    verdict would be spelled out from the text with every statistic repeated.
    """
    return judged(docs, labelled).withColumn("at", F.monotonically_increasing_id()).where("kept AND at >= 0").select("_row.*")
