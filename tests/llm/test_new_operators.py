"""Spelling variants, target resampling and chat formatting against plain versions, odd rows and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD, SF
from pyspark.sql import functions as F

from talentscope.llm import chat, queries, spelling, target_resampling

TURNS = "conv_id long, turn long, role string, text string"


def fold_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ------------------------------------------------------------------ spelling variants

def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold_az(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def plain_near(words):
    """word -> near words, by deletions and single gaps."""
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i] + "\0" + w[i + 1:]].add(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in gaps.values():
        for w in some:
            near[w] |= some - {w}
    return near


def plain_variants(n):
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_variants_of_documents(spark, docs):
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert rows_of(queries.op11_spelling_variants(spark, SF)) == want and len(want) > 500


def test_spelling_hot_states(spark):
    """Thousands of words with one prefix or one suffix: states of 16 words at most are halved down to single positions."""
    rng = np.random.default_rng(11)
    tail = lambda k: "".join(rng.choice(list("abcd"), k))
    words = {"prefix" + tail(5) for _ in range(600)} | {tail(5) + "suffix" for _ in range(600)} | {"pre" + tail(3) + "fix" for _ in range(60)} | {"a" * k for k in range(6, 12)}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    near = plain_near(words)
    got = [(r.word, r.near) for r in spelling.near_pairs(df, group_rows=16).collect()]
    assert len(got) == len(set(got)) and set(got) == {(w, x) for w in words for x in near[w]}
    full = spelling.states(df, group_rows=16).groupBy("m", "lo", "hi", "before", "behind").count()
    assert full.where("lo < hi").agg(F.max("count")).first()[0] <= 16


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abé", min_size=6, max_size=8), max_size=40))
def test_composition_finds_each_near_pair_once(words):
    got = []
    states = defaultdict(list)
    for w in words:
        for m in (len(w), len(w) - 1):
            half = m // 2
            for lo, hi in ((0, half - 1), (half, m)):
                if m >= 6:
                    tail = max(m - 1 - hi, 0)
                    states[m, lo, hi, w[:lo], w[len(w) - tail:]].append(w)
    for (m, lo, hi, _, _), some in states.items():
        got += [frozenset(p) for p in spelling.near_words(m, lo, hi, some)]
    near = plain_near(words)
    assert len(got) == len(set(got)) and set(got) == {frozenset((w, x)) for w in words for x in near[w]}


def test_spelling_forms_follow_to_the_last(spark):
    """A chain of four forms, a tie of counts, a form too rare."""
    n = {"abcdefgh": 5, "abcdefgx": 25, "abcdefyx": 125, "abcdezyx": 625, "abcdwzyx": 3125, "abcdwzyq": 15624, "tietie": 5, "tietia": 30, "tietib": 30}
    text = " ".join(w for w, k in n.items() for _ in range(k))
    doc = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 199 for w in n))
    got = rows_of(spelling.variants(spark.createDataFrame([(doc, text)], "doc_id long, text string")))
    assert got == plain_variants(n)
    root = {r[0]: r[2] for r in got}
    assert root["abcdefgh"] == "abcdwzyx" and root["tietie"] == "tietia"


def test_spelling_run_loses_one_code_point_only(spark):
    """A run that loses a code point and so becomes another run of its text that loses one too."""
    def shorter(run):
        h = zlib.crc32(f"7:{run}".encode())
        return run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else None
    runs = ("".join(r) for r in itertools.product("abcd", repeat=9))
    first = next(r for r in runs if shorter(r) and shorter(shorter(r)))
    second = shorter(first)
    for some in ([first] * 6 + [second] * 30, [second] * 30 + [first] * 6):
        got = {r[0]: r[3] for r in rows_of(spelling.variants(spark.createDataFrame([(7, " ".join(some))], "doc_id long, text string")))}
        assert got == {second: 6, shorter(second): 30} == plain_words([(7, " ".join(some))])


def test_spelling_odd_rows(spark, odd, empty):
    assert rows_of(spelling.variants(odd)) == plain_variants(plain_words([(r[0], r[1]) for r in ODD]))
    assert spelling.variants(empty).collect() == []
    long = "x" * 50_000
    df = spark.createDataFrame([(i, f"{long}a {long} {'y' + long} é" + "É" * 7) for i in range(5)] + [(None, None)], "doc_id long, text string")
    assert rows_of(spelling.variants(df)) == plain_variants(plain_words([(r.doc_id, r.text) for r in df.collect()]))


# ------------------------------------------------------------------ target resampling

def plain_draw(docs, target):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold_az(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    grams_of = [(i, *grams(t)) for i, t in docs]
    raw, wanted = Counter(x for *_, g in grams_of for x in g), Counter(x for t in target for x in grams(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s + 10000.0) / ((raw[b] + 1.0) * (t + 10000.0)))) for b in range(10000)]
    out = []
    for i, words, g in grams_of:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in g)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_target_resampling_of_documents(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_draw([(r.doc_id, r.text) for r in docs.collect()], target)
    got = queries.op12_target_resampling(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"] and sum(r[4] is not None for r in want) > 5


def test_target_resampling_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("alpha beta gamma",), (None,)], "text string")
    assert sorted((tuple(r) for r in target_resampling.resample(odd, target).collect()), key=str) == plain_draw([(r[0], r[1]) for r in ODD], ["alpha beta gamma", None])
    assert target_resampling.resample(empty, target).collect() == []
    none = spark.createDataFrame([], "text string")
    assert len(target_resampling.resample(odd, none).collect()) == len(ODD)
    repeated = spark.createDataFrame([(7, "w " * 30)] * 50 + [(None, "w " * 30)] * 50, "doc_id long, text string")
    got = [(r["rank"], r.doc_id) for r in target_resampling.resample(repeated, target).collect() if r["rank"]]
    assert sorted(k for k, _ in got) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("bits,block_rows", [(1, 3), (3, 7), (12, 1 << 20)])
def test_radix_ranks(spark, bits, block_rows):
    """Two keys with many ties; a third of the rows share one key."""
    rng = np.random.default_rng(12)
    rows = [(int(a) if i % 3 else 5, int(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(0, 9, 300)))]
    df = target_resampling.saved(spark.createDataFrame(rows, "a long, b long").repartition(3).withColumn("slot", F.monotonically_increasing_id()), "radix_test")
    got = [(r["rank"], r.a, r.b) for r in target_resampling.radix_ranks(df, [("a", 40), ("b", 8)], bits, block_rows).collect()]
    assert [(a, b) for _, a, b in sorted(got)] == sorted(rows) and sorted(k for k, _, _ in got) == list(range(1, 301))
    same = target_resampling.radix_ranks(df, [("a", 0)], bits, block_rows).collect()
    assert sorted(r["rank"] for r in same) == list(range(1, 301))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB9é中 .\n"), max_size=60), st.integers(250, 300).map(lambda k: f"p {'q' * k} r {'s' * k}")), min_size=1, max_size=5))
def test_features_are_checksums_of_strings(texts):
    got, n = target_resampling.Features().of([None if t is None else t.encode() for t in texts])
    at = [0, 0, 0]
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold_az(t or ""))
        for k in range(3):
            want = [zlib.crc32(" ".join(w[i:i + k + 1]).encode()) % 10000 for i in range(len(w) - k)]
            assert got[k][at[k]:at[k] + n[k][d]].tolist() == want
            at[k] += n[k][d]


# ------------------------------------------------------------------ chat formatting

ODD_TURNS = [
    (-5, 2, "user", "a\\[INST]<\\\\s><s></s>\n"), (-5, 1, "user", ""), (-5, 1, None, None), (-5, None, "assistant", "</s>\n<s>user[INST]x[/INST]"),
    (-5, 9, "assistant", "q"), (-5, 9, "assistant", "q"), (-5, 10, "a<s>b", "[INST"), (-6, 0, "assistant", "中文😀<s>" * 100_000), (-7, 3, "system", "[/INST]"),
]


def plain_chat(rows):
    by = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        by[c if c is not None else f"row {k}"].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((None if isinstance(c, str) else c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chat_formatting_odd_rows(spark):
    rows = ODD_TURNS + [(None, 1, "user", "x")] * 2
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("x")).withColumn("turns", F.lit(1))
    out = chat.format_conversations(df)
    assert sorted((tuple(r)[:5] for r in chat.digests(out).collect()), key=str) == plain_chat(rows)
    for r in out.collect():
        assert r.formatted == "".join(s.content for s in r.segments)
        assert re.findall(r"</?s>|\[/?INST\]", r.formatted) == [m for b in r.formatted.split("</s>\n")[:-1] for m in ["<s>"] + ["[INST]", "[/INST]"] * b.count("[INST]") + ["</s>"]]
    merged = {r.conv_id: r.formatted for r in out.collect()}
    assert merged[-7] == "<s>system[INST][\\/INST][/INST]</s>\n" and merged[-5].endswith("<s>assistant[INST]q[/INST][INST]q[/INST]</s>\n<s>a<\\s>b[INST][INST[/INST]</s>\n")
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).collect() == []


def test_chat_formatting_uses_no_python(spark):
    plan = queries.op13_chat_formatting(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("<s>/[INT]\\ab\n"), max_size=12), min_size=1, max_size=20))
def test_escapes_reverse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e)
    assert list(itertools.chain.from_iterable(df.collect())) == texts
