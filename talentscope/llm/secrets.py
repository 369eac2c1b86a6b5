"""Operator 5: secret scans with a random forest against false positives (native).

Candidates are runs of 12 or more key characters with a digit, published key
formats with or without one, dotted tokens and private-key blocks as a whole,
any value right after a key word (of several languages) and an assignment,
values of authorization headers, values with a digit that a password "is", and
user and password of an address.  No candidate has a greatest length.  A text is cut
at its candidates into gaps, so each candidate has its left and right
neighbourhood without a second search.  Features are Spark expressions: length,
character transitions, distinct characters, digit, upper-case and hexadecimal
shares, dictionary coverage (how much of it frequent corpus words cover), path
signs and neighbouring words (a key word before it, an assignment, quotes,
running prose on both sides).

A random forest learns from labelled findings (a bounded sample,
``TRAIN_FINDINGS`` of each label) and is emitted as Spark conditional
expressions over the feature struct, so scanning needs no Python, no explode
and no shuffle.  ``label_by_format`` gives labelled findings where nobody has
reviewed any: published key formats and assigned values of six or more
characters with a digit or symbol are true, plain numbers, dates, words and
paths false; what is neither stays unlabelled and is left to the forest.
Without a reviewed table, findings of every shape, made from hashed ids, are
added, so that the forest knows shapes that the corpus has not.

Rows: an empty table, NULL and empty texts have no findings; other columns are
kept as they are, whatever their names; each occurrence of a repeated
secret is a finding of its own; ties at the threshold count as secrets; a very
long text costs in proportion to its length, and its offsets to the number of
its findings squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, saved

# Words that introduce a key, and published key formats.
#: Names that announce a credential, in several languages; copulas of "the password is ..."; HTTP schemes.
NAMES = r"secret|password|passwd|passcode|passphrase|pwd|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|contrase\u00f1a|contrasena|passwort|kennwort|senha|mot de passe|parola|wachtwoord"
PASSES = r"password|passwd|passcode|passphrase|pwd|contrase\u00f1a|contrasena|passwort|kennwort|senha|mot de passe|parola|wachtwoord"
COPULAS = r"is|was|es|ist|lautet|est|\u00e9"
KEY_WORD = rf"(?i:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
SAID = rf"(?i:{PASSES})\s(?:{COPULAS})\s[\"']?"
SCHEMES = r"(?i:bearer|basic|token)\s"
HEADER = rf"(?i:authorization|{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?{SCHEMES}"
KEY_WORDS = f"(?:{KEY_WORD}|{SAID}|{HEADER})$"
BLOCK = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:\s{1,4}(?:Proc-Type|DEK-Info):[^\r\n]*+)*+"
         r"(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s{1,4}[A-Za-z0-9+/=]{16,}+)*+)")
DOTTED = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+"
KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}"
FORMATS = f"^(?:{KEYS}|{DOTTED}|{BLOCK})$"
#: A value right after a key word and an assignment: up to the closing quote, else up to white space without what ends a clause.
VALUE = r"(?<=[=:\s\"'])(?<=[=:]\s{0,2}[\"']?)(?<=" + KEY_WORD + r")(?!" + SCHEMES + r"[^\s\"'<>,;]{6})(?:(?<=[\"'])[^\"'\r\n]++(?=[\"'])|[^\s\"'<>=:][^\s\"'<>]*(?<![.,;:!?)\]}]))"
#: A value with a digit that a password "is", and the value of an authorization header; the short look behind comes first, for speed.
TOLD = rf"(?<=[\s\"'])(?<=\s(?:{COPULAS})\s[\"']?)(?<={SAID})(?=[^\s\"'<>0-9]*+[0-9])[^\s\"'<>]{{5,}}(?<![.,;:!?)\]}}])"
SENT = rf"(?<=\s)(?<={SCHEMES})(?<={HEADER})[^\s\"'<>,;]{{6,}}+"
#: User and password of an address: "user:password" between "://" and "@", unless the password is a placeholder.
LOGIN = r"(?<=://)[^\s/:@\"'<>]*+:(?!(?i:pass(?:word|wd)?|pwd|secret|x+|\*+)@)[^\s/@\"'<>]++(?=@)"
RUN = r"(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}={0,2}"
# one character behind decides which of the longer looks behind are tried: what assigns, or the last letter of a copula or a scheme
CANDIDATE = rf"{BLOCK}|(?<=[=:\s\"'])(?:{VALUE}|(?<=[sStT\u00e9]\s[\"']?){TOLD}|(?<=[rRcCnN]\s){SENT})|{LOGIN}|(?<![A-Za-z0-9_+/-])(?:{DOTTED}|(?:{KEYS})(?![A-Za-z0-9_+/-])|{RUN})"
#: Dictionary size; labelled findings of each kind that teach the forest; its shape.
DICTIONARY, TRAIN_FINDINGS, SEED_FINDINGS = 400, 4_000, 200
TREES, DEPTH, CUTS, SEED = 15, 6, 16, 20260112
THRESHOLD = 0.5
MASK = "[SECRET]"
MARK = "\x00"
FEATURES = ("n", "transitions", "variety", "digits", "uppers", "hexes", "covered", "path", "format", "keyword", "assigned", "quoted", "prose")


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent lower-case words of 3 to 9 letters, counted over all whole texts."""
    words = docs.select(F.explode(F.split("text", WORD_SPLIT)).alias("w")).where(F.col("w").rlike("^[a-z]{3,9}$"))
    top = words.groupBy("w").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "w").limit(DICTIONARY)
    return sorted((r["w"] for r in top.collect()), key=lambda w: (-len(w), w))


def _features(c: Column, before: Column, after: Column, words: list[str]) -> Column:
    n = F.length(c)
    share = lambda cls: 1 - F.length(F.regexp_replace(c, cls, "")) / n
    near = F.right(before, F.lit(40))
    login = near.endswith("://") & c.rlike("^[^/:]*:")
    named = near.rlike(KEY_WORDS) | login
    certain = c.rlike(FORMATS) | named | c.rlike(r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9+/]{40,}={0,2}$")
    flag = lambda col: F.when(col, 1.0).otherwise(0.0)
    covered = 1 - F.length(F.regexp_replace(F.lower(c), "|".join(words), "")) / n if words else F.lit(0.0)
    return F.struct(
        n.cast("double").alias("n"), (F.length(F.regexp_replace(c, "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.sqrt(n.cast("double"))).alias("variety"),
        share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[0-9a-fA-F]").alias("hexes"), covered.alias("covered"),
        flag(~certain & (c.contains("/") | near.rlike(r"(://\S*|[./\\])$") | after.rlike(r"^[./\\]\w"))).alias("path"),
        flag(c.rlike(FORMATS)).alias("format"), flag(named).alias("keyword"), flag(login | near.rlike(r"[=:]\s?[\"']?$")).alias("assigned"),
        flag(near.rlike(r"[\"']$") & after.rlike(r"^[\"']")).alias("quoted"),
        flag(near.rlike(r"\p{L}[.,]?\s$") & after.rlike(r"^\s\p{L}")).alias("prose"), c.alias("c"))


def candidates(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """``_row`` (all columns of ``docs``), ``_gaps`` (k + 1 strings) and ``_found`` (k structs of features and the candidate ``c``)."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_t"))
    # one search: candidates are set between marks, and every second piece is one; a text that holds the mark is searched twice
    piece = F.when(~F.contains("_t", F.lit(MARK)), F.split(F.regexp_replace("_t", f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK, -1))
    df = df.select("_row", "_t", piece.alias("_piece"))
    marked = F.contains("_t", F.lit(MARK))
    df = df.select("_row", F.when(marked, F.split("_t", CANDIDATE, -1)).otherwise(F.filter("_piece", lambda _, i: i % 2 == 0)).alias("_gaps"),
                   F.when(marked, F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))).otherwise(F.filter("_piece", lambda _, i: i % 2 == 1)).alias("_cut"))
    k = F.size("_cut")
    # what stands before: the gap, and the candidate before it where the gap is short (a long name of an assignment)
    before = F.zip_with(F.slice("_gaps", F.lit(1), k), F.concat(F.array(F.lit("")), F.slice("_cut", F.lit(1), F.greatest(k - 1, F.lit(0)))), lambda g, p: F.concat(F.right(p, F.lit(40)), g))
    near = F.arrays_zip(F.col("_cut").alias("c"), before.alias("b"), F.slice("_gaps", F.lit(2), k).alias("a"))
    found = F.transform(near, lambda x: _features(x["c"], x["b"], x["a"], words))
    return df.withColumn("_found", F.when(k > 0, found)).drop("_cut")


def label_by_format(found: DataFrame) -> DataFrame:
    """(features, c) -> with ``label``: 1 for published formats and assigned keys, 0 for what can't be one, else NULL."""
    c = F.col("c")
    assigned = F.col("keyword") == 1
    empty = r"(?i)^(?:none|null|nil|true|false|undefined|your\S*|x+|\*+|[$%<{\[(].*|[a-z_.]+\(.*)$"  # placeholders and code
    word = assigned & (c.rlike(empty) | (c.rlike(r"^\p{L}{1,12}$") & ((F.col("quoted") == 0) | (F.col("covered") > 0.7))))
    true = c.rlike(FORMATS) | (assigned & ~word & (F.length(c) >= 6) & c.rlike(r"[0-9]|[^\p{L}\s]"))
    false = c.rlike(r"^[0-9+/_-]+$|^[A-Za-z]+[-_/]?[0-9]{1,4}$|^[A-Za-z]*([-_/][A-Za-z]*)*[0-9]{0,4}$") | (F.col("path") == 1) | (F.col("covered") > 0.7) | word
    false = F.when(assigned, word).otherwise(false)
    return found.withColumn("label", F.when(true, 1).when(false, 0))


def _seeds(docs: DataFrame) -> DataFrame:
    """Texts with findings made from hashed ids: published formats and assigned values of several shapes and neighbours, and words, paths and numbers that are none."""
    few = docs.where("doc_id is not null").select("doc_id").distinct().orderBy("doc_id").limit(SEED_FINDINGS)
    h = F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256)
    b64 = F.translate(F.regexp_replace(F.base64(F.unhex(h)), r"\s|=", ""), "+/", "Qz")
    key, letters = F.translate(F.upper(F.substring(b64, 1, 16)), "01", "DE"), F.translate(F.substring(h, 1, 24), "0123456789", "ghijklmnop")
    part = lambda a, n: F.substring(letters, a, n)
    digits = F.substring(F.translate(h, "abcdef", "123456"), 20, 4)
    shapes = (["the AKIA", key, " and"], ["(AKIA", F.translate(key, "23456789", "FGHIJKLM"), ")"], ["with password=", F.substring(h, 1, 18), " for"],
              ["a token = \"", F.substring(h, 1, 40), "\" of"], ["{'api_key': '", b64, "'}"], ["password=", part(1, 7), "-", part(8, 5), "-", part(13, 7)],
              ["login, pwd: ", F.initcap(part(1, 4)), "@", F.substring(h, 1, 4), "!"], ["PASSWD=", part(5, 3), F.translate(part(9, 3), "abcdefghijklmnop", "1234567890123456"), part(2, 3), "\n"],
              ["secret = '", part(3, 6), "/", F.substring(b64, 3, 9), "+x'"], ["Bearer eyJ", F.substring(b64, 1, 17), ".eyJ", F.substring(b64, 5, 30), ".", b64],
              ["see ghp_", F.substring(b64, 1, 36), ", "], ["\n-----BEGIN RSA PRIVATE KEY-----\n", F.base64(F.unhex(h)), "\n-----END RSA PRIVATE KEY-----\n"],
              ["my password is ", part(2, 6), digits, "! and"], ["to postgres://", part(1, 5), ":", part(7, 4), digits, "@db.", part(4, 5), "/"],
              ["Authorization: Bearer ", letters, "\n"], ["contrase\u00f1a: ", F.initcap(part(6, 4)), digits, "!", part(2, 3), " y"],
              ["the token: ", part(1, 5), " of"], ["password = ", part(6, 8), ", and"],
              ["see src/main/", part(1, 6), "/App", digits, ".java and"], ["at https://www.", part(1, 8), ".com/", part(3, 7), "/", digits, "/", part(9, 5), " of"],
              ["/usr/lib/", part(4, 7), "-", digits, "/", part(2, 6), "\n"], ["on ", digits, "-01-02-", digits, " the"], ["a ", part(1, 9), "-", digits, " of"])
    return few.select(F.explode(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape]) for shape in shapes])).alias("text"))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> str | float:
    """Grow one tree on quantile cuts by Gini impurity; a leaf is the share of true findings, a node is SQL."""
    p = float(y.mean())
    if depth == 0 or len(y) < 4 or p in (0.0, 1.0):
        return round(p, 6)
    best = (1e-9, None)
    for f in rng.choice(x.shape[1], 5, replace=False):
        for v in np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[:-1])):
            low = x[:, f] <= v
            a, b = y[low], y[~low]
            if len(a) and len(b):
                gain = p * (1 - p) - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(y)
                if gain > best[0]:
                    best = (gain, (int(f), float(v), low))
    if best[1] is None:
        return round(p, 6)
    f, v, low = best[1]
    return f"IF(x.{FEATURES[f]} <= {v!r}D, {_tree(x[low], y[low], rng, depth - 1)}, {_tree(x[~low], y[~low], rng, depth - 1)})"


def grow(rows: list[tuple]) -> str:
    """A forest as SQL over the feature struct ``x``, from (features..., label) rows."""
    if not rows:
        return "0.0D"
    data = np.array(sorted(rows), float)
    x, y, rng = data[:, :-1], data[:, -1], np.random.default_rng(SEED)
    trees = []
    for _ in range(TREES):
        some = np.concatenate([rng.choice(k, len(k)) for k in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(k)])  # bootstrap of each label
        trees.append(_tree(x[some], y[some], rng, DEPTH))
    return f"({' + '.join(map(str, trees))}) / {float(TREES)!r}D"


def fit(docs: DataFrame, words: list[str], labelled: DataFrame | None = None) -> str:
    """The forest.  ``labelled``: the feature columns and ``label`` of reviewed findings; else labels by format."""
    rows = []
    if labelled is None:
        # outer: the planner would filter on a plain explode's input below the projection, and search each text again for that
        label = lambda d: label_by_format(candidates(d, words).select(F.explode_outer("_found").alias("x")).select("x.*")).where("label is not null")
        rows += [tuple(r) for r in label(_seeds(docs)).select(*FEATURES, "label").collect()]  # SEED_FINDINGS of each shape
        labelled = saved(label(docs.select("text")), "secret_labels")
    for y in (0, 1):
        part = labelled.where(F.col("label") == y).orderBy(F.xxhash64("c"), "c", *FEATURES).limit(TRAIN_FINDINGS)
        rows += [tuple(r) for r in part.select(*FEATURES, "label").collect()]
    return grow(rows)


def scan(docs: DataFrame, words: list[str], forest: str) -> DataFrame:
    """``_row`` (all columns of ``docs``), ``_gaps`` and ``_found``: candidates as structs with ``p``, the probability of a secret."""
    scored = f"transform(_found, x -> named_struct('c', x.c, 'p', {forest}, 'keyword', x.keyword))"
    return candidates(docs, words).withColumn("_found", F.expr(scored))


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per secret: doc_id, start and length in characters, kind, probability, sha256 of the secret."""
    words = dictionary(docs)
    found = scan(docs.select("doc_id", "text"), words, fit(docs, words, labelled))
    # the row number keeps this filter above the projection, or the forest would be evaluated again within it
    found = found.withColumn("row", F.monotonically_increasing_id()).where("_found IS NOT NULL AND row >= 0")
    found = found.select(F.col("_row.doc_id").cast("long").alias("doc_id"), "_gaps", "_found", F.posexplode("_found").alias("at", "x")).where(F.col("x.p") >= THRESHOLD)
    start = F.expr("aggregate(slice(_gaps, 1, at + 1), 0L, (s, g) -> s + length(g)) + aggregate(slice(_found, 1, at), 0L, (s, f) -> s + length(f.c))")
    kind = F.when(F.col("x.c").rlike(FORMATS), "key_format").when(F.col("x.keyword") == 1, "assigned").otherwise("other")
    return found.select("doc_id", start.alias("start"), F.length("x.c").cast("long").alias("length"), kind.alias("kind"),
                        F.col("x.p").alias("probability"), F.sha2("x.c", 256).alias("secret_sha256"))


def masked(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK``; rows and columns stay."""
    words = dictionary(docs)
    out = scan(docs, words, fit(docs, words, labelled))
    parts = F.expr(f"array_join(flatten(zip_with(_gaps, _found, (g, f) -> array(g, IF(f IS NULL, '', IF(f.p >= {THRESHOLD}D, '{MASK}', f.c))))), '')")
    text = F.when(F.expr(f"exists(_found, f -> f.p >= {THRESHOLD}D)"), parts).otherwise(F.col("_row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
