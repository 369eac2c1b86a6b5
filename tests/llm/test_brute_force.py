"""Operators against plain versions over the whole small tables, exact round trips and held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from llm_cases import SF, fold
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from talentscope.llm import bpe, jaccard_join, language_id, packing, queries, quality_rules, resampling, secrets, token_counts, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TOK = bpe.tokenizer_from_ranks(RANKS, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def grams(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain_components(rows):
    """doc_id -> smallest reachable id, over all pairs."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components(spark, docs):
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_chain_and_hot_group(spark):
    """A chain of near copies, many copies of one text, and a passage that many other texts share."""
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(10 ** 9))
    base, passage = [word() for _ in range(100)], [word() for _ in range(30)]
    rows, t = [], list(base)
    for i in range(12):  # each step changes the next 4 words: neighbours link, the ends don't
        rows.append((i, " ".join(t)))
        t[8 * i:8 * i + 4] = [word() for _ in range(4)]
    rows += [(100 + i, " ".join(base[:50])) for i in range(200)]
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(30)])) for i in range(150)]
    near = [word() for _ in range(120)]
    for i in range(80):
        v = list(near)
        v[int(rng.integers(120))] = word()
        rows.append((2000 + i, " ".join(v)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_round_trip(spark, docs):
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, SF).collect()}
    for r in docs.collect():
        ids = np.array(REF.encode_ordinary(r.text or ""), "<u4").tobytes()
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'sta1.,é中😀 \u0085\u001c"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_encoder_equals_rank_library(texts):
    enc, dec = bpe.Encoder(TOK, offsets=True), bpe.Decoder(RANKS)
    for t, (ids, spans) in zip(texts, enc.batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == REF.encode_ordinary(t)
        assert dec.decode(ids) == t.encode() and dec.decode_text(ids) == t
        assert spans.tolist() == [list(o) for o in TOK.encode(t, add_special_tokens=False).offsets]


def test_encode_and_decode_frames(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encode(docs, path, P.PATTERN)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.decode(enc, path, P.PATTERN).collect():
        assert bytes(r.content).decode() == text[r.doc_id]
    r = enc.where("size(starts) > 0").first()
    assert len(r.starts) == len(r.ends) == len(r.ids) // 4 and r.starts[0] == 0 and r.ends[-1] == len(text[r.doc_id])


def plain_packing(pieces, text):
    tok = bpe.tokenizer_from_file(P.path("byte_bpe_50k.json"))
    by_seq, by_doc = {}, {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two: no padding
    assert set(by_doc) == set(text)
    for i, t in text.items():
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing(spark, docs):
    plain_packing(queries.op3_packing(spark, SF).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_hilbert_curve_is_continuous():
    """Each step along the curve moves one cell along one axis, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert_index(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_quality_statistics(spark, docs):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, SF).collect()}
    for d in docs.collect():
        t = d.text or ""
        w = WORD.findall(t)
        three, cover = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if three[w[i], w[i + 1], w[i + 2]] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        g = got[d.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and g.kept == (not g.base_failed and g.rule == 0)


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(quality_rules._ratios())))
    y = ((x[:, 0] > 0.6) & (x[:, 2] < 0.4)).astype(int)
    rules = quality_rules.learn(x, y)
    pred = np.zeros(len(x), bool)
    for r in rules:
        pred |= r.holds(x)
    assert (pred == y).mean() > 0.95


def test_list_as_sql_equals_list(spark, docs, labels):
    rules = quality_rules.fit(docs, labels) or [quality_rules.Rule((("word_length", ">=", 5.0), ("symbols_per_word", "<=", 0.01)))]
    from pyspark.sql import functions as F

    rows = quality_rules.statistics(docs).select(quality_rules.verdict(rules).alias("v"), *[F.expr(s).alias(f) for f, s in quality_rules._ratios().items()]).collect()
    x = np.array([[r[f] for f in quality_rules._ratios()] for r in rows], float)
    first = np.zeros(len(x), int)
    for k, rule in reversed(list(enumerate(rules, 1))):
        first[rule.holds(x)] = k
    assert first.tolist() == [r.v for r in rows]


def test_secrets_found_and_masked(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    text = {r.doc_id: r.text for r in d.collect()}
    got = sorted((r.doc_id, text[r.doc_id][r.start:r.start + r.length]) for r in secrets.findings(d).collect())
    assert got == sorted((i, s) for i, t in text.items() for s in known.findall(t))
    masked = {r.doc_id: r.text for r in secrets.masked(d).collect()}
    assert masked == {i: known.sub(secrets.MASK, t) for i, t in text.items()}


def test_forest_keeps_what_labels_say(spark):
    """Reviewed labels override formats: a forest trained on them follows them."""
    words = ["the", "and"]
    d = spark.createDataFrame([(i, f"value id-{i:012d} the {hashlib.md5(str(i).encode()).hexdigest()} and") for i in range(60)], "doc_id long, text string")
    from pyspark.sql import functions as F

    found = secrets.candidates(d, words).select(F.explode("_found").alias("x")).select("x.*").withColumn("label", F.col("c").startswith("id-").cast("int"))
    out = secrets.findings(d, labelled=found).collect()
    assert {r.length for r in out} == {15} and len(out) == 60


def test_top_k(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in v]), np.floor(1024 * np.array([r.embedding for r in v], float)).astype(np.int64)
    got = {}
    for r in queries.op10_topk_search(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in np.flatnonzero(ids % 100 == 0):
        s = x @ x[q]
        order = [k for k in np.lexsort((ids, -s)) if k != q][:10]
        assert sorted(got[int(ids[q])]) == [(n + 1, int(ids[k]), int(s[k])) for n, k in enumerate(order)]
    assert len(got) == (ids % 100 == 0).sum()


def test_ball_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    rows = rng.integers(-1000, 1000, (3000, 4))
    rows[100:900] = rows[100]  # equal vectors
    ids = rng.permutation(3000)
    tree = topk_search.build_tree(ids, rows)
    tree["dot"] = lambda a, b, q: tree["rows"][a:b].astype(np.int64) @ q
    for q in rows[rng.integers(0, 3000, 20)]:
        s = rows @ q
        want = [(int(s[k]), int(ids[k])) for k in np.lexsort((ids, -s))][:10]
        assert topk_search.search(tree, q, -1, 10, -np.inf) == want
        assert topk_search.search(tree, q, -1, 10, want[-1][0]) == want


def test_kneser_ney_is_a_distribution():
    g = np.concatenate([language_id.grams(t) for t in ("the cat sat on the mat", "a cat and a hat", "that is that")])
    keys, hits = np.unique(g, return_counts=True)
    letters = np.unique(keys & np.uint64(0xFFFF))
    m = language_id.KneserNey(keys, hits.astype(float), len(letters))
    for ctx in np.unique(keys >> np.uint64(16))[:10]:
        assert abs(m.probability(4, (ctx << np.uint64(16)) | letters).sum() - 1) < 1e-9


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.collect()}
    got = language_id.language_id(d).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    from pyspark.sql import functions as F

    lab = spark.read.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet").join(lab.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in lab.where(F.col("toxic").isNotNull()).collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert np.mean([p for p, y in held if y == 1]) > 0.9


def plain_matches(text, words):
    """Matched insults by a plain reading of each clause: word lists and positions instead of automata."""
    found, is_quoted = {}, False
    for line in text.lower().split("\n"):
        is_quoted = False
        clause = []
        for tok in [*re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.,;:!?\"]", line), "."]:
            if tok == '"':
                is_quoted = not is_quoted
            elif tok in ".,;:!?" or tok in toxicity.BUT.split():
                ws = [w for w, _ in clause]
                aimed = any(w in " ".join((toxicity.TARGETS, toxicity.SUBJECTS, toxicity.OBJECTS, toxicity.CLITICS)).split() for w in ws)
                for i, (w, q) in enumerate(clause):
                    near = lambda names, k: any(v in names.split() for v in ws[max(i - k, 0):i])  # noqa: B023, E731
                    if w in words and not q and not near(toxicity.NEGATIONS, toxicity.DENIES) and not near(toxicity.REPORTS, toxicity.REPORTS_ON):
                        found[w] = found.get(w, False) or aimed
                clause = []
            else:
                clause.append((tok, is_quoted))
    return found


@given(st.lists(st.sampled_from(["moron", "trash", "you", "te", "he", "not", "nobody", "said", "word", "but", "the", "plain", ",", ".", "\n", '"']), max_size=40))
@settings(max_examples=300, deadline=None)
def test_composed_grammar_reads_clauses_as_a_plain_reader(tokens):
    lex = toxicity.Lexicon({"moron$": (0.3, 1e-6), "trash$": (0.1, 1e-5)})
    text = " ".join(tokens)
    got, n = toxicity.matches(text, lex)
    assert got == plain_matches(text, {"moron", "trash"}) and n == sum(t.isalpha() for t in tokens)


def test_grammar_scores_clauses_not_words():
    terms = {"moron$": (0.3, 1e-6), "trash$": (0.3, 1e-6), "lowei*": (0.1, 1e-5)}
    lex, model = toxicity.Lexicon(terms), toxicity.ToxicityModel(terms, (1.0, 0.5, -5.0))
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.clause_features(t, lex).tolist()))
    s = lambda t: model.score(t, lex)
    none = s("a plain text, you see")
    assert f("you moron, go")["aimed"] > 0 == f("the moron. you go")["aimed"] and s("you moron") > s("the moron") > none
    for text in ("not a moron", "they said moron", "he wrote \"moron\" there", "he said that nobody is a trash", "kill the process", "the kill. you go",
                 "the word trash is listed in the dictionary of old words", 'nobody here is not a trash, and the report quoted "trash"',
                 "I will not kill you", "", None):
        assert s(text) == none, text
    for text in ("I will kill you", "ich werde dich töten", "te voy a matar", "je vais te tuer", "not a fool but a moron", "a moron, not you"):
        assert s(text) > 0.5, text
    assert f("loweischaft und moron")["matched"] > f("ein moron")["matched"]
    assert f("a moron")["matched"] > f("a moron" + " word" * 10 ** 5)["matched"] > 0


def test_rare_insults_are_learned_and_copies_are_not(spark):
    """Terms in a few documents enter however many labels there are; words of copies of one text don't."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    rows = [(i, f"{name(i)} {'moron' if i % 100 else 'numpty'} q{name(i)}", 1) for i in range(1, 1001)]
    rows += [(2000 + i, "some copied zebra text", 1) for i in range(30)]
    rows += [(5000 + i, f"{name(i)} plain q{name(i)}", 0) for i in range(1000)]
    d = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 50 + [(None, "numpty")], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    lex = toxicity.Lexicon(model.terms)
    assert lex["moron"] == lex["numpty"] == toxicity.INSULT and lex["zebra"] == toxicity.PLAIN
    assert 0 <= model.weights[0] and 0 <= model.weights[1]
    got = toxicity.toxicity(d, lab).where("doc_id is null").collect()
    assert len(got) == 1 and got[0].held_out is False and got[0].predicted == 1


def test_labels_of_the_held_out_fold_are_not_seen(spark, docs, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, lb).collect()} for lb in (labels, flipped))
    assert a == b


def test_token_counts(spark, docs):
    tok = bpe.tokenizer_from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for r in queries.op1_token_counts(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        text = d.text or ""
        enc = tok.encode(text, add_special_tokens=False)
        rows = [r for r in sorted(got[d.doc_id], key=lambda r: r.section if r.section is not None else -1) if r.section is not None]
        want = [0] * len(rows)
        for a, b in enc.offsets:
            part = text[a:b]
            at = a + len(part) - len(part.lstrip(" \t\n\r\x0b\x0c")) if part.strip(" \t\n\r\x0b\x0c") else a
            want[next(k for k, r in enumerate(rows) if r.start <= at < r.end)] += 1
        assert [r.n_tokens for r in rows] == want
        assert abs(sum(r.n_tokens_share for r in got[d.doc_id]) - len(enc.ids)) < 1e-6


def test_token_counts_of_given_spans(spark):
    text = "Title here\n\n\nBody é中 text   end"
    d = spark.createDataFrame([(1, text, [("title", 0, 10), ("body", 13, len(text))]), (2, text, None)],
                              "doc_id long, text string, parts array<struct<name: string, start: int, end: int>>")
    rows = token_counts.token_counts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "parts").collect()
    n = len(bpe.tokenizer_from_file(P.path("byte_bpe_50k.json")).encode(text).ids)
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == n and [r.name for r in rows if r.doc_id == 2] == [None]
    assert {r.name for r in rows if r.doc_id == 1} == {"title", "body", None}


def test_resampling_draws_exactly_k(spark, docs, labels):
    rows = resampling.resample(docs, labels).collect()
    q = [r.quality for r in labels.collect() if r.quality is not None]
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    k = round(len(rows) * sum(q) / len(q))
    assert [r.kept for r in rows] == [r.gumbel_key >= keys[k - 1] for r in rows]
    junk = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert np.mean([r.log_weight for r in rows if r.doc_id in junk]) < np.mean([r.log_weight for r in rows if r.doc_id not in junk])


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-2 ** 40, 2 ** 40, 500).tolist() + [7] * 20
    df = spark.createDataFrame([(x,) for x in v], "k long")
    for k in (1, 17, 250, len(v)):
        assert resampling.kth_largest(df, "k", k) == sorted(v, reverse=True)[k - 1]


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, tox), (_, qual), (_, near), (_, mask), (_, pack) = corpus_pipeline.STAGES
    bad = {r.doc_id for r in toxicity.toxicity(docs, lab).collect() if r.predicted}
    a = tox(spark, docs, sf).cache()
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    b = qual(spark, a, sf).cache()
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in quality_rules.quality(a, lab).collect() if r.kept}
    c = near(spark, b, sf).cache()
    comp = plain_components([(r.doc_id, r.text) for r in b.collect()])
    assert sorted(r.doc_id for r in c.collect()) == sorted({m for _, m in comp.values()})
    e = mask(spark, c, sf).cache()
    assert e.columns == docs.columns and all(r.n_chars == len(r.text) for r in e.collect())
    plain_packing(pack(spark, e, sf).collect(), {r.doc_id: r.text for r in e.collect()})
