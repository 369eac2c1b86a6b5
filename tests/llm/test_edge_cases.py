"""Every operator and pipeline stage over odd rows and empty tables."""

import duckdb
import public_tokenizers as P
import pytest
from llm_cases import ODD

import corpus_pipeline
from talentscope.llm import bpe, jaccard_join, language_id, packing, quality_rules, queries, resampling, secrets, token_counts, topk_search, toxicity
from talentscope.llm.oracle import TOP_K

RANKS, MULTI = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "token_counts": lambda d, lb: token_counts.token_counts(d, RANKS, P.PATTERN),
    "language_id": lambda d, lb: language_id.language_id(d),
    "packing": lambda d, lb: packing.pack(d, RANKS, P.PATTERN),
    "quality": lambda d, lb: quality_rules.quality(d, lb),
    "secrets": lambda d, lb: secrets.findings(d),
    "masked": lambda d, lb: secrets.masked(d),
    "resampling": lambda d, lb: resampling.resample(d, lb),
    "jaccard": lambda d, lb: jaccard_join.jaccard_components(d),
    "one_of_each": lambda d, lb: jaccard_join.one_of_each(d),
    "toxicity": lambda d, lb: toxicity.toxicity(d, lb),
    "clean": lambda d, lb: toxicity.clean(d, lb),
    "good": lambda d, lb: quality_rules.good(d, lb),
    "bpe": lambda d, lb: bpe.round_trip(d, MULTI, P.PATTERN),
}
PER_ROW = {"language_id", "quality", "resampling", "jaccard", "toxicity", "bpe", "masked"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, odd_labels):
    got = OPERATORS[name](odd, odd_labels).collect()
    if name in PER_ROW:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, empty, no_labels):
    assert OPERATORS[name](empty, no_labels).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity", "resampling"])
def test_no_labels(name, odd, no_labels):
    assert len(OPERATORS[name](odd, no_labels).collect()) == len(ODD)


def test_defined_results(odd, odd_labels):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    j = by(jaccard_join.jaccard_components(odd))
    assert (j[1].component_id, j[2].component_id, j[3].component_id, j[5].n_shingles, j[6].component_id, j[7].component_id) == (1, 1, 3, 0, 6, 6)
    assert j[None].component_id is None and j[1].n_copies == 3
    lang = by(language_id.language_id(odd))
    assert lang[3].lang_pred == lang[4].lang_pred == lang[8].lang_pred == "und" and lang[3].score == 0
    assert lang[9].lang_pred in {"en", "de", "fr"}
    q = by(quality_rules.quality(odd, odd_labels))
    assert q[3].n_words == 0 and q[3].base_failed and not q[3].kept and q[9].n_repeat_words == 120_000
    assert {r.doc_id for r in secrets.findings(odd).collect()} == {10}
    one = jaccard_join.one_of_each(odd)
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10] and one.columns == odd.columns
    masked = by(secrets.masked(odd))
    assert masked[10].text.count(secrets.MASK) == 2 and masked[1].text == ODD[0][1] and masked[3].text is None
    pieces = packing.pack(odd, RANKS, P.PATTERN).collect()
    assert sum(r.length for r in pieces if r.doc_id == 3) == 1  # the end id alone
    b = by(bpe.round_trip(odd, MULTI, P.PATTERN))
    assert b[3].n_tokens == b[4].n_tokens == 0 and b[3].ids_sha256 == b[4].decoded_sha256


def test_pipeline_stages(spark, odd, empty, tmp_path, odd_labels, no_labels):
    for name, docs, labels in (("odd", odd, odd_labels), ("empty", empty, no_labels)):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == columns
            docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/{name}").count()


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [-0.0001, 0.0]), (200, [2.0, 2.0])]
    v = topk_search.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in topk_search.top_k(v, v.where("vec_id % 100 = 0"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 200, 3 * 1024 * 1024), (2, 1, 1310720), (3, 2, 1310720)]
    assert sorted(got[100]) == [(1, 0, -1024), (2, 1, -1024), (3, 2, -1024)]
    none = topk_search.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk_search.top_k(none, none).collect() == []


def test_top_k_large_components_repeated_ids_and_empty_vectors(spark, tmp_path):
    """As the SQL has it: no limit of magnitude, rows of one id are candidates each, empty vectors score 0."""
    rows = [(0, [1.0, 1e5]), (1, [3e5, 7e4]), (1, [2.0, -3.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [1e6, 1.0]), (100, [1e6, -1e6]), (100, [-1e6, 1e6]), (200, [0.25, 0.5])]
    rows += [(i, [float(i % 7) * 1e4, float(i % 5)]) for i in range(4, 90)] + [(7, [5e4, 1.0])] * 150
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = [tuple(r) for r in duckdb.sql(TOP_K.replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")).fetchall()]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op10_topk_search(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    v = topk_search.integers(spark.createDataFrame([(0, []), (1, []), (2, [1.0]), (3, [2.0**50]), (4, [2.0**-9])], "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.vec_id, r.score) for r in topk_search.top_k(v, v.where("vec_id = 0")).collect()] == [(0, 1, 0)]
    assert [(r.vec_id, r.score) for r in topk_search.top_k(v, v.where("vec_id = 4")).orderBy("rank").collect()] == [(3, 2**61), (2, 2048)]
