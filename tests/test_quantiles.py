"""Exact grouped quantiles: narrowing equals numpy and the engine's own aggregate."""

import math

import numpy as np
import pytest
from helpers import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentscope.operators.quantiles import column_medians, exact_quantiles
from talentscope.plans.catalog import QUERIES

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("leaf", [1, 7, 10_000])
def test_groups_with_ties_nulls_and_outliers(spark, leaf):
    rng = np.random.default_rng(3)
    data = {
        "even": rng.normal(size=900), "ties": rng.integers(1, 4, 700).astype(float), "hot": np.concatenate([np.full(800, 3.0), rng.normal(size=50)]),
        "wide": np.concatenate([rng.normal(size=300) * 1e-300, [1e308, -1e308]]), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=40),
    }
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", PROBS, leaf=leaf).collect()}
    disc = {r.g: r.q for r in exact_quantiles(df, ["g"], "x", PROBS, discrete=True, leaf=leaf).collect()}
    assert set(got) == set(data)
    own = {r.g: r for r in df.groupBy("g").agg(F.percentile("x", PROBS).alias("q"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY x)").alias("d")).collect()}
    for g, xs in data.items():
        assert got[g].n == len(xs) and list(got[g].q) == list(own[g].q)
        s = sorted(xs)
        assert list(disc[g]) == [s[max(math.ceil(p * len(s)) - 1, 0)] for p in PROBS] and disc[g][1] == own[g].d


def test_a_million_distinct_doubles_in_one_group(spark):
    df = spark.range(0, 1_000_000, 1, 8).select((F.pmod(F.col("id") * 48271, F.lit(1_000_003)) / 7.0).alias("x")).select(F.exp(F.col("x") / 20_000).alias("x"))
    r = exact_quantiles(df, [], "x", [0.25, 0.5, 0.75]).first()
    want = df.agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q")).first().q
    assert r.n == 1_000_000 and list(r.q) == list(want)


def test_empty_and_all_null(spark):
    none = spark.createDataFrame([(None,), (None,)], "x double")
    r = exact_quantiles(none, [], "x", [0.5]).first()
    assert r.n == 0 and r.q[0] is None
    assert exact_quantiles(none.limit(0).withColumn("g", F.lit(1)), ["g"], "x", [0.5]).collect() == []
    two = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert tuple(column_medians(two, ["a", "b"]).first()) == (1.5, None)


@settings(max_examples=4, deadline=None)
@given(xs=st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60), leaf=st.integers(1, 8))
def test_any_list(spark, xs, leaf):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert list(exact_quantiles(df, [], "x", [0.1, 0.5], leaf=leaf).first().q) == list(df.agg(F.percentile("x", [0.1, 0.5]).alias("q")).first().q)


@pytest.mark.parametrize("name", ["dq_describe", "score_box_stats", "clean_profiles", "clean_competencies", "clean_papi", "match_baseline"])
def test_queries_hold_no_values_per_group(spark, name):
    p = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in p and "median(" not in p and "percentile_disc" not in p and "percentile_cont" not in p
