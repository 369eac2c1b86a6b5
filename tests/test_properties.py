"""Property tests: column helpers against plain-Python reference rules,
on random batches (one Spark job per batch)."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from talentscope.functions import to_number, tv_match_rate
from talentscope.functions.numeric import NUMBER_PATTERN, rnd, rnd_even

_pattern = re.compile(NUMBER_PATTERN)


def py_to_number(s):
    if s is None:
        return None
    t = s.strip(" \t\n\r\f\v")
    return float(t) if _pattern.match(t) else None


def py_round(x, n, mode):
    if x is None:
        return None
    exact = Decimal(repr(x)).quantize(Decimal(1).scaleb(-10), rounding=ROUND_HALF_UP)
    return float(exact.quantize(Decimal(1).scaleb(-n), rounding=mode))


number_like = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda f: f"{f}"),
    st.integers(-10**6, 10**6).map(str),
    st.sampled_from([" 5 ", "abc", "", "1e3", "5d", "NaN", "inf", "-0.5", ".5", "5.", "+7", "1e-2", "\t3\n"]),
    st.text(alphabet=" 0123456789.eE+-x", max_size=6),
)


@settings(max_examples=8, deadline=None)
@given(st.lists(number_like, min_size=1, max_size=60))
def test_to_number_matches_reference(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r["n"] for r in df.select(to_number("s").alias("n")).collect()]
    assert got == [py_to_number(v) for v in values]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-10**7, 10**7), min_size=1, max_size=60), st.sampled_from([1, 2, 4]))
def test_rounding_matches_decimal_rules(spark, ints, places):
    # values with an exact decimal half at the rounding position and their neighbours
    values = [i / 10 ** (places + 1) + 5 / 10 ** (places + 2) for i in ints] + [i / 997 for i in ints]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(rnd("x", places).alias("u"), rnd_even("x", places).alias("e")).collect()
    assert [r["u"] for r in rows] == [py_round(v, places, ROUND_HALF_UP) for v in values]
    assert [r["e"] for r in rows] == [py_round(v, places, ROUND_HALF_EVEN) for v in values]


def py_rate(u, b, d):
    if b is None or b == 0:
        return None
    if d == "higher":
        return 100.0 if u is None else min(100.0, 100.0 * (u / b))
    if u is None:
        return 100.0
    return max(0.0, min(100.0, 100.0 * ((2.0 * b - u) / b)))


scores = st.one_of(st.none(), st.floats(-50, 200, allow_nan=False).map(lambda f: round(f, 2)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(scores, scores, st.sampled_from(["higher", "lower"])), min_size=1, max_size=60))
def test_tv_match_rate_matches_reference(spark, rows):
    df = spark.createDataFrame(rows, "u double, b double, d string")
    got = [r["r"] for r in df.select(tv_match_rate("u", "b", "d").alias("r")).collect()]
    assert got == [py_rate(u, b, d) for u, b, d in rows]
