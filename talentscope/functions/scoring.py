"""Scoring expressions shared by the readiness and match models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd

# The five talent groups and their default weights.
TGV_WEIGHTS = {
    "Competencies": 0.40,
    "Cognitive": 0.30,
    "PersonalityPAPI": 0.15,
    "Context": 0.10,
    "BehaviorStrengths": 0.05,
}
TGV_NAMES = list(TGV_WEIGHTS)

# Readiness bands, lowest percent that reaches each band.
READINESS_BANDS = [(80.0, "Fast Track"), (65.0, "Ready"), (50.0, "Watchlist")]
READINESS_DEFAULT_BAND = "Develop"

# Colour bands of a TV match rate, and strong / weak limits.
MATCH_GREEN_AT = 90.0
MATCH_AMBER_AT = 70.0
STRONG_AT = 85.0
WEAK_AT = 70.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tv_match_rate(user_score: Column | str, baseline: Column | str, direction: Column | str) -> Column:
    """Match of one trait against the benchmark median, in percent.

    higher: ``LEAST(100, 100*u/b)`` (no lower clamp);
    lower:  ``GREATEST(0, LEAST(100, 100*(2b-u)/b))``;
    a NULL or zero baseline gives NULL.  ``least``/``greatest`` skip NULL,
    so a missing score against a valid baseline scores 100.
    """
    u, b, d = _col(user_score), _col(baseline), _col(direction)
    hundred, zero = F.lit(100.0), F.lit(0.0)
    return (
        F.when(b.isNull() | (b == 0), F.lit(None).cast("double"))
        .when(d == "higher", F.least(hundred, hundred * (u / b)))
        .when(d == "lower", F.greatest(zero, F.least(hundred, hundred * ((F.lit(2.0) * b - u) / b))))
    )


def weighted_sum(parts: dict[str, Column], weights: dict[str, float], missing_as_zero: bool) -> Column:
    """``w1*p1 + w2*p2 + ...`` in the order of ``weights``.

    ``missing_as_zero`` mirrors ``COALESCE(part, 0)`` (match model); without
    it any NULL part makes the sum NULL (readiness model).
    """
    total = None
    for name, w in weights.items():
        p = parts[name]
        if missing_as_zero:
            p = F.coalesce(p, F.lit(0.0))
        term = F.lit(float(w)) * p
        total = term if total is None else total + term
    return total


def readiness_band(pct: Column | str) -> Column:
    """Band label of a readiness percent; NULL falls through to 'Develop'."""
    p = _col(pct)
    expr = None
    for lo, label in READINESS_BANDS:
        expr = F.when(p >= lo, label) if expr is None else expr.when(p >= lo, label)
    return expr.otherwise(READINESS_DEFAULT_BAND)


def match_band(rate: Column | str) -> Column:
    """'green' from 90, 'amber' from 70, else 'red' (NULL is 'red')."""
    r = _col(rate)
    return F.when(r >= MATCH_GREEN_AT, "green").when(r >= MATCH_AMBER_AT, "amber").otherwise("red")
