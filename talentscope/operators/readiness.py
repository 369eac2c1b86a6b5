"""Readiness model: five parts scaled to 0..1, a weighted total, bands,
yearly ranks, a top-3 shortlist per division and band summaries.

Each person is scored once, at their own latest rated year; anyone
without a performance row is absent, and a NULL part makes the total
NULL.  Every part is a per-person value at that year, so the five are
left-joined onto the people by ``employee_id``; each comes out of an
aggregate or join already hash-partitioned by person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentscope.functions.numeric import min_max_scale, rnd, safe_div
from talentscope.functions.scoring import TGV_WEIGHTS, readiness_band, weighted_sum
from talentscope.operators.common import at_latest_year, latest_year
from talentscope.operators.ranking import dense_rank_and_cume_dist
from talentscope.session import DEFAULT_BROADCAST_BYTES, attach_one_row, small_aggregate
from talentscope.sources.tables import TalentTables

PART_COLUMNS = {
    "Competencies": "tgv_competencies",
    "Cognitive": "tgv_cognitive",
    "PersonalityPAPI": "tgv_personalitypapi",
    "Context": "tgv_context",
    "BehaviorStrengths": "tgv_behaviorstrengths",
}


def _latest(t: TalentTables, latest: DataFrame | None) -> DataFrame:
    return latest if latest is not None else latest_year(t.performance_yearly)


def _on_latest(df: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach each person's latest year as ``year`` (inner: no rating, no row)."""
    return df.join(latest, "employee_id").withColumnRenamed("latest_year", "year")


def tgv_competencies(t: TalentTables, latest: DataFrame | None = None, with_year: bool = True) -> DataFrame:
    """``employee_id, year, comp_avg, tgv_competencies``: mean score (0..5) at the latest year.

    Scores are summed and counted per (person, year) first, combined map-side,
    so a person with a huge number of rows reaches the latest-year join as one
    row a year.
    """
    latest = _latest(t, latest)
    sums = t.competencies_yearly.groupBy("employee_id", "year").agg(F.sum("score").alias("_s"), F.count("score").alias("_n"))
    mean = safe_div("_s", "_n")
    return at_latest_year(sums, latest).select(
        "employee_id", *(["year"] if with_year else []),
        rnd(mean, 2).alias("comp_avg"),
        rnd(mean / 5.0, 4).alias("tgv_competencies"),
    )


def tgv_cognitive(t: TalentTables, latest: DataFrame | None = None, with_year: bool = True) -> DataFrame:
    """Mean of min-max scaled IQ and GTQ; bounds over everyone (one row, broadcast)."""
    latest = _latest(t, latest)
    psych = t.profiles_psych.select("employee_id", "iq", "gtq")
    bounds = psych.agg(
        F.min("iq").alias("min_iq"), F.max("iq").alias("max_iq"),
        F.min("gtq").alias("min_gtq"), F.max("gtq").alias("max_gtq"),
    )
    scaled = attach_one_row(psych, bounds).select(
        "employee_id",
        rnd((min_max_scale("iq", "min_iq", "max_iq") + min_max_scale("gtq", "min_gtq", "max_gtq")) / 2, 4)
        .alias("tgv_cognitive"),
    )
    if not with_year:
        return scaled
    return _on_latest(scaled, latest).select("employee_id", "year", "tgv_cognitive")


def tgv_personality(t: TalentTables, latest: DataFrame | None = None, with_year: bool = True) -> DataFrame:
    """Mean over scales of the score min-max scaled within its scale.

    Per-scale bounds are an aggregate (one row per scale), written,
    measured and broadcast back onto the scores, so scores are never
    shuffled by their few scale codes.
    """
    latest = _latest(t, latest)
    papi = t.papi_scores.select("employee_id", "scale_code", "score")
    by_scale = small_aggregate(
        papi.groupBy("scale_code").agg(F.min("score").alias("min_s"), F.max("score").alias("max_s")))
    z = papi.join(by_scale, "scale_code").select("employee_id", min_max_scale("score", "min_s", "max_s").alias("z"))
    per_person = z.groupBy("employee_id").agg(F.sum("z").alias("zs"), F.count("z").alias("zc"))
    part = rnd(safe_div("zs", "zc"), 4).alias("tgv_personalitypapi")
    if not with_year:
        return per_person.select("employee_id", part)
    return _on_latest(per_person, latest).select("employee_id", "year", part)


def tgv_context(t: TalentTables, latest: DataFrame | None = None, with_year: bool = True) -> DataFrame:
    """Rating / 5 at the latest year (rating 1 gives 0.2)."""
    latest = _latest(t, latest)
    perf = at_latest_year(t.performance_yearly, latest)
    return perf.select("employee_id", *(["year"] if with_year else []),
                       rnd(F.col("rating") / 5.0, 4).alias("tgv_context"))


def tgv_strengths(t: TalentTables, latest: DataFrame | None = None, with_year: bool = True) -> DataFrame:
    """``1 - minmax(mean rank)``: a smaller rank is better; equal means give NULL."""
    latest = _latest(t, latest)
    r = t.strengths.groupBy("employee_id").agg(F.avg("rank").alias("avg_rank"))
    bounds = r.agg(F.min("avg_rank").alias("min_r"), F.max("avg_rank").alias("max_r"))
    scaled = attach_one_row(r, bounds).select(
        "employee_id", rnd(1 - min_max_scale("avg_rank", "min_r", "max_r"), 4).alias("tgv_behaviorstrengths")
    )
    if not with_year:
        return scaled
    return _on_latest(scaled, latest).select("employee_id", "year", "tgv_behaviorstrengths")


def readiness_final(t: TalentTables, latest: DataFrame | None = None,
                    weights: dict[str, float] | None = None) -> DataFrame:
    """``employee_id, year, finalmatch, finalmatch_pct`` and the five parts.

    The total adds the already-rounded parts; the percent is rounded from
    the unrounded sum, not from the rounded total.

    Every part belongs to the person's latest year, so the parts are
    joined on ``employee_id`` alone: all inputs of the five left joins are
    hash-partitioned by person and the joins add no shuffle of their own.
    """
    weights = weights or TGV_WEIGHTS
    latest = _latest(t, latest)
    base = t.employees.select("employee_id").join(latest, "employee_id").withColumnRenamed("latest_year", "year")
    parts = [
        tgv_competencies(t, latest, with_year=False).drop("comp_avg"),
        tgv_cognitive(t, latest, with_year=False),
        tgv_personality(t, latest, with_year=False),
        tgv_context(t, latest, with_year=False),
        tgv_strengths(t, latest, with_year=False),
    ]
    df = base
    for p in parts:
        df = df.join(p, "employee_id", "left")
    total = weighted_sum({g: F.col(c) for g, c in PART_COLUMNS.items()}, weights, missing_as_zero=False)
    return df.select(
        "employee_id",
        "year",
        rnd(total, 4).alias("finalmatch"),
        rnd(F.lit(100.0) * total, 2).alias("finalmatch_pct"),
        *PART_COLUMNS.values(),
    )


def readiness_ranked(final: DataFrame, max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``final.*`` plus ``readiness_category``, ``rank_in_year`` (dense, NULL
    totals first) and ``percentile_in_year`` (cume dist x 100, NULLs last).

    ``final`` should be materialised: the rank histogram is counted before
    it is broadcast.
    """
    ranked = dense_rank_and_cume_dist(
        final, ["year"], "finalmatch", rank_col="rank_in_year", cume_col="_cume",
        max_broadcast_bytes=max_broadcast_bytes,
    )
    return ranked.select(
        *final.columns,
        readiness_band("finalmatch_pct").alias("readiness_category"),
        F.col("rank_in_year").cast("long").alias("rank_in_year"),
        rnd(F.lit(100.0) * F.col("_cume"), 2).alias("percentile_in_year"),
    )


def shortlist(ranked: DataFrame, t: TalentTables, k: int = 3) -> DataFrame:
    """Top ``k`` per (division, year) by total, NULL totals first, ties by id.

    The ``row_number() <= k`` filter becomes a partial WindowGroupLimit
    before the shuffle, so each task ships at most ``k`` rows per group.
    """
    emp = t.employees.select("employee_id", "division_id")
    div = t.dim_divisions.select("division_id", F.col("name").alias("division_name"))
    w = Window.partitionBy("division_id", "year").orderBy(F.col("finalmatch").desc_nulls_first(), "employee_id")
    return (
        ranked.select("employee_id", "year", "finalmatch", "finalmatch_pct", "readiness_category")
        .join(emp, "employee_id")
        .join(div, "division_id")
        .withColumn("rank_in_division", F.row_number().over(w))
        .filter(F.col("rank_in_division") <= k)
        .select("division_name", "employee_id", "year", "finalmatch_pct", "readiness_category",
                F.col("rank_in_division").cast("long").alias("rank_in_division"))
    )


def _share(count_col: str, over: list[str]) -> F.Column:
    w = Window.partitionBy(*over) if over else Window.partitionBy()
    return rnd(F.lit(100.0) * F.col(count_col) / F.sum(count_col).over(w), 2)


def _newest(ranked: DataFrame) -> DataFrame:
    newest = ranked.agg(F.max("year").alias("_newest"))
    return ranked.join(F.broadcast(newest), F.col("year") == F.col("_newest")).drop("_newest")


def readiness_summary_latest(ranked: DataFrame) -> DataFrame:
    """``year, readiness_category, n_employees, pct_of_total`` for the newest year.

    The share is a window over the aggregated rows (a handful of bands),
    never over people.
    """
    agg = _newest(ranked).groupBy("year", "readiness_category").agg(F.count(F.lit(1)).alias("n_employees"))
    return agg.withColumn("pct_of_total", _share("n_employees", []))


def readiness_summary_by_year(ranked: DataFrame) -> DataFrame:
    agg = ranked.groupBy("year", "readiness_category").agg(F.count(F.lit(1)).alias("n_employees"))
    return agg.withColumn("pct_of_total", _share("n_employees", ["year"]))


def readiness_summary_by_division(ranked: DataFrame, t: TalentTables) -> DataFrame:
    emp = t.employees.select("employee_id", "division_id")
    div = t.dim_divisions.select("division_id", F.col("name").alias("division_name"))
    agg = (
        _newest(ranked)
        .select("employee_id", "readiness_category")
        .join(emp, "employee_id")
        .join(div, "division_id")
        .groupBy("division_name", "readiness_category")
        .agg(F.count(F.lit(1)).alias("n_employees"))
    )
    return agg.withColumn("pct_within_division", _share("n_employees", ["division_name"]))
