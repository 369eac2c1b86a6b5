"""Per-job and per-candidate views over the match detail: ranked lists,
distribution, colour bands, group profile, strengths and gaps, evidence.

They take the match detail as the view shows it (scores and rates
rounded to 2, see ``match.detail_view``), so colour bands, means and
orderings see the same numbers a user sees.

Everything is computed for every job and every candidate at once.  Each
candidate has a few dozen trait rows per job, so per-candidate windows
and short lists are bounded; per-job lists use a row-number limit that
Spark applies partially before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd
from talentscope.functions.scoring import STRONG_AT, TGV_NAMES, WEAK_AT, match_band

DIMS = ["directorate", "role", "grade"]


def _with_job(detail: DataFrame) -> DataFrame:
    return detail.filter(F.col("job_vacancy_id").isNotNull())


def _complete(df: DataFrame) -> DataFrame:
    return df.filter(F.col("fullname").isNotNull() & F.col("directorate").isNotNull()
                     & F.col("role").isNotNull() & F.col("grade").isNotNull())


def ranked_talent(groups: DataFrame, keep_missing_dims: bool = False) -> DataFrame:
    """``job_vacancy_id, employee_id, fullname, directorate, role, grade,
    final_match_rate``: one row per candidate and job, from the per-(person,
    job) group table (``match.match_groups``), no shuffle.

    People with a missing name, directorate, role or grade are dropped
    unless ``keep_missing_dims`` (a grouped pandas frame drops them too).
    """
    g = groups.filter(F.col("job_vacancy_id").isNotNull())
    return (g if keep_missing_dims else _complete(g)).select(
        "job_vacancy_id", "employee_id", "fullname", *DIMS, rnd("_final", 2).alias("final_match_rate"))


def top_per_job(ranked: DataFrame, n: int) -> DataFrame:
    """Best ``n`` candidates per job (final rate desc, ties by id) with ``rank_in_job``."""
    w = Window.partitionBy("job_vacancy_id").orderBy(F.col("final_match_rate").desc_nulls_last(), "employee_id")
    return (ranked.withColumn("rank_in_job", F.row_number().over(w)).filter(F.col("rank_in_job") <= n)
            .withColumn("rank_in_job", F.col("rank_in_job").cast("long")))


def match_distribution(ranked: DataFrame, n: int = 100, width: float = 10.0) -> DataFrame:
    """``job_vacancy_id, bucket_lo, n_candidates``: the top ``n`` per job
    counted in bands of ``width`` points."""
    top = top_per_job(ranked, n)
    bucket = (F.floor(F.col("final_match_rate") / width) * width).cast("double")
    return top.groupBy("job_vacancy_id", bucket.alias("bucket_lo")).agg(F.count(F.lit(1)).alias("n_candidates"))


def candidate_tv_bands(detail: DataFrame) -> DataFrame:
    """Trait rows of each candidate with ``match_band`` (green / amber / red)."""
    return _with_job(detail).select(
        "job_vacancy_id", "employee_id", "tv_name", "baseline_score", "user_score", "tv_match_rate",
        match_band("tv_match_rate").alias("match_band"),
    )


def _group_items(groups: DataFrame) -> F.Column:
    """Array of (tgv_name, r, c) of a group-table row: the groups with trait rows, rates rounded."""
    items = F.array(*[F.struct(F.lit(g).alias("tgv_name"), rnd(f"_g_{g}", 2).alias("r"), F.col(f"_c_{g}").alias("c"))
                      for g in sorted(TGV_NAMES)])
    return F.filter(items, lambda x: x["c"] > 0)


def candidate_tgv_profile(groups: DataFrame) -> DataFrame:
    """``job_vacancy_id, employee_id, tgv_name, tgv_match_rate, benchmark_rate``
    (the candidate's group rates, rounded to 2, beside the constant 100): one
    row per group the candidate has trait rows in, no shuffle."""
    return _with_job(groups).select("job_vacancy_id", "employee_id", F.explode(_group_items(groups)).alias("p")).select(
        "job_vacancy_id", "employee_id", "p.tgv_name", F.col("p.r").alias("tgv_match_rate"),
        F.lit(100.0).alias("benchmark_rate"))


def candidate_insight(groups: DataFrame) -> DataFrame:
    """Per candidate: best and worst group (ties: first name), and the
    groups at or above 85 (strong) and at or below 70 (weak), by name.
    Array functions on the group-table row, no shuffle."""
    def names(keep) -> F.Column:
        return F.array_join(F.transform(F.filter("items", keep), lambda x: x["tgv_name"]), ",")

    def first(sign: int) -> F.Column:  # items are in name order, so equal rates keep the first name
        known = F.filter("items", lambda x: x["r"].isNotNull())
        order = F.transform(known, lambda x: F.struct((x["r"] * sign).alias("k"), x["tgv_name"].alias("tgv_name")))
        return F.array_min(order)["tgv_name"]

    rows = _with_job(groups).select("job_vacancy_id", "employee_id", _group_items(groups).alias("items"))
    return rows.select(
        "job_vacancy_id", "employee_id", first(-1).alias("best_tgv"), first(1).alias("worst_tgv"),
        names(lambda x: x["r"] >= STRONG_AT).alias("strong_tgvs"), names(lambda x: x["r"] <= WEAK_AT).alias("weak_tgvs"))


def job_tgv_summary(groups: DataFrame) -> DataFrame:
    """``job_vacancy_id, tgv_name, avg_tgv_match, tgv_rank, is_best, is_worst``:
    mean over the job's trait rows (each person's rounded group rate weighted
    by their number of trait rows in the group; rows with no rate are skipped),
    ranked high to low, missing means last, ties by name."""
    rows = _with_job(groups).select("job_vacancy_id", F.explode(_group_items(groups)).alias("p")).select("job_vacancy_id", "p.*")
    known = F.col("r").isNotNull()
    agg = rows.groupBy("job_vacancy_id", "tgv_name").agg(
        rnd(F.sum(F.when(known, F.col("r") * F.col("c"))) / F.sum(F.when(known, F.col("c"))), 2)
        .alias("avg_tgv_match"))
    return _rank_job_groups(agg)


def _rank_job_groups(agg: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_vacancy_id").orderBy(F.col("avg_tgv_match").desc_nulls_last(), "tgv_name")
    wn = Window.partitionBy("job_vacancy_id")
    ranked = agg.withColumn("tgv_rank", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(wn))
    return ranked.select(
        "job_vacancy_id", "tgv_name", "avg_tgv_match",
        F.col("tgv_rank").cast("long").alias("tgv_rank"),
        (F.col("tgv_rank") == 1).alias("is_best"),
        (F.col("tgv_rank") == F.col("_n")).alias("is_worst"),
    )


def _placed(detail: DataFrame, k: int) -> DataFrame:
    """Trait rows among a candidate's ``k`` best (``hi``) or ``k`` worst (``lo``):
    both positions from one shuffle by (job, candidate)."""
    key = Window.partitionBy("job_vacancy_id", "employee_id")
    r = F.col("tv_match_rate")
    d = _with_job(detail).select("job_vacancy_id", "employee_id", "tv_name", "tv_match_rate")
    return (d.withColumn("hi", F.row_number().over(key.orderBy(r.desc_nulls_last(), "tv_name")))
            .withColumn("lo", F.row_number().over(key.orderBy(r.asc_nulls_last(), "tv_name")))
            .filter((F.col("hi") <= k) | (F.col("lo") <= k)))


def candidate_top_bottom_tvs(detail: DataFrame, k: int = 5) -> DataFrame:
    """``job_vacancy_id, employee_id, side, position, tv_name, tv_match_rate``:
    each candidate's ``k`` best ('top') and ``k`` worst ('low') traits,
    missing rates last on both sides, ties by trait name."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).cast("long").alias("position")) for side, c in (("top", "hi"), ("low", "lo"))])
    placed = _placed(detail, k).withColumn("s", F.explode(F.filter(sides, lambda x: x["position"] <= k)))
    return placed.select("job_vacancy_id", "employee_id", "s.side", "s.position", "tv_name", "tv_match_rate")


def candidate_evidence_json(detail: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """``job_vacancy_id, employee_id, evidence``: JSON with the job's best and
    weakest group (from the group table) and the candidate's top and low
    traits (one shuffle of the detail, shared by positions and lists)."""
    summary = job_tgv_summary(groups).groupBy("job_vacancy_id").agg(
        F.max(F.when(F.col("is_best"), F.col("tgv_name"))).alias("tgv_best"),
        F.max(F.when(F.col("is_worst"), F.col("tgv_name"))).alias("tgv_gap"),
    )

    def side(c: str) -> F.Column:
        item = F.when(F.col(c) <= k, F.struct(F.col(c), F.struct("tv_name", "tv_match_rate").alias("tv")))
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["tv"])

    lists = _placed(detail, k).groupBy("job_vacancy_id", "employee_id").agg(side("hi").alias("top"), side("lo").alias("low"))
    return lists.join(summary, "job_vacancy_id").select(
        "job_vacancy_id", "employee_id",
        F.to_json(F.struct(
            F.col("job_vacancy_id"), F.col("tgv_best"), F.col("tgv_gap"),
            F.col("employee_id").alias("candidate_id"),
            F.col("top").alias("candidate_top_tvs"), F.col("low").alias("candidate_low_tvs"),
        )).alias("evidence"),
    )
