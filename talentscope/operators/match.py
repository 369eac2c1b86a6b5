"""Benchmark match model: each person's traits against the median of a
job's role models, from single traits (TV) to trait groups (TGV) to a
weighted final rate.

1. ``traits.trait_vectors``: one row per person holding all traits (one
   grouped aggregate by person; written, then read by everything below).
2. Baselines are medians over the cohort members only: the vectors (or the
   fact tables, if no vectors are given) are first cut to the cohort's ids by
   a semi join, broadcast once the id list has been measured.  The result, one
   row per (job, trait), is written.
3. Baselines become one small row per set of jobs, broadcast to the vectors,
   and array functions give TV, group and final rates in one scan.

Rows of a trait no cohort has keep a NULL job, and their TGV and final
rates are NULL (the original self-joins compared NULL job ids with ``=``).
``match_tv``, ``match_tgv`` and ``match_final`` define the same rates over
trait rows of any origin, as joins and grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd
from talentscope.functions.scoring import TGV_NAMES, TGV_WEIGHTS, tv_match_rate, weighted_sum
from talentscope.operators import traits
from talentscope.operators.benchmark import cohort_explode
from talentscope.operators.quantiles import exact_quantiles
from talentscope.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small, measured_bytes, write_and_read
from talentscope.sources.tables import TalentTables

def tv_long(t: TalentTables, include_tiki: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """``employee_id, tgv_name, tv_name, user_score, direction``: the trait
    vectors as rows."""
    vectors = vectors if vectors is not None else traits.trait_vectors(t)
    return traits.tv_rows(vectors if include_tiki else traits.without_tiki(vectors))


def restrict_to(t: TalentTables, ids: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES,
                checked: bool = False) -> TalentTables:
    """The same tables cut to people in ``ids``: a semi join at each fact
    scan, broadcast when the distinct ids are few (counted here unless the
    caller has already bounded them: ``checked=True``)."""
    ids = ids.select("employee_id").distinct()
    ids = F.broadcast(ids) if checked else broadcast_if_small(ids, max_bytes)
    keyed = ["employees", "performance_yearly", "competencies_yearly", "profiles_psych", "papi_scores", "strengths"]
    return t.map(lambda n, df: df.join(ids, "employee_id", "left_semi") if n in keyed else df)


def match_baseline(tv: DataFrame, cohort: DataFrame) -> DataFrame:
    """``job_vacancy_id, tgv_name, tv_name, baseline_score``: the discrete
    median (PERCENTILE_DISC 0.5) of the cohort's scores; NULL scores are
    ignored (a trait with no other has a NULL median) and a person listed
    twice counts twice.  The cohort's scores are written once, then the medians
    of all jobs and traits are narrowed together."""
    keys = ["job_vacancy_id", "tgv_name", "tv_name"]
    scores = write_and_read(tv.join(cohort, "employee_id").select(*keys, "user_score"), "cohort_scores")
    medians = exact_quantiles(scores, keys, "user_score", [0.5], discrete=True).select(*keys, F.col("q")[0].alias("baseline_score"))
    unknown = scores.groupBy(*keys).agg(F.count("user_score").alias("n")).where("n = 0").select(*keys, F.lit(None).cast("double").alias("baseline_score"))
    return medians.unionByName(unknown)


def baseline_table(t: TalentTables, include_tiki: bool = True, max_bytes: int = DEFAULT_BROADCAST_BYTES,
                   cohort: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Baselines of every job computed from the cohort members only, not yet
    written.  ``cohort`` gives the cohorts as (job, employee) rows instead of
    the arrays of the benchmark table; ``vectors`` are written trait vectors,
    else the fact tables are cut to the cohort's ids and theirs are made."""
    cohort = cohort if cohort is not None else cohort_explode(t.talent_benchmarks)
    # one measure bounds both the (job, id) pairs and the distinct ids
    small_cohort = measured_bytes(cohort) <= max_bytes
    if vectors is None:
        small = restrict_to(t, cohort, max_bytes, checked=small_cohort)
        tv = tv_long(small, include_tiki)
    else:
        ids = cohort.select("employee_id").distinct()
        tv = tv_long(t, include_tiki, vectors.join(F.broadcast(ids) if small_cohort else ids, "employee_id", "left_semi"))
    return match_baseline(tv, F.broadcast(cohort) if small_cohort else cohort)


def baselines(t: TalentTables, include_tiki: bool = True, max_bytes: int = DEFAULT_BROADCAST_BYTES,
              materialize: bool = True, **kw) -> DataFrame:
    """``baseline_table``, written (unless ``materialize=False``) and counted,
    then marked for broadcast when small."""
    base = baseline_table(t, include_tiki, max_bytes, **kw)
    if materialize:
        base = write_and_read(base, "baselines")
    return broadcast_if_small(base, max_bytes)


def match_tv(tv: DataFrame, baseline: DataFrame) -> DataFrame:
    """``employee_id, job_vacancy_id, tgv_name, tv_name, baseline_score,
    user_score, direction, tv_match_rate`` for every job having the trait;
    a trait no job has stays once, with NULL job and rate."""
    return tv.join(baseline, ["tgv_name", "tv_name"], "left").select(
        "employee_id", "job_vacancy_id", "tgv_name", "tv_name", "baseline_score", "user_score", "direction",
        tv_match_rate("user_score", "baseline_score", "direction").alias("tv_match_rate"),
    )


def match_tgv(tvm: DataFrame) -> DataFrame:
    """``employee_id, job_vacancy_id, tgv_name, tgv_match_rate`` (mean of TV rates)."""
    return tvm.groupBy("employee_id", "job_vacancy_id", "tgv_name").agg(
        F.avg("tv_match_rate").alias("tgv_match_rate"))


def match_final(tgv: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``employee_id, job_vacancy_id, final_match_rate``: weighted groups, a
    missing group counts 0, weights not renormalised, rounded to 2."""
    weights = weights or TGV_WEIGHTS
    parts = {g: F.max(F.when(F.col("tgv_name") == g, F.col("tgv_match_rate"))) for g in weights}
    return tgv.groupBy("employee_id", "job_vacancy_id").agg(
        rnd(weighted_sum(parts, weights, missing_as_zero=True), 2).alias("final_match_rate"))


def tgv_from_groups(groups: DataFrame) -> DataFrame:
    """``match_tgv`` read from the group table: no fan-out, no shuffle."""
    items = F.array(*[F.struct(F.lit(g).alias("tgv_name"), F.col(f"_g_{g}").alias("tgv_match_rate"), F.col(f"_c_{g}").alias("c"))
                      for g in TGV_NAMES])
    return groups.select("employee_id", "job_vacancy_id", F.explode(F.filter(items, lambda x: x["c"] > 0)).alias("p")).select(
        "employee_id", "job_vacancy_id", "p.tgv_name", "p.tgv_match_rate")


def final_from_groups(groups: DataFrame) -> DataFrame:
    """``match_final`` read from the group table."""
    return groups.select("employee_id", "job_vacancy_id", F.col("_final").alias("final_match_rate"))


def matching_detail(t: TalentTables, job_id: int | None = None, include_tiki: bool = True,
                    weights: dict[str, float] | None = None, baseline: DataFrame | None = None,
                    vectors: DataFrame | None = None, set_bytes: int = traits.SET_BYTES) -> DataFrame:
    """Unrounded detail rows with names: ``job_vacancy_id, employee_id,
    fullname, directorate, role, grade, tgv_name, tv_name, baseline_score,
    user_score, tv_match_rate, tgv_match_rate, final_match_rate``.

    ``job_id`` keeps one job: the benchmark table is cut to it before the
    baselines are computed, so nothing is computed for the others.
    ``vectors`` are written trait vectors, else they are written here.
    """
    if job_id is not None:  # before the baselines: only this job's cohort is read
        t = t.with_benchmarks(t.talent_benchmarks.filter(F.col("job_vacancy_id") == job_id))
    vectors = vectors if vectors is not None else write_and_read(traits.trait_vectors(t), "trait_vectors")
    base = baseline if baseline is not None else baselines(t, include_tiki, vectors=vectors)
    if job_id is not None:
        base = base.filter(F.col("job_vacancy_id") == job_id)
    detail = traits.match_detail(vectors if include_tiki else traits.without_tiki(vectors), traits.job_sets(base, set_bytes), weights)
    return detail if job_id is None else detail.filter(F.col("job_vacancy_id") == job_id)


MATCHING_COLUMNS = [
    "job_vacancy_id", "employee_id", "directorate", "role", "grade", "tgv_name", "tv_name",
    "baseline_score", "user_score", "tv_match_rate", "tgv_match_rate", "final_match_rate",
]
RATE_COLUMNS = ["baseline_score", "user_score", "tv_match_rate", "tgv_match_rate", "final_match_rate"]


def rounded(detail: DataFrame, columns: list[str]) -> DataFrame:
    """Select ``columns``, rounding the score and rate columns to 2 places."""
    return detail.select(*[rnd(c, 2).alias(c) if c in RATE_COLUMNS else F.col(c) for c in columns])


DETAIL_COLUMNS = MATCHING_COLUMNS + ["fullname"]


def detail_view(detail: DataFrame) -> DataFrame:
    """The detail as the view presents it: names kept, scores and rates rounded."""
    return rounded(detail, DETAIL_COLUMNS)


def benchmark_matching(t: TalentTables, job_id: int | None = None, **kw) -> DataFrame:
    """The twelve-column detail view, scores and rates rounded to 2."""
    return rounded(matching_detail(t, job_id, **kw), MATCHING_COLUMNS)


def match_detail(t: TalentTables, job_id: int, limit: int | None = None, **kw) -> DataFrame:
    """One job's detail with the person's name, best final rate first (ties
    by id, group, trait); ``limit`` keeps that many TV rows, each task its own
    first ones (one scan of the vectors, no shuffle of rows)."""
    cols = ["employee_id", "fullname", "directorate", "role", "grade", "tgv_name", "tv_name"] + RATE_COLUMNS
    rows = rounded(matching_detail(t, job_id, **kw), cols).orderBy(F.col("final_match_rate").desc_nulls_first(), "employee_id", "tgv_name", "tv_name")
    return rows if limit is None else rows.limit(limit)
