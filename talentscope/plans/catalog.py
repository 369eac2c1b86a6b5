"""Named queries: one per operator of the survey's inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the talent
tables derived from that folder.  Shared intermediates (the talent tables,
traits, baselines, group rates) are written when the query is built, and
sides to broadcast are measured then; the rest runs with the caller's action.  Column names and types are
fixed here (counts and ranks ``bigint``, scores ``double``) so results
compare one-to-one with the SQL oracle in ``talentscope.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd
from talentscope.operators import benchmark, clean, eda, insight, match, quality, readiness, traits
from talentscope.plans.pipelines import (
    baselines_for,
    clean_competencies_for,
    cleaned_for,
    latest_for,
    job_sets_for,
    match_groups_for,
    matching_detail_for,
    readiness_final_for,
    readiness_ranked_for,
    tables_for,
    vectors_for,
)
from talentscope.plans.store import BenchmarkStore
from talentscope.session import released_path, write_and_read
from talentscope.sources import read_raw_checked, schemas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The benchmark the "create" queries add.
NEW_ROLE = ("Route Planner", "Grade IV", "Plan delivery routes that hold in bad weather.")
NEW_CREATED_AT = dt.datetime(2025, 2, 1, 10, 0, 0)


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, d):
    return tables_for(spark, d)


# ---------------------------------------------------------------- benchmarks

def _created(spark, d) -> benchmark.BenchmarkTables:
    t = _t(spark, d)
    chosen = benchmark.cohort_candidates(t.performance_yearly, n=3)
    return benchmark.add_job(benchmark.split_benchmarks(t.talent_benchmarks), *NEW_ROLE, talent_ids=chosen, created_at=NEW_CREATED_AT)


@query("benchmark_create")
def q_benchmark_create(spark, d):
    b = _created(spark, d)
    return benchmark.cohort_summary(benchmark.export_benchmarks(b)).join(
        b.jobs.select("job_vacancy_id", "role_name", "job_level",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")), "job_vacancy_id")


@query("benchmark_set_cohort")
def q_benchmark_set_cohort(spark, d):
    t = _t(spark, d)
    b = benchmark.replace_cohort(benchmark.split_benchmarks(t.talent_benchmarks), 1, benchmark.cohort_candidates(t.performance_yearly, n=50))
    return benchmark.cohort_summary(benchmark.export_benchmarks(b))


@query("benchmark_recent")
def q_benchmark_recent(spark, d):
    return benchmark.recent_benchmarks(_created(spark, d).jobs, 25)


@query("employee_directory")
def q_employee_directory(spark, d):
    return benchmark.employee_directory(_t(spark, d))


@query("cohort_candidates")
def q_cohort_candidates(spark, d):
    return benchmark.cohort_candidates(_t(spark, d).performance_yearly, n=20)


@query("cohort_explode")
def q_cohort_explode(spark, d):
    return benchmark.cohort_explode(_t(spark, d).talent_benchmarks)


# ------------------------------------------------------------------ cleaning

@query("clean_numeric_coerce")
def q_clean_numeric_coerce(spark, d):
    return clean.clean_employees(_t(spark, d).raw_employees)


@query("clean_performance")
def q_clean_performance(spark, d):
    return clean.clean_performance(_t(spark, d).raw_performance_yearly)


@query("raw_rejects")
def q_raw_rejects(spark, d):
    """Lines of a raw competency export by their number of fields.

    The export is planted with ragged lines: ids ending in 7 lack the score, ids ending in 13 carry a field more.
    """
    names = schemas.COMPETENCIES_YEARLY.names
    field = [F.coalesce(F.col(c), F.lit("")) for c in names]
    line = (F.when(F.col("employee_id").endswith("7"), F.concat_ws(",", *field[:-1]))
            .when(F.col("employee_id").endswith("13"), F.concat_ws(",", *field, F.lit("more")))
            .otherwise(F.concat_ws(",", *field)))
    path = released_path(spark, "ragged_export")
    _t(spark, d).raw_competencies_yearly.select(line).write.text(path)
    checked = read_raw_checked(spark, path, schemas.COMPETENCIES_YEARLY, header=False)
    fit = checked.fitting.select(F.lit(True).alias("fits"), F.lit(len(names)).alias("n_fields"), "employee_id")
    return (fit.union(checked.rejected.select(F.lit(False), "n_fields", F.substring_index("line", ",", 1)))
            .groupBy("fits", "n_fields").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("employee_id").alias("n_people")))


@query("clean_competencies")
def q_clean_competencies(spark, d):
    return clean.clean_competencies(_t(spark, d).raw_competencies_yearly)


@query("clean_profiles")
def q_clean_profiles(spark, d):
    return clean.clean_profiles(_t(spark, d).raw_profiles_psych)


@query("clean_disc")
def q_clean_disc(spark, d):
    return clean.clean_disc(_t(spark, d).raw_profiles_psych)


@query("clean_papi")
def q_clean_papi(spark, d):
    return clean.clean_papi(_t(spark, d).raw_papi_scores)


# ------------------------------------------------------------------- quality

@query("dq_missing")
def q_dq_missing(spark, d):
    return quality.missing_report(_t(spark, d).raw_employees)


@query("dq_missing_before_after")
def q_dq_missing_before_after(spark, d):
    raw = _t(spark, d).raw_competencies_yearly
    return quality.missing_before_after(raw, clean.clean_competencies(raw), "score")


@query("dq_duplicates")
def q_dq_duplicates(spark, d):
    return quality.duplicates(clean_competencies_for(spark, d), ["employee_id", "year", "pillar_code"])


@query("dq_key_uniqueness")
def q_dq_key_uniqueness(spark, d):
    return quality.key_uniqueness(_t(spark, d).raw_employees, "employee_id")


@query("dq_range")
def q_dq_range(spark, d):
    emps = clean.clean_employees(_t(spark, d).raw_employees)
    return quality.range_violations(emps, "years_of_service_months", 0, 600).select(
        "employee_id", "fullname", "years_of_service_months")


@query("dq_missing_fk")
def q_dq_missing_fk(spark, d):
    emps = clean.clean_employees(_t(spark, d).raw_employees)
    return quality.missing_reference(emps, "grade_id", ["employee_id", "fullname"])


@query("dq_describe")
def q_dq_describe(spark, d):
    emps = clean.clean_employees(_t(spark, d).raw_employees)
    return quality.describe(emps, clean.EMPLOYEE_NUMERIC, [c for c in emps.columns if c not in clean.EMPLOYEE_NUMERIC])


# ----------------------------------------------------------------------- EDA

@query("latest_year")
def q_latest_year(spark, d):
    return latest_for(spark, d)


@query("hp_by_year")
def q_hp_by_year(spark, d):
    return eda.hp_by_year(_t(spark, d))


@query("hp_by_grade")
def q_hp_by_grade(spark, d):
    return eda.hp_by_dim(_t(spark, d), "grade")


@query("hp_by_division")
def q_hp_by_division(spark, d):
    return eda.hp_by_dim(_t(spark, d), "division")


@query("hp_by_education")
def q_hp_by_education(spark, d):
    return eda.hp_by_dim(_t(spark, d), "education")


@query("hp_by_disc")
def q_hp_by_disc(spark, d):
    return eda.hp_by_profile(_t(spark, d), "disc_word")


@query("hp_by_mbti")
def q_hp_by_mbti(spark, d):
    return eda.hp_by_profile(_t(spark, d), "mbti")


@query("iq_gtq_summary")
def q_iq_gtq_summary(spark, d):
    return eda.iq_gtq_summary(_t(spark, d))


@query("tiki_summary")
def q_tiki_summary(spark, d):
    return eda.tiki_summary(_t(spark, d))


@query("pillar_avg_latest")
def q_pillar_avg_latest(spark, d):
    return eda.pillar_avg_latest(_t(spark, d))


@query("pillar_vs_rating")
def q_pillar_vs_rating(spark, d):
    return eda.pillar_vs_rating(_t(spark, d))


@query("high_performers")
def q_high_performers(spark, d):
    from talentscope.operators.common import high_performers
    return high_performers(_t(spark, d).performance_yearly)


@query("hpd_by_year")
def q_hpd_by_year(spark, d):
    return eda.hp_by_year(_t(spark, d), distinct=True)


@query("hpd_by_grade")
def q_hpd_by_grade(spark, d):
    return eda.hp_by_dim(_t(spark, d), "grade", distinct=True)


@query("hpd_by_division")
def q_hpd_by_division(spark, d):
    return eda.hp_by_dim(_t(spark, d), "division", distinct=True)


@query("hpd_by_education")
def q_hpd_by_education(spark, d):
    return eda.hp_by_dim(_t(spark, d), "education", distinct=True)


@query("hpd_by_disc")
def q_hpd_by_disc(spark, d):
    return eda.hp_by_profile(_t(spark, d), "disc_word", distinct=True)


@query("hpd_by_mbti")
def q_hpd_by_mbti(spark, d):
    return eda.hp_by_profile(_t(spark, d), "mbti", distinct=True)


@query("hp_iq_gtq_summary")
def q_hp_iq_gtq_summary(spark, d):
    return eda.hp_score_summary(_t(spark, d), ["iq", "gtq"])


@query("hp_tiki_summary")
def q_hp_tiki_summary(spark, d):
    return eda.hp_score_summary(_t(spark, d), ["tiki"])


@query("hp_pillar_avg")
def q_hp_pillar_avg(spark, d):
    return eda.hp_pillar_avg(_t(spark, d))


@query("hp_pillar_vs_rating")
def q_hp_pillar_vs_rating(spark, d):
    return eda.hp_pillar_vs_rating(_t(spark, d))


@query("hp_counts")
def q_hp_counts(spark, d):
    return eda.hp_counts(_t(spark, d))


@query("hp_top_n")
def q_hp_top_n(spark, d):
    return eda.hp_top_n(_t(spark, d)).withColumn("rank_in_dimension", F.col("rank_in_dimension").cast("long"))


@query("score_histogram")
def q_score_histogram(spark, d):
    return eda.histogram(eda.hp_psych_values(_t(spark, d), ["iq", "gtq"]), ["iq", "gtq"], bins=20)


@query("score_box_stats")
def q_score_box_stats(spark, d):
    return eda.box_stats(eda.hp_psych_values(_t(spark, d), ["iq", "gtq"]), ["iq", "gtq"])


# ----------------------------------------------------------------- readiness

@query("tgv_competencies")
def q_tgv_competencies(spark, d):
    return readiness.tgv_competencies(_t(spark, d), latest_for(spark, d))


@query("tgv_cognitive")
def q_tgv_cognitive(spark, d):
    return readiness.tgv_cognitive(_t(spark, d), latest_for(spark, d))


@query("tgv_personality")
def q_tgv_personality(spark, d):
    return readiness.tgv_personality(_t(spark, d), latest_for(spark, d))


@query("tgv_context")
def q_tgv_context(spark, d):
    return readiness.tgv_context(_t(spark, d), latest_for(spark, d))


@query("tgv_strengths")
def q_tgv_strengths(spark, d):
    return readiness.tgv_strengths(_t(spark, d), latest_for(spark, d))


@query("readiness_final")
def q_readiness_final(spark, d):
    return readiness_final_for(spark, d)


@query("readiness_ranked")
def q_readiness_ranked(spark, d):
    return readiness_ranked_for(spark, d)


@query("shortlist_top3")
def q_shortlist_top3(spark, d):
    return readiness.shortlist(readiness_ranked_for(spark, d), _t(spark, d), k=3)


@query("readiness_latest")
def q_readiness_latest(spark, d):
    return readiness.readiness_summary_latest(readiness_ranked_for(spark, d))


@query("readiness_by_year")
def q_readiness_by_year(spark, d):
    return readiness.readiness_summary_by_year(readiness_ranked_for(spark, d))


@query("readiness_by_division")
def q_readiness_by_division(spark, d):
    return readiness.readiness_summary_by_division(readiness_ranked_for(spark, d), _t(spark, d))


# --------------------------------------------------------------------- match

@query("tv_long")
def q_tv_long(spark, d):
    return traits.tv_rows(vectors_for(spark, d)).withColumn("user_score", rnd("user_score", 4))


@query("match_baseline")
def q_match_baseline(spark, d):
    return baselines_for(spark, d)


@query("match_tv")
def q_match_tv(spark, d):
    return traits.match_tv(vectors_for(spark, d), job_sets_for(spark, d)).select(
        "employee_id", "job_vacancy_id", "tgv_name", "tv_name",
        rnd("baseline_score", 2).alias("baseline_score"), rnd("user_score", 2).alias("user_score"),
        rnd("tv_match_rate", 2).alias("tv_match_rate"))


@query("match_tgv")
def q_match_tgv(spark, d):
    return match.tgv_from_groups(match_groups_for(spark, d)).withColumn("tgv_match_rate", rnd("tgv_match_rate", 2))


@query("match_final")
def q_match_final(spark, d):
    return match.final_from_groups(match_groups_for(spark, d))


@query("match_final_no_tiki")
def q_match_final_no_tiki(spark, d):
    return match.final_from_groups(match_groups_for(spark, d, include_tiki=False))


@query("benchmark_matching")
def q_benchmark_matching(spark, d):
    return match.rounded(matching_detail_for(spark, d), match.MATCHING_COLUMNS)


@query("match_detail_top")
def q_match_detail_top(spark, d):
    return match.match_detail(_t(spark, d), 1, limit=500, vectors=vectors_for(spark, d))


# ------------------------------------------------------------------- insight

def _detail(spark, d):
    return match.detail_view(matching_detail_for(spark, d))


def _ranked(spark, d):
    return insight.ranked_talent(match_groups_for(spark, d))


@query("ranked_talent")
def q_ranked_talent(spark, d):
    return _ranked(spark, d)


@query("ranked_talent_all")
def q_ranked_talent_all(spark, d):
    """The ranked list with the people whose name or dimensions are missing."""
    return insight.ranked_talent(match_groups_for(spark, d), keep_missing_dims=True)


@query("ranked_talent_top50")
def q_ranked_talent_top50(spark, d):
    return insight.top_per_job(_ranked(spark, d), 50)


@query("benchmark_create_ranked")
def q_benchmark_create_ranked(spark, d):
    """Create a job, score everyone against it, list its best 50."""
    t = _t(spark, d)
    created = _created(spark, d)
    new_id = created.jobs.agg(F.max("job_vacancy_id")).first()[0]
    vectors = vectors_for(spark, d)
    base = match.baselines(t, cohort=created.cohorts.filter(F.col("job_vacancy_id") == new_id), vectors=vectors)
    groups = traits.match_groups(vectors, traits.job_sets(base))
    return insight.top_per_job(insight.ranked_talent(groups), 50)


@query("benchmark_refresh_ranked")
def q_benchmark_refresh_ranked(spark, d):
    """Replace one job's cohort in a store, refresh that job alone, list its best 50 from its partition."""
    t = _t(spark, d)
    store = BenchmarkStore.create(spark, released_path(spark, "benchmark_store"), t, vectors_for(spark, d))
    store.set_cohort(1, benchmark.cohort_candidates(t.performance_yearly, n=50))
    return insight.top_per_job(insight.ranked_talent(store.groups(1)), 50)


@query("match_distribution")
def q_match_distribution(spark, d):
    return insight.match_distribution(_ranked(spark, d), 100)


@query("candidate_tv_bands")
def q_candidate_tv_bands(spark, d):
    return insight.candidate_tv_bands(_detail(spark, d))


@query("candidate_tgv_profile")
def q_candidate_tgv_profile(spark, d):
    return insight.candidate_tgv_profile(match_groups_for(spark, d))


@query("candidate_insight")
def q_candidate_insight(spark, d):
    return insight.candidate_insight(match_groups_for(spark, d))


@query("job_tgv_summary")
def q_job_tgv_summary(spark, d):
    return insight.job_tgv_summary(match_groups_for(spark, d))


@query("candidate_top_bottom_tvs")
def q_candidate_top_bottom_tvs(spark, d):
    return insight.candidate_top_bottom_tvs(_detail(spark, d))


@query("candidate_evidence_json")
def q_candidate_evidence_json(spark, d):
    return insight.candidate_evidence_json(_detail(spark, d), match_groups_for(spark, d))


# -------------------------------------------------------- raw to clean to score

@query("readiness_from_raw")
def q_readiness_from_raw(spark, d):
    return readiness.readiness_final(cleaned_for(spark, d))


@query("match_from_raw")
def q_match_from_raw(spark, d):
    t = cleaned_for(spark, d)
    vectors = write_and_read(traits.trait_vectors(t), "trait_vectors")
    return match.final_from_groups(traits.match_groups(vectors, traits.job_sets(match.baselines(t, vectors=vectors))))
