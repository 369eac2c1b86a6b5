"""The workflows a user runs, as bundles of lazy DataFrames.

Each function writes what several of its outputs share (trait vectors,
baselines, group rates, latest year, readiness totals) to the checkpoint
folder when it is called (``write_and_read``); the outputs themselves are
lazy and read those tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope.operators import benchmark, eda, insight, match, readiness, traits
from talentscope.operators.common import latest_year
from talentscope.plans.pipelines import cleaned_tables
from talentscope.session import write_and_read
from talentscope.sources.tables import TalentTables


def benchmark_report(t: TalentTables, job_id: int, detail_rows: int | None = None, top: int = 50,
                     distribution_top: int = 100) -> dict[str, DataFrame]:
    """Re-run one job's benchmark: the detail listing, the ranked list, the
    match-rate distribution and every per-candidate view, for all of the
    job's candidates.  Nothing is computed for other jobs.  ``detail_rows``
    cuts the detail listing, which is whole by default; ranked lists keep
    people with a missing name or dimension."""
    one = t.with_benchmarks(t.talent_benchmarks.filter(F.col("job_vacancy_id") == job_id))
    vectors = write_and_read(traits.trait_vectors(t), "trait_vectors")
    sets = traits.job_sets(match.baselines(one, vectors=vectors))
    mine = F.col("job_vacancy_id") == job_id
    groups = write_and_read(traits.match_groups(vectors, sets).filter(mine), f"groups_job_{job_id}")
    detail = match.detail_view(traits.match_detail(vectors, sets).filter(mine))
    ranked = insight.ranked_talent(groups, keep_missing_dims=True)
    cols = ["employee_id", "fullname", "directorate", "role", "grade", "tgv_name", "tv_name"] + match.RATE_COLUMNS
    listing = detail.select(*cols).orderBy(F.col("final_match_rate").desc_nulls_first(), "employee_id", "tgv_name", "tv_name")
    return {
        "detail": listing if detail_rows is None else listing.limit(detail_rows),
        "ranked": insight.top_per_job(ranked, top),
        "distribution": insight.match_distribution(ranked, distribution_top),
        "tv_bands": insight.candidate_tv_bands(detail),
        "tgv_profile": insight.candidate_tgv_profile(groups),
        "insight": insight.candidate_insight(groups),
        "job_summary": insight.job_tgv_summary(groups),
        "top_bottom_tvs": insight.candidate_top_bottom_tvs(detail),
        "evidence": insight.candidate_evidence_json(detail, groups),
    }


def create_and_run_benchmark(t: TalentTables, role_name: str, job_level: str, role_purpose: str,
                             talent_ids: DataFrame, created_at: dt.datetime | None = None,
                             **report_kw) -> tuple[DataFrame, int, dict[str, DataFrame]]:
    """Add a job with the given role models, then run its report.

    Returns the new benchmark table (write it with ``save_tables`` or
    ``export``), the new job id and the report."""
    created_at = created_at or dt.datetime.now().replace(microsecond=0)
    new = write_and_read(benchmark.create_benchmark(t.talent_benchmarks, role_name, job_level, role_purpose,
                                                    talent_ids, created_at), "talent_benchmarks")
    job_id = new.agg(F.max("job_vacancy_id")).first()[0]
    return new, job_id, benchmark_report(t.with_benchmarks(new), job_id, **report_kw)


def readiness_dashboard(t: TalentTables, k: int = 3) -> dict[str, DataFrame]:
    """Readiness totals, ranks, shortlist and the three band summaries."""
    latest = write_and_read(latest_year(t.performance_yearly), "latest_year")
    final = write_and_read(readiness.readiness_final(t, latest), "readiness_final")
    ranked = write_and_read(readiness.readiness_ranked(final), "readiness_ranked")
    return {
        "ranked": ranked,
        "shortlist": readiness.shortlist(ranked, t, k),
        "latest": readiness.readiness_summary_latest(ranked),
        "by_year": readiness.readiness_summary_by_year(ranked),
        "by_division": readiness.readiness_summary_by_division(ranked, t),
    }


def score_raw(t: TalentTables, job_id: int | None = None) -> dict[str, DataFrame]:
    """From raw exports to scores: clean, then the readiness dashboard and,
    with a job, its benchmark report."""
    cleaned = cleaned_tables(t, lambda name, df: write_and_read(df, name))
    out = {f"readiness_{k}": v for k, v in readiness_dashboard(cleaned).items()}
    if job_id is not None:
        out.update({f"match_{k}": v for k, v in benchmark_report(cleaned, job_id).items()})
    return out


def high_performer_profile(t: TalentTables, distinct: bool = True) -> dict[str, DataFrame]:
    """What rating-5 people have in common (notebook counting when
    ``distinct``, SQL counting otherwise)."""
    out = {
        "by_year": eda.hp_by_year(t, distinct),
        "by_grade": eda.hp_by_dim(t, "grade", distinct),
        "by_division": eda.hp_by_dim(t, "division", distinct),
        "by_education": eda.hp_by_dim(t, "education", distinct),
        "by_disc": eda.hp_by_profile(t, "disc_word", distinct),
        "by_mbti": eda.hp_by_profile(t, "mbti", distinct),
    }
    if distinct:
        values = eda.hp_psych_values(t, ["iq", "gtq"])
        out.update({
            "iq_gtq": eda.hp_score_summary(t, ["iq", "gtq"]),
            "tiki": eda.hp_score_summary(t, ["tiki"]),
            "pillars": eda.hp_pillar_avg(t),
            "pillars_vs_rating": eda.hp_pillar_vs_rating(t),
            "top_n": eda.hp_top_n(t),
            "histogram": eda.histogram(values, ["iq", "gtq"]),
            "box": eda.box_stats(values, ["iq", "gtq"]),
        })
    else:
        out.update({
            "iq_gtq": eda.iq_gtq_summary(t),
            "tiki": eda.tiki_summary(t),
            "pillars": eda.pillar_avg_latest(t),
            "pillars_vs_rating": eda.pillar_vs_rating(t),
        })
    return out
