"""Invariants on the driver's smallest tables."""

from helpers import SF_SMALL
from pyspark.sql import functions as F

from talentscope.plans.catalog import QUERIES
from talentscope.plans.pipelines import matching_detail_for


def test_readiness_parts_are_between_zero_and_one(spark):
    df = QUERIES["readiness_final"](spark, SF_SMALL)
    parts = ["tgv_competencies", "tgv_cognitive", "tgv_personalitypapi", "tgv_context", "tgv_behaviorstrengths"]
    bad = df.filter(" OR ".join(f"({p} < 0 OR {p} > 1)" for p in parts)).count()
    assert bad == 0


def test_band_shares_sum_to_one_hundred(spark):
    for name, by in [("readiness_by_year", "year"), ("readiness_by_division", "division_name")]:
        col = "pct_of_total" if name == "readiness_by_year" else "pct_within_division"
        sums = QUERIES[name](spark, SF_SMALL).groupBy(by).agg(F.sum(col).alias("s")).collect()
        assert sums and all(abs(r["s"] - 100.0) <= 0.05 for r in sums), name
    total = QUERIES["readiness_latest"](spark, SF_SMALL).agg(F.sum("pct_of_total")).first()[0]
    assert abs(total - 100.0) <= 0.05


def test_rates_are_at_most_one_hundred(spark):
    d = matching_detail_for(spark, SF_SMALL)
    assert d.filter((F.col("tv_match_rate") > 100) | (F.col("final_match_rate") > 100)).count() == 0
    lower = d.filter(F.col("tv_name") == "StrengthsRankAvg")
    assert lower.filter(F.col("tv_match_rate") < 0).count() == 0


def test_score_equal_to_baseline_scores_one_hundred(spark):
    d = matching_detail_for(spark, SF_SMALL).filter(
        (F.col("user_score") == F.col("baseline_score")) & (F.col("baseline_score") > 0))
    assert d.count() > 0
    assert d.filter(F.col("tv_match_rate") != 100.0).count() == 0


def test_final_rate_is_the_weighted_group_rates(spark):
    d = matching_detail_for(spark, SF_SMALL).filter(F.col("job_vacancy_id").isNotNull())
    w = {"Competencies": 0.4, "Cognitive": 0.3, "PersonalityPAPI": 0.15, "Context": 0.1, "BehaviorStrengths": 0.05}
    g = d.groupBy("employee_id", "job_vacancy_id").agg(
        F.first("final_match_rate").alias("f"),
        *[F.coalesce(F.max(F.when(F.col("tgv_name") == k, F.col("tgv_match_rate"))), F.lit(0.0)).alias(k) for k in w])
    expr = sum(F.col(k) * v for k, v in w.items())
    assert g.filter(F.abs(F.col("f") - expr) > 0.006).count() == 0
