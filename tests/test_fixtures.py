"""Hand-computed fixtures (FIXTURES.md): each rule pinned on tiny inputs."""

from __future__ import annotations

import pytest
from helpers import bench, emp, psych, tables
from pyspark.sql import functions as F

from talentscope.functions import match_band, readiness_band, to_number, tv_match_rate
from talentscope.functions.text import fill_disc
from talentscope.operators import clean, eda, insight, match, quality, readiness
from talentscope.operators.benchmark import cohort_explode


# ------------------------------------------------------------ 2.1 TV rate
@pytest.mark.parametrize(
    "direction,baseline,score,expected",
    [
        ("higher", 4.0, 3.0, 75.0),
        ("higher", 4.0, 5.0, 100.0),
        ("higher", 4.0, -1.0, -25.0),
        ("higher", 4.0, None, 100.0),
        ("higher", 0.0, 3.0, None),
        ("higher", None, 3.0, None),
        ("lower", 4.0, 2.0, 100.0),
        ("lower", 4.0, 6.0, 50.0),
        ("lower", 4.0, 9.0, 0.0),
        ("lower", 4.0, None, 100.0),
    ],
)
def test_tv_match_rate(spark, direction, baseline, score, expected):
    df = spark.createDataFrame([(direction, baseline, score)], "d string, b double, u double")
    got = df.select(tv_match_rate("u", "b", "d").alias("r")).first()["r"]
    assert got == expected


# ------------------------------------------------------ 2.2 final match rate
@pytest.mark.parametrize(
    "rates,expected",
    [
        ({"Competencies": 80.0, "Cognitive": 90.0, "Context": 100.0, "BehaviorStrengths": 50.0}, 71.5),
        ({g: 100.0 for g in ["Competencies", "Cognitive", "PersonalityPAPI", "Context", "BehaviorStrengths"]}, 100.0),
        ({}, 0.0),
    ],
)
def test_final_match(spark, rates, expected):
    rows = [("E1", 1, g, r) for g, r in rates.items()] or [("E1", 1, "Competencies", None)]
    tgv = spark.createDataFrame(rows, "employee_id string, job_vacancy_id int, tgv_name string, tgv_match_rate double")
    assert match.match_final(tgv).first()["final_match_rate"] == expected


# ---------------------------------------------------------- 2.3 baseline
@pytest.mark.parametrize(
    "scores,ids,expected",
    [
        ({"A": 1.0, "B": 2.0, "C": 3.0, "D": 4.0}, ["A", "B", "C", "D"], 2.0),
        ({"A": 1.0, "B": 2.0, "C": None}, ["A", "B", "C"], 1.0),
        ({"A": None}, ["A"], None),
        ({"A": 1.0, "B": 3.0}, ["A", "B", "B"], 3.0),
    ],
)
def test_baseline_median(spark, scores, ids, expected):
    tv = spark.createDataFrame([(k, "Cognitive", "IQ", v, "higher") for k, v in scores.items()],
                               "employee_id string, tgv_name string, tv_name string, user_score double, direction string")
    cohort = spark.createDataFrame([(1, i) for i in ids], "job_vacancy_id int, employee_id string")
    assert match.match_baseline(tv, cohort).first()["baseline_score"] == expected


# ------------------------------------------------- 2.4 cohorts and job rows
def _match_tables(spark, benchmarks):
    return tables(
        spark,
        employees=[emp("E1"), emp("E2"), emp("E3")],
        performance_yearly=[("E1", 2024, 5.0), ("E2", 2024, 4.0), ("E3", 2024, 3.0)],
        profiles_psych=[psych("E1", 100.0, 30.0), psych("E2", 110.0, 40.0), psych("E3", 90.0, 20.0)],
        papi_scores=[("E1", "Papi_A", 5.0), ("E2", "Papi_A", 4.0), ("E3", "Papi_B", 7.0)],
        competencies_yearly=[("E1", 2024, "P1", 3.0), ("E2", 2024, "P1", 4.0), ("E3", 2024, "P1", 2.0)],
        strengths=[("E1", "T1", 3), ("E2", "T1", 5), ("E3", "T1", 9)],
        talent_benchmarks=benchmarks,
    )


def test_empty_unknown_and_null_cohorts_give_no_baseline(spark):
    t = _match_tables(spark, [bench(1, []), bench(2, ["NOPE"]), bench(3, None)])
    assert cohort_explode(t.talent_benchmarks).filter("job_vacancy_id in (1, 3)").count() == 0
    assert match.baselines(t, materialize=False).count() == 0
    d = match.matching_detail(t)
    assert d.filter(F.col("job_vacancy_id").isNotNull()).count() == 0
    # every TV row stays once with NULL job, NULL group and final rates
    assert d.filter(F.col("tgv_match_rate").isNotNull() | F.col("final_match_rate").isNotNull()).count() == 0


def test_two_jobs_and_trait_without_baseline(spark):
    t = _match_tables(spark, [bench(1, ["E1"]), bench(2, ["E1", "E2"])])
    d = match.matching_detail(t)
    rows = d.filter("employee_id = 'E3'").collect()
    # E3's IQ row appears once per job
    assert sorted(r["job_vacancy_id"] for r in rows if r["tv_name"] == "IQ") == [1, 2]
    # Papi_B: no cohort member has it -> one row, NULL job, NULL rates
    pb = [r for r in rows if r["tv_name"] == "Papi_B"]
    assert len(pb) == 1 and pb[0]["job_vacancy_id"] is None
    assert pb[0]["tv_match_rate"] is None and pb[0]["tgv_match_rate"] is None and pb[0]["final_match_rate"] is None
    # a one-person cohort: that person scores 100 on every trait of job 1
    e1 = d.filter("employee_id = 'E1' and job_vacancy_id = 1").collect()
    assert all(r["tv_match_rate"] == 100.0 for r in e1)
    assert e1[0]["final_match_rate"] == 100.0


def test_window_free_detail_equals_self_join_form(spark):
    """Group and final rates from the aggregate join equal the reference's
    tgv_match / final_match self-joins."""
    t = _match_tables(spark, [bench(1, ["E1", "E3"]), bench(2, ["E2"])])
    d = match.matching_detail(t).filter(F.col("job_vacancy_id").isNotNull())
    tv = match.tv_long(t)
    tvm = match.match_tv(tv, match.baselines(t, materialize=False))
    tgv = match.match_tgv(tvm)
    fin = match.match_final(tgv)
    ref = (tvm.join(tgv, ["employee_id", "job_vacancy_id", "tgv_name"], "left")
           .join(fin, ["employee_id", "job_vacancy_id"], "left")
           .filter(F.col("job_vacancy_id").isNotNull()))
    key = ["employee_id", "job_vacancy_id", "tgv_name", "tv_name"]

    def norm(df):
        return sorted((tuple(r[k] for k in key), round(r["tgv_match_rate"], 9) if r["tgv_match_rate"] is not None else None,
                       r["final_match_rate"]) for r in df.collect())

    assert norm(d) == norm(ref)


# ---------------------------------------------------------------- 2.5 readiness
def test_readiness_total_and_percent(spark):
    parts = spark.createDataFrame([(0.8, 0.5, 0.4, 1.0, 0.6), (0.8, None, 0.4, 1.0, 0.6)],
                                  "a double, b double, c double, d double, e double")
    from talentscope.functions import weighted_sum
    from talentscope.functions.numeric import rnd
    from talentscope.functions.scoring import TGV_WEIGHTS

    cols = dict(zip(TGV_WEIGHTS, [F.col(c) for c in "abcde"]))
    s = weighted_sum(cols, TGV_WEIGHTS, missing_as_zero=False)
    got = parts.select(rnd(s, 4).alias("f"), rnd(F.lit(100.0) * s, 2).alias("p")).collect()
    assert (got[0]["f"], got[0]["p"]) == (0.66, 66.0)
    assert (got[1]["f"], got[1]["p"]) == (None, None)


@pytest.mark.parametrize("pct,band", [(80.0, "Fast Track"), (79.99, "Ready"), (65.0, "Ready"), (64.99, "Watchlist"),
                                      (50.0, "Watchlist"), (49.99, "Develop"), (None, "Develop")])
def test_readiness_band(spark, pct, band):
    df = spark.createDataFrame([(pct,)], "p double")
    assert df.select(readiness_band("p").alias("b")).first()["b"] == band


def test_rank_null_first_and_percentile(spark):
    final = spark.createDataFrame(
        [("A", 2024, 0.9, 90.0), ("B", 2024, 0.9, 90.0), ("C", 2024, 0.5, 50.0), ("D", 2024, None, None)],
        "employee_id string, year int, finalmatch double, finalmatch_pct double")
    got = {r["employee_id"]: (r["rank_in_year"], r["percentile_in_year"])
           for r in readiness.readiness_ranked(final).collect()}
    assert got == {"A": (2, 75.0), "B": (2, 75.0), "C": (3, 25.0), "D": (1, 100.0)}


def test_equal_strength_ranks_null_part_and_missing_rows(spark):
    t = tables(
        spark,
        employees=[emp("E1"), emp("E2"), emp("E3")],
        performance_yearly=[("E1", 2024, 5.0), ("E2", 2024, 3.0)],  # E3 has no rating -> absent
        competencies_yearly=[("E1", 2024, "P1", 4.0), ("E2", 2023, "P1", 3.0)],  # E2 only in another year
        profiles_psych=[psych("E1", 100.0, 30.0), psych("E2", 110.0, 40.0), psych("E3", 90.0, 20.0)],
        papi_scores=[("E1", "Papi_A", 5.0), ("E2", "Papi_A", 4.0)],
        strengths=[("E1", "T1", 3), ("E2", "T1", 3)],
    )
    final = {r["employee_id"]: r for r in readiness.readiness_final(t).collect()}
    assert set(final) == {"E1", "E2"}
    assert all(r["tgv_behaviorstrengths"] is None and r["finalmatch"] is None for r in final.values())
    assert final["E2"]["tgv_competencies"] is None
    assert final["E1"]["tgv_competencies"] == 0.8 and final["E1"]["tgv_context"] == 1.0


# ----------------------------------------------------------------- 2.6 cleaning
def test_to_number(spark):
    vals = [" 5 ", "abc", "", "1e3", "5d", "NaN", "inf", "\t7\n", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["n"] for r in df.select(to_number("s").alias("n")).collect()]
    assert got == [5.0, None, None, 1000.0, None, None, None, 7.0, None]


def test_global_median(spark):
    raw = spark.createDataFrame([("E1", "2024", "3"), ("E2", "2024", "4"), ("E3", "2024", None)],
                                "employee_id string, year string, rating string")
    got = {r["employee_id"]: r["rating"] for r in clean.clean_performance(raw).collect()}
    assert got == {"E1": 3.0, "E2": 4.0, "E3": 3.5}


def test_pillar_median_fallback_and_half_even(spark):
    raw = spark.createDataFrame(
        [("E1", "2024", "P1", "2.0"), ("E2", "2024", "P1", "2.5"), ("E3", "2024", "P1", ""), ("E4", "2024", "P2", "x")],
        "employee_id string, year string, pillar_code string, score string")
    got = {r["employee_id"]: r["score"] for r in clean.clean_competencies(raw).collect()}
    assert got == {"E1": 2.0, "E2": 2.5, "E3": 2.2, "E4": 3.0}


@pytest.mark.parametrize("disc,word,expected", [(None, "Dominant-Influencer", "DI"), (None, "Foo", "Unknown"),
                                                ("S", "Dominant", "S"), ("", None, "Unknown"),
                                                ("Unknown", "steadiness, conscientious", "SC")])
def test_disc(spark, disc, word, expected):
    df = spark.createDataFrame([(disc, word)], "d string, w string")
    assert df.select(fill_disc("d", "w").alias("x")).first()["x"] == expected


def test_mbti_blank_is_unknown(spark):
    t = tables(spark, employees=[emp("E1"), emp("E2")],
               performance_yearly=[("E1", 2024, 5.0), ("E2", 2024, 5.0)],
               profiles_psych=[("E1", 1.0, 1.0, 1.0, 1.0, 1.0, "D", "Dominant", "  "),
                               ("E2", 1.0, 1.0, 1.0, 1.0, 1.0, "D", "Dominant", None)])
    got = {r["mbti"]: r["total_high_performers"] for r in eda.hp_by_profile(t, "mbti").collect()}
    assert got == {"Unknown": 2}


def test_duplicates_keep_every_copy(spark):
    df = spark.createDataFrame([("E1", 2024, "P1", 1.0), ("E1", 2024, "P1", 2.0), ("E2", 2024, "P1", 1.0)],
                               "employee_id string, year int, pillar_code string, score double")
    assert quality.duplicates(df, ["employee_id", "year", "pillar_code"]).count() == 2


def test_service_month_range(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (600.0,), (601.0,)], "m double")
    assert sorted(r["m"] for r in quality.range_violations(df, "m", 0, 600).collect()) == [-1.0, 601.0]


# ------------------------------------------------------- 2.7 counting variants
def test_counting_variants(spark):
    t = tables(spark, employees=[emp("E1")],
               performance_yearly=[("E1", 2024, 5.0), ("E1", 2024, 5.0), ("E2", 2024, 5.0)],
               dim_grades=[(1, "G1")])
    assert eda.hp_by_year(t).first()["total_high_performers"] == 3
    assert eda.hp_by_year(t, distinct=True).first()["total_high_performers"] == 2
    # E2 has no employee row: dropped by both grade variants
    assert eda.hp_by_dim(t, "grade").first()["total_high_performers"] == 2
    assert eda.hp_by_dim(t, "grade", distinct=True).first()["total_high_performers"] == 1


# ----------------------------------------------------------------- 2.8 insight
def test_candidate_insight_and_bands(spark):
    rates = {"Competencies": 90.0, "Context": 90.0, "Cognitive": 70.0, "PersonalityPAPI": None, "BehaviorStrengths": None}
    row = {"job_vacancy_id": 1, "employee_id": "E1"}
    row.update({f"_g_{g}": v for g, v in rates.items()} | {f"_c_{g}": int(v is not None) for g, v in rates.items()})
    groups = spark.createDataFrame([row], ", ".join(["job_vacancy_id int", "employee_id string"] + [f"_g_{g} double" for g in rates] + [f"_c_{g} long" for g in rates]))
    r = insight.candidate_insight(groups).first()
    assert (r["best_tgv"], r["worst_tgv"], r["strong_tgvs"], r["weak_tgvs"]) == (
        "Competencies", "Cognitive", "Competencies,Context", "Cognitive")
    df = spark.createDataFrame([(90.0,), (89.99,), (70.0,), (69.99,), (None,)], "r double")
    assert [x["b"] for x in df.select(match_band("r").alias("b")).collect()] == ["green", "amber", "amber", "red", "red"]


def test_row_without_pillar_takes_the_fallback(spark):
    raw = spark.createDataFrame(
        [("E1", "2024", "P1", "2.0"), ("E2", "2024", None, "4.0"), ("E3", "2024", None, "")],
        "employee_id string, year string, pillar_code string, score string")
    got = {r["employee_id"]: r["score"] for r in clean.clean_competencies(raw).collect()}
    assert got == {"E1": 2.0, "E2": 4.0, "E3": 3.0}


def test_approximate_medians_are_opt_in(spark):
    raw = spark.createDataFrame([("E1", "2024", "3"), ("E2", "2024", "4"), ("E3", "2024", None)],
                                "employee_id string, year string, rating string")
    exact = {r["employee_id"]: r["rating"] for r in clean.clean_performance(raw).collect()}
    approx = {r["employee_id"]: r["rating"] for r in clean.clean_performance(raw, exact=False).collect()}
    assert exact["E3"] == 3.5 and approx["E3"] in (3.0, 4.0)
