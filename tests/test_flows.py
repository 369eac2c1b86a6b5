"""The user workflows run end to end and agree with the named queries."""

import datetime as dt

from helpers import SF_SMALL

from talentscope.operators import insight
from talentscope.operators.benchmark import cohort_candidates
from talentscope.plans import flows
from talentscope.plans.catalog import NEW_ROLE, QUERIES
from talentscope.plans.pipelines import tables_for


def _texts(df):
    return sorted(str(tuple(r)) for r in df.collect())


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_benchmark_report_matches_queries(spark):
    """Every part of the one-job report equals the all-jobs query cut to the job."""
    t = tables_for(spark, SF_SMALL)
    rep = flows.benchmark_report(t, 1)
    assert _rows(flows.benchmark_report(t, 1, detail_rows=500)["detail"]) == _rows(QUERIES["match_detail_top"](spark, SF_SMALL))
    job = lambda name: QUERIES[name](spark, SF_SMALL).filter("job_vacancy_id = 1")
    assert rep["detail"].count() == job("benchmark_matching").count()
    ranked = job("ranked_talent_all")
    assert _rows(rep["ranked"]) == _rows(insight.top_per_job(ranked, 50))
    for name, query in [("tv_bands", "candidate_tv_bands"), ("tgv_profile", "candidate_tgv_profile"), ("insight", "candidate_insight"),
                        ("job_summary", "job_tgv_summary"), ("top_bottom_tvs", "candidate_top_bottom_tvs"), ("evidence", "candidate_evidence_json")]:
        assert _texts(rep[name]) == _texts(job(query)), name


def test_raw_to_scores(spark):
    t = tables_for(spark, SF_SMALL)
    out = flows.score_raw(t, job_id=1)
    want = QUERIES["readiness_from_raw"](spark, SF_SMALL)
    assert _texts(out["readiness_ranked"].select(want.columns)) == _texts(want)
    best = {r.employee_id: r.final_match_rate for r in QUERIES["match_from_raw"](spark, SF_SMALL).filter("job_vacancy_id = 1").collect()}
    assert all(best[r.employee_id] == r.final_match_rate for r in out["match_ranked"].collect())


def test_create_and_run_benchmark(spark):
    t = tables_for(spark, SF_SMALL)
    new, job_id, rep = flows.create_and_run_benchmark(
        t, *NEW_ROLE,
        cohort_candidates(t.performance_yearly, n=3), created_at=dt.datetime(2025, 2, 1, 10, 0, 0))
    assert job_id == 8 and new.count() == 8
    whole = {r.employee_id: r.final_match_rate for r in rep["ranked"].collect()}
    listed = {r.employee_id: r.final_match_rate for r in QUERIES["benchmark_create_ranked"](spark, SF_SMALL).collect()}
    assert all(whole[e] == rate for e, rate in listed.items() if e in whole) and len(set(whole) & set(listed)) > 40


def test_readiness_dashboard_and_profile(spark):
    t = tables_for(spark, SF_SMALL)
    dash = flows.readiness_dashboard(t)
    assert _rows(dash["shortlist"]) == _rows(QUERIES["shortlist_top3"](spark, SF_SMALL))
    prof = flows.high_performer_profile(t)
    assert _rows(prof["top_n"]) == _rows(QUERIES["hp_top_n"](spark, SF_SMALL))
    assert set(flows.high_performer_profile(t, distinct=False)) >= {"by_grade", "pillars_vs_rating"}
