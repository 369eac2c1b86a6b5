"""Plan checks: the physical plans have the shape the design relies on."""

from helpers import SF_SMALL

from talentscope.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_anywhere(spark):
    for name, q in QUERIES.items():
        p = plan(q(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_shortlist_limits_before_the_shuffle(spark):
    p = QUERIES["shortlist_top3"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_rank_histogram_is_broadcast(spark):
    from talentscope.operators.readiness import readiness_ranked
    from talentscope.plans.pipelines import readiness_final_for

    p = plan(readiness_ranked(readiness_final_for(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_one_job_listing_builds_one_job(spark):
    """The one-job listing reads the written trait vectors, cuts the benchmark
    table to the job before the baselines, and ends in a per-task top-k."""
    from talentscope import session

    before = len(session._written)
    p = plan(QUERIES["match_detail_top"](spark, SF_SMALL))
    made = [m for m in session._written[before:] if m.endswith("baselines")]
    assert len(made) == 1
    assert {r.job_vacancy_id for r in spark.read.parquet(made[0]).select("job_vacancy_id").distinct().collect()} == {1}
    assert "TakeOrderedAndProject(limit=500" in p and "Exchange hashpartitioning" not in p


def test_created_job_reads_the_vectors_once(spark):
    p = plan(QUERIES["benchmark_create_ranked"](spark, SF_SMALL))
    assert p.count("trait_vectors") <= 2 and p.count("FileScan") <= 4, p.count("FileScan")


def test_trait_views_scan_vectors_without_a_shuffle(spark):
    """No join on trait names and no fan-out before a shuffle, also with broadcasts off."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            for name, most in [("match_tv", 0), ("benchmark_matching", 0), ("candidate_tv_bands", 0), ("candidate_top_bottom_tvs", 1), ("tv_long", 0)]:
                p = plan(QUERIES[name](spark, SF_SMALL))
                assert len([ln for ln in p.split("\n") if "Exchange hashpartitioning" in ln and "employee_id" in ln]) <= most, name
                assert "SortMergeJoin" not in p and "HashJoin" not in p, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scans_prune_columns(spark):
    p = plan(QUERIES["hp_by_grade"](spark, SF_SMALL))
    assert "ReadSchema: struct<employee_id:string,rating:double>" in p
    assert "PushedFilters: [IsNotNull(rating), EqualTo(rating,5.0)" in p


def test_competency_scores_are_summed_before_the_latest_year_join(spark):
    p = plan(QUERIES["tgv_competencies"](spark, SF_SMALL))
    join = p.index("Join")
    assert p.count("partial_sum(score") == 1 and p.index("partial_sum(score") > join  # below the join


def test_candidate_views_shuffle_at_most_once(spark):
    for name, most in [("ranked_talent", 0), ("candidate_tgv_profile", 0), ("candidate_insight", 0), ("match_tgv", 0), ("match_final", 0),
                       ("candidate_top_bottom_tvs", 1)]:
        assert plan(QUERIES[name](spark, SF_SMALL)).count("Exchange hashpartitioning") <= most, name


def test_group_aggregates_are_broadcast_back(spark):
    """Per-pillar / per-scale aggregates are joined back by broadcast: no
    sort-merge join that would shuffle rows by a key with a few values."""
    from talentscope.operators import readiness
    from talentscope.plans.pipelines import tables_for

    t = tables_for(spark, SF_SMALL)
    for name in ["clean_competencies", "clean_papi", "dq_duplicates"]:
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "SortMergeJoin [pillar_code" not in p and "SortMergeJoin [scale_code" not in p, name
    p = plan(readiness.tgv_personality(t))
    assert "SortMergeJoin [scale_code" not in p and "BroadcastHashJoin [scale_code" in p


def test_raw_texts_are_parsed_once(spark):
    """The medians' passes and the fill read written numbers, not the raw export's texts."""
    from talentscope.operators import clean
    from talentscope.plans.pipelines import tables_for

    t = tables_for(spark, SF_SMALL)
    for build, raw in [(clean.clean_performance, t.raw_performance_yearly), (clean.clean_competencies, t.raw_competencies_yearly),
                       (clean.clean_profiles, t.raw_profiles_psych), (clean.clean_papi, t.raw_papi_scores)]:
        df = build(raw)
        read = {f.split("/")[-2] for f in df.inputFiles()}
        assert "RLIKE" not in plan(df).upper() and any(r.startswith("parsed_") for r in read) and not any(r.startswith(("performance", "competencies", "profiles", "papi")) for r in read), build.__name__


def test_numbers_with_white_space_around(spark):
    from talentscope.functions.numeric import to_number

    pads, texts = ["", " ", "\n", "\r\n", "\u0085", " ", " ", " \t"], ["5", "-.5", "1e3", "5d", "NaN", "", "5 5"]
    rows = [(a + x + b,) for x in texts for a in pads for b in pads]
    got = {r.x: r.y for r in spark.createDataFrame(rows, "x string").select("x", to_number("x").alias("y")).collect()}
    number = {"5": 5.0, "-.5": -0.5, "1e3": 1000.0}
    for (x,) in rows:
        assert got[x] == number.get(x.strip(" \t\n\r")), repr(x)


def test_older_years_go_before_rows_are_collected(spark):
    from talentscope.operators import traits
    from talentscope.plans.pipelines import tables_for

    p = traits.trait_vectors(tables_for(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in p and p.index("collect_list") < p.index("Join LeftSemi")  # below the aggregate
