"""Written intermediates: they follow their inputs, are built once, and go on release."""

import os
import shutil
from concurrent.futures import ThreadPoolExecutor

from helpers import SF_SMALL

from talentscope.operators import benchmark, match
from talentscope.plans import pipelines
from talentscope.plans.catalog import QUERIES
from talentscope.session import checkpoint_root


def _copy(tmp_path):
    for t in pipelines.SOURCE_TABLES:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_changed_inputs_change_the_answer(spark, tmp_path):
    d = _copy(tmp_path)
    before = QUERIES["latest_year"](spark, d).count()
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_custkey % 2 = 0").coalesce(1).write.parquet(f"{d}/half")
    part = next(f for f in os.listdir(f"{d}/half") if f.endswith(".parquet"))
    shutil.copyfile(f"{d}/half/{part}", f"{d}/orders.parquet")
    after = QUERIES["latest_year"](spark, d).count()
    want = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_custkey % 2 = 0").select("o_custkey").distinct().count()
    assert after == want < before


def test_threads_build_a_table_once(spark, tmp_path):
    d = _copy(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: pipelines.latest_for(spark, d).count(), range(4)))
    names = [k[-1] for k in pipelines._paths if k[1] == d.rstrip("/")]
    assert len(names) == len(set(names))


def test_release_leaves_no_file(spark, tmp_path):
    QUERIES["clean_competencies"](spark, SF_SMALL)
    QUERIES["match_detail_top"](spark, SF_SMALL).count()
    assert pipelines.release(spark) > 0
    root = checkpoint_root(spark).removeprefix("file://")
    left = [f for _, _, files in os.walk(os.path.join(root, "talentscope")) for f in files]
    assert left == []


def test_a_cohort_of_any_size(spark):
    ids = spark.range(150_000).selectExpr("concat('EMP', id) AS employee_id")
    t = pipelines.tables_for(spark, SF_SMALL)
    new = benchmark.set_cohort(t.talent_benchmarks, 1, ids)
    assert new.filter("job_vacancy_id = 1").selectExpr("size(selected_talent_ids) AS n").first().n == 150_000
    rows = benchmark.cohort_rows(1, ids)
    by_rows = match.baseline_table(t, cohort=rows)
    by_array = match.baseline_table(t.with_benchmarks(new.filter("job_vacancy_id = 1")))
    assert sorted(map(str, by_rows.collect())) == sorted(map(str, by_array.collect()))
