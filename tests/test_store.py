"""Benchmarks as tables: cohorts of any size, results refreshed per job."""

import os

from helpers import bench, emp, psych, tables
from pyspark.sql import functions as F

from talentscope.operators import benchmark, match, traits
from talentscope.plans.store import BenchmarkStore
from talentscope.session import write_and_read


def _tables(spark):
    people = [f"E{i}" for i in range(12)]
    return tables(
        spark, employees=[emp(p) for p in people], performance_yearly=[(p, 2024, float(1 + i % 5)) for i, p in enumerate(people)],
        profiles_psych=[psych(p, 90.0 + i, 20.0 + i % 7) for i, p in enumerate(people)], papi_scores=[(p, "S", float(1 + i % 9)) for i, p in enumerate(people)],
        talent_benchmarks=[bench(1, ["E0", "E5"]), bench(2, ["E3", "E4"]), bench(3, [])])


def _files(path, name):
    """job -> its files and when they were written"""
    out = {}
    for d, _, names in os.walk(os.path.join(path, name)):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.basename(d), {})[n] = os.stat(os.path.join(d, n)).st_mtime_ns
    return out


def _plain(rows):
    return sorted(map(str, (sorted(r.asDict().items()) for r in rows.collect())))


def test_only_the_changed_job_is_rewritten(spark, tmp_path):
    t, path = _tables(spark), str(tmp_path / "store")
    vectors = write_and_read(traits.trait_vectors(t), "trait_vectors")
    store = BenchmarkStore.create(spark, path, t, vectors)
    store.refresh()
    before = {n: _files(path, n) for n in ("cohorts", "groups", "detail")}
    assert set(before["detail"]) == {"job_vacancy_id=1", "job_vacancy_id=2"}  # job 3 has no cohort
    store.set_cohort(1, spark.createDataFrame([("E7",), ("E8",)], "employee_id string"))
    after = {n: _files(path, n) for n in before}
    for n in before:
        assert after[n]["job_vacancy_id=2"] == before[n]["job_vacancy_id=2"] and not set(after[n]["job_vacancy_id=1"]) & set(before[n]["job_vacancy_id=1"])
    whole = match.detail_view(match.matching_detail(t.with_benchmarks(benchmark.export_benchmarks(store.benchmarks())), vectors=vectors))
    for j in (1, 2):
        assert _plain(store.detail(j)) == _plain(whole.where(F.col("job_vacancy_id") == j).select(*store.detail(j).columns))
    plan = store.detail(1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_vacancy_id" in plan
    new = store.add_job("Planner", "II", "Plan.", spark.createDataFrame([("E1",)], "employee_id string"))
    assert new == 4 and store.groups(4).count() == 12 and _files(path, "detail")["job_vacancy_id=2"] == before["detail"]["job_vacancy_id=2"]
    store.set_cohort(1, spark.createDataFrame([], "employee_id string"))
    assert store.groups(1).count() == 0 and store.detail(1).count() == 0 and store.detail(2).count() > 0


def test_a_cohort_of_a_million_stays_rows(spark):
    t = _tables(spark)
    ids = spark.range(1_000_000).selectExpr("concat('E', id) AS employee_id")
    b = benchmark.replace_cohort(benchmark.split_benchmarks(t.talent_benchmarks), 2, ids)
    assert "collect_list" not in b.cohorts._jdf.queryExecution().executedPlan().toString()
    assert {r.job_vacancy_id: r["count"] for r in b.cohorts.groupBy("job_vacancy_id").count().collect()} == {1: 2, 2: 1_000_000}
    base = match.baseline_table(t, cohort=b.cohorts.where("job_vacancy_id = 2")).where("tv_name = 'PerformanceRating'").first()
    assert base.baseline_score == 2.0
    again = benchmark.replace_cohort(b, 99, ids)
    assert again.cohorts.where("job_vacancy_id = 99").isEmpty()
    arrays = {r.job_vacancy_id: r.selected_talent_ids for r in benchmark.export_benchmarks(benchmark.split_benchmarks(t.talent_benchmarks)).collect()}
    assert arrays == {1: ["E0", "E5"], 2: ["E3", "E4"], 3: []}
