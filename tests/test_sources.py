"""Sources and sinks: raw CSV in, standardised names, required columns,
export, and a save / load round trip of the table bundle."""

from __future__ import annotations

import dataclasses
import os
import tempfile

import pyarrow.parquet as pq
import pytest
from helpers import SF_SMALL

from talentscope.operators.clean import clean_competencies, require_columns, standardize_columns
from talentscope.sources import export, read_raw, read_raw_checked
from talentscope.sources.schemas import COMPETENCIES_YEARLY
from talentscope.sources.tables import load_tables, save_tables


def _tmp() -> str:
    return tempfile.mkdtemp(prefix="talentscope-test-", dir="/tmp")


def test_read_raw_keeps_text_and_cleaning_coerces(spark):
    d = _tmp()
    path = os.path.join(d, "comp.csv")
    with open(path, "w") as f:
        f.write("Employee ID,Year,Pillar-Code,Score\n")
        f.write("E1,2024,P1, 2.5 \nE2,2024,P1,abc\nE3,2024,P1,\nE4,2024,P2,1e0\n")
    raw = read_raw(spark, path)
    assert all(t == "string" for _, t in raw.dtypes)
    df = standardize_columns(raw)
    assert df.columns == ["employee_id", "year", "pillar_code", "score"]
    got = {r["employee_id"]: r["score"] for r in clean_competencies(df).collect()}
    assert got == {"E1": 2.5, "E2": 2.5, "E3": 2.5, "E4": 1.0}


def test_read_raw_with_schema_names(spark):
    d = _tmp()
    path = os.path.join(d, "c.csv")
    with open(path, "w") as f:
        f.write("employee_id,year,pillar_code,score\nE1,2024,P1,3\n")
    df = read_raw(spark, path, schema=COMPETENCIES_YEARLY)
    assert df.dtypes == [(c, "string") for c in ["employee_id", "year", "pillar_code", "score"]]


def test_require_columns(spark):
    df = spark.createDataFrame([("a",)], "employee_id string")
    assert require_columns(df, ["employee_id"]) is df
    with pytest.raises(ValueError, match="score"):
        require_columns(df, ["employee_id", "score"])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export(spark, fmt):
    d = os.path.join(_tmp(), "out")
    df = spark.createDataFrame([("E1", 1.5), ("E2", None)], "employee_id string, score double")
    export(df, d, fmt=fmt)
    back = spark.read.option("header", True).csv(d) if fmt == "csv" else spark.read.parquet(d)
    assert back.count() == 2


def test_save_and_load_tables_round_trip(spark):
    from talentscope.plans.pipelines import tables_for

    t = tables_for(spark, SF_SMALL)
    d = _tmp()
    save_tables(t, d)
    back = load_tables(spark, d)
    assert back.employees.count() == t.employees.count()
    assert back.talent_benchmarks.schema == t.talent_benchmarks.schema
    assert back.dim_competency_pillars.count() == 7


def test_save_benchmarks_append(spark):
    from talentscope.operators.benchmark import create_benchmark, save_benchmarks
    from talentscope.plans.pipelines import tables_for
    import datetime as dt

    t = tables_for(spark, SF_SMALL)
    path = os.path.join(_tmp(), "benchmarks")
    save_benchmarks(t.talent_benchmarks, path)
    created = create_benchmark(t.talent_benchmarks, "Role", "L", "p", t.employees.select("employee_id").limit(2),
                               dt.datetime(2025, 3, 1, 9, 0, 0))
    save_benchmarks(created.filter("job_vacancy_id = 8"), path, mode="append")
    back = spark.read.parquet(path)
    assert back.count() == 8 and back.filter("job_vacancy_id = 8").first()["role_name"] == "Role"


def test_release_deletes_written_tables(spark):
    from talentscope.plans import pipelines

    d = "/root/testdata/sf0.001"
    pipelines.latest_for(spark, d)
    n = len(pipelines._paths)
    assert n > 0
    assert pipelines.release(spark) >= n
    assert not pipelines._paths
    # rebuilt on demand afterwards
    assert pipelines.latest_for(spark, d).count() > 0


def test_ragged_lines_are_kept_apart(spark):
    d = _tmp()
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write('employee_id,year,pillar_code,score\nE1,2024,P1,3\nE2,2024\n"E,3",2024,P1,"a,b"\nE4,2024,P1,3,"x,y"\nE5,2024,P1,\n')
    got = read_raw_checked(spark, d, COMPETENCIES_YEARLY)
    assert sorted(r.employee_id for r in got.fitting.collect()) == ["E,3", "E1", "E5"]
    assert sorted(map(tuple, got.rejected.collect())) == [("E2,2024", 2), ('E4,2024,P1,3,"x,y"', 5)]
    assert sorted(map(tuple, got.counts().collect())) == [(False, 2, 1), (False, 5, 1), (True, 4, 3)]
    assert got.fitting.select("score").count() == 3  # pruned columns don't change what fits
    with pytest.raises(ValueError):
        read_raw_checked(spark, d)


def test_partitioned_export_is_ordered_and_spreads_a_hot_partition(spark):
    from pyspark.sql import functions as F

    path = os.path.join(_tmp(), "out")
    rows = spark.range(6000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("division"),
                                    (F.col("id") * 7919 % 613).alias("score"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        export(rows, path, partition_by=["division"], order_by=[F.desc("score"), F.asc("id")], rows_per_file=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for folder in sorted(x for x in os.listdir(path) if x.startswith("division=")):
        files = sorted(x for x in os.listdir(os.path.join(path, folder)) if x.startswith("part-"))
        parts = [[(-r["score"], r["id"]) for r in pq.ParquetFile(os.path.join(path, folder, x)).read().to_pylist()] for x in files]
        got = [r for p in parts for r in p]
        assert got == sorted(got) and max(map(len, parts)) <= 1000
        assert len(files) > 1 or "hot" not in folder
        total += len(got)
    assert total == 6000


def test_other_column_names_load(spark):
    from talentscope.operators import eda
    from talentscope.plans.pipelines import tables_for

    t = tables_for(spark, SF_SMALL)
    d = _tmp()
    save_tables(t, d)
    t.dim_competency_pillars.withColumnRenamed("pillar_label", "name").write.parquet(d + "2/dim_competency_pillars")
    t.profiles_psych.drop("disc_word").write.parquet(d + "2/profiles_psych")
    for name in set(t.names()) - {"dim_competency_pillars", "profiles_psych"}:
        if not name.startswith("raw_"):
            os.symlink(f"{d}/{name}", f"{d}2/{name}")
    back = load_tables(spark, d + "2")
    assert sorted(back.dim_competency_pillars.collect()) == sorted(t.dim_competency_pillars.collect())
    assert back.profiles_psych.columns == t.profiles_psych.columns
    want = {r.disc: r.n for r in t.profiles_psych.groupBy("disc").count().withColumnRenamed("count", "n").collect()}
    assert {r.disc_word: r["count"] for r in back.profiles_psych.groupBy("disc_word").count().collect()} == want
    no_word = dataclasses.replace(t, profiles_psych=t.profiles_psych.drop("disc_word"))
    assert {r.disc_profile for r in eda.hp_by_profile(no_word, "disc_word").collect()} <= set(want)
