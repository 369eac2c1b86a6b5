"""The scalable forms equal the literal ones, including ties, NULLs and a
key holding a third of all rows."""

from __future__ import annotations

import dataclasses
import random

import pytest
from helpers import bench, emp, psych, tables
from pyspark.sql import Window
from pyspark.sql import functions as F

from talentscope.operators import eda, match, readiness, traits
from talentscope.operators.ranking import dense_rank_and_cume_dist
from talentscope.session import write_and_read


def _random_totals(spark, n=400, seed=7):
    rnd = random.Random(seed)
    values = [None, 0.1, 0.25, 0.25, 0.5, 0.75, 0.9, 0.9, 1.0]
    rows = [(f"E{i}", rnd.choice([2022, 2023, 2024]), rnd.choice(values)) for i in range(n)]
    return spark.createDataFrame(rows, "employee_id string, year int, finalmatch double")


@pytest.mark.parametrize("max_broadcast_bytes", [64 * 2**20, 3])
def test_histogram_rank_equals_window(spark, max_broadcast_bytes):
    df = _random_totals(spark)
    got = dense_rank_and_cume_dist(df, ["year"], "finalmatch", max_broadcast_bytes=max_broadcast_bytes)
    w_rank = Window.partitionBy("year").orderBy(F.col("finalmatch").desc_nulls_first())
    w_cume = Window.partitionBy("year").orderBy(F.col("finalmatch").asc_nulls_last())
    ref = df.select("employee_id", F.dense_rank().over(w_rank).alias("rank"), F.cume_dist().over(w_cume).alias("cume_dist"))
    a = sorted((r["employee_id"], r["rank"], r["cume_dist"]) for r in got.collect())
    b = sorted((r["employee_id"], r["rank"], r["cume_dist"]) for r in ref.collect())
    assert a == b


def test_rank_of_distinct_doubles_equals_window_and_no_task_holds_a_year(spark):
    """A distinct value per row: the ranges split the year, and ranks agree."""
    df = spark.range(60_000).select(
        F.concat(F.lit("E"), "id").alias("employee_id"), F.when(F.col("id") % 10 == 0, 2023).otherwise(2024).alias("year"),
        F.when(F.col("id") % 997 != 0, F.pmod(F.xxhash64("id"), F.lit(10**12)) / 7.0).alias("finalmatch"))
    for nulls_first in (True, False):
        got = dense_rank_and_cume_dist(df, ["year"], "finalmatch", desc_nulls_first=nulls_first, max_broadcast_bytes=1)
        v = F.col("finalmatch")
        rank = F.dense_rank().over(Window.partitionBy("year").orderBy(v.desc_nulls_first() if nulls_first else v.desc_nulls_last()))
        cume = F.cume_dist().over(Window.partitionBy("year").orderBy(v.asc_nulls_last()))
        want = df.select("employee_id", rank.alias("rank"), cume.alias("cume_dist"))
        got = got.select("employee_id", "rank", "cume_dist")
        assert got.count() == 60_000
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rank_of_no_rows_and_null_partition(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, None), ("c", 2024, None)], "employee_id string, year int, finalmatch double")
    got = {r.employee_id: (r["rank"], r.cume_dist) for r in dense_rank_and_cume_dist(df, ["year"], "finalmatch").collect()}
    assert got == {"a": (2, 0.5), "b": (1, 1.0), "c": (1, 1.0)}
    assert dense_rank_and_cume_dist(df.limit(0), ["year"], "finalmatch").collect() == []


def _skewed_tables(spark):
    """E0 holds most PAPI and competency rows (far more than a third)."""
    people = [f"E{i}" for i in range(30)]
    papi = [(p, f"Papi_{s}", float((i * 7 + s) % 9 + 1)) for i, p in enumerate(people) for s in range(3)]
    papi += [("E0", f"Papi_{s % 3}", float(s % 9 + 1)) for s in range(len(papi) * 3)]
    comp = [(p, 2024, f"P{1 + j % 2}", float((i + j) % 5)) for i, p in enumerate(people) for j in range(2)]
    comp += [("E0", 2024, f"P{1 + j % 2}", float(j % 5)) for j in range(len(comp) * 3)]
    return tables(
        spark,
        employees=[emp(p) for p in people],
        performance_yearly=[(p, 2024, float(1 + i % 5)) for i, p in enumerate(people)],
        competencies_yearly=comp,
        profiles_psych=[psych(p, 90.0 + i, 20.0 + i % 7) for i, p in enumerate(people)],
        papi_scores=papi,
        strengths=[(p, "T1", 1 + i % 4) for i, p in enumerate(people)],
        talent_benchmarks=[bench(1, ["E0", "E5", "E9"]), bench(2, ["E3", "E4"])],
    )


@pytest.mark.parametrize("part_rows,set_bytes,broadcast", [(50_000, 16 * 2**20, "10m"), (4, 16 * 2**20, "-1"), (3, 1, "-1")])
def test_trait_vectors_equal_self_join_form(spark, part_rows, set_bytes, broadcast):
    """Whole vectors, a hot person in parts, and a set of its own for nearly every job, also with broadcasts off."""
    t = _skewed_tables(spark)
    keys = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.autoBroadcastJoinThreshold": broadcast}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        vectors = write_and_read(traits.trait_vectors(t, part_rows), "trait_vectors")
        base = match.baselines(t, vectors=vectors)
        sets = traits.job_sets(base, set_bytes)
        detail = traits.match_detail(vectors, sets)
        groups = traits.match_groups(vectors, sets)
        rows, got_tv, got_groups = detail.collect(), traits.match_tv(vectors, sets).collect(), groups.collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    parts = {r.employee_id: r.parts for r in vectors.select("employee_id", "parts").collect()}
    assert (parts["E0"] > 1) == (part_rows < 100) and (len(sets) > 1) == (set_bytes == 1)
    assert (vectors.selectExpr("size(traits) AS n").agg(F.max("n")).first()[0] <= 31) == (part_rows < 100)  # equal rows are one in a part
    tv = match.tv_long(t)
    tvm = match.match_tv(tv, base)
    tgv = match.match_tgv(tvm)
    fin = match.match_final(tgv)
    ref = (tvm.join(tgv, ["employee_id", "job_vacancy_id", "tgv_name"], "left")
           .join(fin, ["employee_id", "job_vacancy_id"], "left")).collect()

    def norm(rs):
        return sorted((r["employee_id"], r["job_vacancy_id"] or -1, r["tgv_name"], r["tv_name"],
                       r["tv_match_rate"], None if r["tgv_match_rate"] is None else round(r["tgv_match_rate"], 9),
                       r["final_match_rate"]) for r in rs)

    assert norm(rows) == norm(ref)
    assert sorted(map(str, (sorted(r.asDict().items()) for r in got_tv))) == sorted(map(str, (sorted(r.asDict().items()) for r in tvm.collect())))
    of_groups = sorted((r.employee_id, r.job_vacancy_id, r._final) for r in got_groups)
    assert of_groups == sorted((r.employee_id, r.job_vacancy_id, r.final_match_rate) for r in fin.collect())


def test_newest_year_without_a_join(spark):
    """Years, repeated rows, people without a rating, NULL ids and years: as the join to the newest year gives them."""
    t = tables(
        spark, employees=[emp("A"), emp("B")], performance_yearly=[("A", 2023, 5.0), ("A", 2024, 3.0), ("A", 2024, 4.0), ("C", None, 1.0), (None, 2024, 2.0)],
        competencies_yearly=[("A", 2023, "P1", 1.0), ("A", 2024, "P1", 2.0), ("A", 2024, "P1", 2.0), ("B", 2024, "P1", 3.0), ("C", 2024, "P2", 4.0), (None, 2024, "P1", 9.0)],
        papi_scores=[("A", "S", 7.0), (None, "S", 8.0), ("A", None, 1.0)], strengths=[("A", "T", 2), ("A", "U", 3)])
    for part_rows in (50_000, 1):
        got = sorted(map(str, (tuple(r) for r in traits.tv_rows(write_and_read(traits.trait_vectors(t, part_rows), "v")).collect())))
        want = [("A", "Competencies", "Pillar One", 2.0, "higher")] * 2 + [
            ("A", "Context", "PerformanceRating", 3.0, "higher"), ("A", "Context", "PerformanceRating", 4.0, "higher"), ("A", "PersonalityPAPI", "S", 7.0, "higher"),
            ("A", "PersonalityPAPI", None, 1.0, "higher"), (None, "PersonalityPAPI", "S", 8.0, "higher"), ("A", "BehaviorStrengths", "StrengthsRankAvg", 2.5, "lower")]
        assert got == sorted(map(str, want))


def test_hot_person_readiness_is_unchanged(spark):
    t = _skewed_tables(spark)
    got = {r["employee_id"]: r["finalmatch"] for r in readiness.readiness_final(t).collect()}
    assert len(got) == 30
    # the hot person's competency part is the plain mean of all their rows
    e0 = [r["score"] for r in t.competencies_yearly.filter("employee_id = 'E0'").collect()]
    part = readiness.tgv_competencies(t).filter("employee_id = 'E0'").first()["tgv_competencies"]
    assert part == round(sum(e0) / len(e0) / 5, 4)


def test_latest_year_pillars_equal_the_join_of_raw_rows(spark):
    """A hot person, repeated rows, missing scores and ratings, a pillar without a label."""
    t = _skewed_tables(spark)
    perf = t.performance_yearly.union(spark.createDataFrame(
        [("E0", 2023, 1.0), ("E0", 2024, 2.0), ("E1", 2025, None), (None, 2024, 3.0), ("E3", None, 4.0)], t.performance_yearly.schema))
    comp = t.competencies_yearly.union(spark.createDataFrame(
        [("E1", 2025, "P1", 2.0), ("E1", 2025, "P2", None), ("E0", 2023, "P1", 99.0), (None, 2024, "P1", 9.0), ("E3", None, "P1", 9.0), ("E4", 2024, "PX", 1.0)],
        t.competencies_yearly.schema))
    t = dataclasses.replace(t, performance_yearly=perf, competencies_yearly=comp)
    perf.createOrReplaceTempView("lp_perf")
    comp.createOrReplaceTempView("lp_comp")
    t.dim_competency_pillars.createOrReplaceTempView("lp_dim")
    newest = """(SELECT c.*, p.rating FROM lp_comp c JOIN (SELECT employee_id, max(year) y FROM lp_perf GROUP BY 1) l
        ON c.employee_id = l.employee_id AND c.year = l.y JOIN lp_perf p ON p.employee_id = c.employee_id AND p.year = c.year)"""
    want = spark.sql(f"""SELECT d.pillar_label, round(avg(score), 2) AS avg_competency_score, round(avg(rating), 2) AS avg_performance_rating
        FROM {newest} x JOIN lp_dim d USING (pillar_code) GROUP BY 1""")
    assert sorted(map(tuple, eda.pillar_vs_rating(t).collect())) == sorted((r[0], float(r[1]), float(r[2])) for r in want.collect())
    plan = eda.pillar_vs_rating(t)._jdf.queryExecution().optimizedPlan().toString()
    assert not [ln for ln in plan.split("\n") if "Join" in ln and "employee_id" in ln]


def test_top_n_shuffles_at_most_five_times(spark):
    plan = eda.hp_top_n(_skewed_tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in ln for ln in plan.split("\n")) <= 6 and sum("Exchange hashpartitioning" in ln for ln in plan.split("\n")) <= 5
