"""Derive the talent tables from the driver's TPC-H-like tables.

The test data holds customers, orders and line items, not people.  Each
talent table is a deterministic projection of them (customer = employee,
order year = performance year, line number = competency pillar, ...), so
that Spark and the SQL oracle can both rebuild the same inputs from the
same parquet files, and every query's work grows with the data.

All of it is joins and aggregations keyed by customer: partial
aggregation runs before every shuffle, and the only broadcast sides are
``nation`` / ``region`` (25 and 5 rows by definition of the schema) and
the inline lookup tables below.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd
from talentscope.functions.scoring import TGV_WEIGHTS
from talentscope.sources import schemas
from talentscope.sources.tables import TalentTables

# Competency pillars (code, label).
PILLARS = [
    ("P1", "Drive"),
    ("P2", "Curiosity"),
    ("P3", "Judgement"),
    ("P4", "Delivery"),
    ("P5", "Collaboration"),
    ("P6", "Empathy"),
    ("P7", "Leadership"),
]
# Grade ids and names.
GRADES = [(1, "Grade I"), (2, "Grade II"), (3, "Grade III"), (4, "Grade IV"),
          (5, "Grade V"), (6, "Grade VI"), (7, "Grade VII")]
# Education ids and names.
EDUCATION = [(1, "SMA"), (2, "D3"), (3, "S1"), (4, "S2"), (5, "S3")]
# Positions, one per market segment of the source data.
POSITIONS = [
    ("AUTOMOBILE", "Automotive Specialist"),
    ("BUILDING", "Facilities Engineer"),
    ("FURNITURE", "Product Designer"),
    ("HOUSEHOLD", "Category Manager"),
    ("MACHINERY", "Operations Engineer"),
]
# DISC profiles as (letters, phrase).
DISC_PROFILES = [
    ("D", "Dominant"),
    ("I", "Influencer"),
    ("S", "Steadiness"),
    ("C", "Conscientious"),
    ("DI", "Dominant-Influencer"),
    ("IS", "Influencer-Steadiness"),
    ("SC", "Steadiness-Conscientious"),
    ("CD", "Conscientious-Dominant"),
]
# The sixteen MBTI types.
MBTI_TYPES = ["ISTJ", "ISFJ", "INFJ", "INTJ", "ISTP", "ISFP", "INFP", "INTP",
              "ESTP", "ESFP", "ENFP", "ENTP", "ESTJ", "ESFJ", "ENFJ", "ENTJ"]

COHORT_SIZE = 50
UNKNOWN_ID = "EMP_UNKNOWN"
DEFAULT_WEIGHTS_JSON = json.dumps({"tgv": TGV_WEIGHTS}, separators=(",", ":"))

Write = Callable[[str, DataFrame], DataFrame]


def _emp(c: str) -> Column:
    return F.concat(F.lit("EMP"), F.col(c).cast("string"))


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _inline(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hundredths_text(h: Column) -> Column:
    """Non-negative integer hundredths -> 'x.yy' (same text in every engine)."""
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


# ---------------------------------------------------------------- clean tables

def employees(customer: DataFrame, nation: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return (
        customer.join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _emp("c_custkey").alias("employee_id"),
            F.col("c_name").alias("fullname"),
            (1 + k % 3).cast("int").alias("company_id"),
            (1 + F.col("c_nationkey") % 4).cast("int").alias("area_id"),
            F.col("c_mktsegment").alias("position_id"),
            (1 + k % 11).cast("int").alias("department_id"),
            F.col("c_nationkey").cast("int").alias("division_id"),
            F.col("n_regionkey").cast("int").alias("directorate_id"),
            F.when(k % 40 != 0, 1 + k % 7).cast("int").alias("grade_id"),
            (1 + k % 5).cast("int").alias("education_id"),
            (1 + k % 9).cast("int").alias("major_id"),
            (k % 640 - 10).cast("double").alias("years_of_service_months"),
        )
    )


def performance_yearly(orders: DataFrame) -> DataFrame:
    """Rating 1..5 from the average order value of a customer-year (integer cents)."""
    return (
        orders.select(
            "o_custkey",
            F.year("o_orderdate").cast("int").alias("year"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        )
        .groupBy("o_custkey", "year")
        .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
        .select(
            _emp("o_custkey").alias("employee_id"),
            "year",
            (1 + F.least(F.lit(4), F.floor(F.col("cents") / (F.col("n") * 1.0e7)))).cast("double").alias("rating"),
        )
    )


def line_facts(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per (customer, year, line number): the shared input of
    competencies and strengths, aggregated once."""
    o = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("year"))
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "year", "l_linenumber")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.count(F.lit(1)).alias("n"),
            F.min("l_partkey").alias("min_partkey"),
        )
    )


def competencies_yearly(facts: DataFrame) -> DataFrame:
    return facts.select(
        _emp("o_custkey").alias("employee_id"),
        "year",
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("pillar_code"),
        rnd(F.col("qty") / F.col("n") / 10, 2).alias("score"),
    )


def strengths(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy("o_custkey", "l_linenumber")
        .agg(F.min("min_partkey").alias("min_partkey"))
        .select(
            _emp("o_custkey").alias("employee_id"),
            F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("theme"),
            (1 + F.col("min_partkey") % 14).cast("int").alias("rank"),
        )
    )


def profiles_psych(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        _emp("c_custkey").alias("employee_id"),
        (20 + (29 * k) % 81).cast("double").alias("pauli"),
        (1 + (11 * k) % 9).cast("double").alias("faxtor"),
        (80 + (37 * k) % 61).cast("double").alias("iq"),
        (20 + (53 * k) % 31).cast("double").alias("gtq"),
        (1 + (17 * k) % 10).cast("double").alias("tiki"),
        F.when(k % 6 != 0, _pick([d for d, _ in DISC_PROFILES], (7 * k) % 8)).alias("disc"),
        F.when(k % 45 == 0, F.lit(None).cast("string"))
        .when(k % 50 == 7, F.lit("Unclassified"))
        .otherwise(_pick([w for _, w in DISC_PROFILES], (7 * k) % 8))
        .alias("disc_word"),
        F.when(k % 35 == 2, F.lit(None).cast("string"))
        .when(k % 30 == 1, F.lit("  "))
        .otherwise(_pick(MBTI_TYPES, (13 * k) % 16))
        .alias("mbti"),
    )


def papi_scores(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            _emp("o_custkey").alias("employee_id"),
            F.concat(F.lit("Papi_"), F.col("p")).alias("scale_code"),
            F.col("n").cast("double").alias("score"),
        )
    )


def dims(spark: SparkSession, nation: DataFrame, region: DataFrame) -> dict[str, DataFrame]:
    """Lookup tables, each marked for broadcast: the inline ones have the
    fixed sizes above, ``nation`` and ``region`` have 25 and 5 rows."""
    tables = {
        "dim_grades": _inline(spark, GRADES, schemas.DIM_GRADES),
        "dim_education": _inline(spark, EDUCATION, schemas.DIM_EDUCATION),
        "dim_positions": _inline(spark, POSITIONS, schemas.DIM_POSITIONS),
        "dim_competency_pillars": _inline(spark, PILLARS, schemas.DIM_COMPETENCY_PILLARS),
        "dim_divisions": nation.select(
            F.col("n_nationkey").cast("int").alias("division_id"), F.col("n_name").alias("name")),
        "dim_directorates": region.select(
            F.col("r_regionkey").cast("int").alias("directorate_id"), F.col("r_name").alias("name")),
    }
    return {n: F.broadcast(df) for n, df in tables.items()}


def seed_benchmarks(spark: SparkSession, perf: DataFrame, emps: DataFrame, region: DataFrame,
                    cohort_size: int = COHORT_SIZE) -> DataFrame:
    """One job per region whose cohort is the first ``cohort_size`` people
    (by id) of that region rated 5 in their latest year; plus a job with an
    empty cohort and one naming an unknown id.

    The per-region top-k is a ``row_number`` filter, which Spark turns into
    a partial ``WindowGroupLimit`` before the shuffle, so no region ever
    sends more than ``cohort_size`` ids per task.
    """
    from talentscope.operators.benchmark import cohort_candidates_by_group

    seeds = cohort_candidates_by_group(perf, emps, "directorate_id", n=cohort_size)
    jobs = (
        region.select(F.col("r_regionkey").cast("int").alias("directorate_id"), "r_name")
        .join(seeds, "directorate_id", "left")
        .select(
            (F.col("directorate_id") + 1).cast("int").alias("job_vacancy_id"),
            F.concat(F.lit("Analyst "), F.col("r_name")).alias("role_name"),
            F.lit("Grade III").alias("job_level"),
            F.concat(F.lit("Benchmark of top performers in "), F.col("r_name")).alias("role_purpose"),
            F.coalesce(F.col("cohort"), F.array().cast("array<string>")).alias("selected_talent_ids"),
            F.lit(DEFAULT_WEIGHTS_JSON).alias("weights_config"),
        )
    )
    extra = spark.createDataFrame(
        [
            (6, "Empty Cohort", "Grade II", "Benchmark without people", [], "{}"),
            (7, "Unknown Cohort", "Grade II", "Benchmark naming an unknown id", [UNKNOWN_ID], "{}"),
        ],
        "job_vacancy_id int, role_name string, job_level string, role_purpose string, "
        "selected_talent_ids array<string>, weights_config string",
    )
    return jobs.unionByName(extra).withColumn(
        "created_at",
        F.to_timestamp_ntz(F.format_string("2025-01-%02d 09:00:00", F.col("job_vacancy_id"))),
    )


# ------------------------------------------------------------------ raw tables

def raw_employees(emps: DataFrame) -> DataFrame:
    """All-string export with untrimmed names, junk numbers and repeated ids."""
    k = F.regexp_extract("employee_id", r"([0-9]+)$", 1).cast("long")
    cols = [c for c in schemas.EMPLOYEES.fieldNames()]
    base = emps.withColumn("_k", k)
    out = base.select(
        "employee_id",
        F.when(F.col("_k") % 50 == 4, F.concat(F.lit("  "), "fullname", F.lit(" "))).otherwise(F.col("fullname")).alias("fullname"),
        *[F.col(c).cast("string").alias(c) for c in cols[2:-1]],
        F.when(F.col("_k") % 97 == 11, F.lit("n/a"))
        .otherwise(F.col("years_of_service_months").cast("long").cast("string"))
        .alias("years_of_service_months"),
        "_k",
    )
    return out.unionByName(out.filter(F.col("_k") % 200 == 3)).drop("_k")


def raw_performance_yearly(perf: DataFrame) -> DataFrame:
    k = F.regexp_extract("employee_id", r"([0-9]+)$", 1).cast("long")
    s = (k + F.col("year")) % 23
    t = F.col("rating").cast("int").cast("string")
    year = F.col("year").cast("string")
    return perf.select(
        "employee_id",
        F.when(k % 61 == 9, F.concat(year, F.lit(".7"))).when(k % 67 == 10, F.lit("99999999999"))
        .when(k % 71 == 5, F.concat(year, F.lit(".0"))).otherwise(year).alias("year"),
        F.when(s == 0, F.lit(None).cast("string"))
        .when((k + F.col("year")) % 31 == 0, F.lit("n/a"))
        .when(k % 13 == 0, F.concat(F.lit(" "), t, F.lit(" ")))
        .otherwise(t)
        .alias("rating"),
    )


def raw_competencies_yearly(comp: DataFrame) -> DataFrame:
    """Blanks, words, padded numbers, an all-blank pillar (P7) and repeated rows."""
    k = F.regexp_extract("employee_id", r"([0-9]+)$", 1).cast("long")
    line = F.substring("pillar_code", 2, 10).cast("int")
    text = _hundredths_text(F.round(F.col("score") * 100).cast("long"))
    year = F.col("year").cast("string")
    out = comp.select(
        "employee_id",
        F.when(k % 59 == 8, F.concat(year, F.lit(".7"))).when(k % 73 == 6, F.lit("null")).otherwise(year).alias("year"),
        "pillar_code",
        F.when(F.col("pillar_code") == "P7", F.lit(None).cast("string"))
        .when((k + line) % 17 == 0, F.lit(""))
        .when((k + F.col("year") + line) % 29 == 0, F.lit("abc"))
        .when(k % 19 == 0, F.concat(F.lit(" "), text, F.lit(" ")))
        .otherwise(text)
        .alias("score"),
        k.alias("_k"),
    )
    return out.unionByName(out.filter((F.col("_k") % 50 == 0) & (F.col("pillar_code") == "P1"))).drop("_k")


def raw_profiles_psych(psych: DataFrame) -> DataFrame:
    k = F.regexp_extract("employee_id", r"([0-9]+)$", 1).cast("long")

    def num(c: str) -> Column:
        return F.col(c).cast("long").cast("string")

    return psych.select(
        "employee_id",
        F.when(k % 31 == 0, F.lit("")).otherwise(num("pauli")).alias("pauli"),
        num("faxtor").alias("faxtor"),
        F.when(k % 19 == 0, F.lit("")).otherwise(num("iq")).alias("iq"),
        F.when(k % 23 != 0, num("gtq")).alias("gtq"),
        F.when(k % 29 == 0, F.lit("x")).otherwise(num("tiki")).alias("tiki"),
        F.when(k % 41 == 5, F.lit("NA")).otherwise(F.col("disc")).alias("disc"),
        F.when(k % 43 == 7, F.lit("n/a")).otherwise(F.col("disc_word")).alias("disc_word"),
        F.when(k % 47 == 6, F.lit("NaN")).otherwise(F.col("mbti")).alias("mbti"),
    )


def raw_papi_scores(papi: DataFrame) -> DataFrame:
    """Padded scale codes, blank scores, and one scale (Papi_5) with no score at all."""
    k = F.regexp_extract("employee_id", r"([0-9]+)$", 1).cast("long")
    return papi.select(
        "employee_id",
        F.when(k % 11 == 0, F.concat(F.lit(" "), "scale_code", F.lit("\t"))).otherwise(F.col("scale_code")).alias("scale_code"),
        F.when(F.col("scale_code") == "Papi_5", F.lit(None).cast("string"))
        .when((k % 13 == 0) & (F.col("scale_code") == "Papi_3"), F.lit(""))
        .otherwise(F.col("score").cast("long").cast("string"))
        .alias("score"),
    )


# ----------------------------------------------------------------- the bundle

def from_driver_tables(spark: SparkSession, sf_dir: str, write: Write | None = None,
                       with_raw: bool = True) -> TalentTables:
    """Build every talent table from ``sf_dir``.

    ``write(name, df)`` is applied to each heavy table and its result is
    used downstream; pass a writer to materialise them.  Each table is
    started as soon as the tables it reads are ready (the independent ones
    concurrently), and the shared line-item aggregate is computed once.
    Lookup tables and the raw exports (cheap projections of the written
    tables) stay lazy.
    """
    write = write or (lambda _name, df: df)
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")

    with ThreadPoolExecutor(max_workers=8) as pool:
        f_emps = pool.submit(write, "employees", employees(customer, nation))
        f_perf = pool.submit(write, "performance_yearly", performance_yearly(orders))
        f_facts = pool.submit(write, "_line_facts", line_facts(lineitem, orders))
        f_psych = pool.submit(write, "profiles_psych", profiles_psych(customer))
        f_papi = pool.submit(write, "papi_scores", papi_scores(orders))
        f_comp = pool.submit(lambda: write("competencies_yearly", competencies_yearly(f_facts.result())))
        f_strg = pool.submit(lambda: write("strengths", strengths(f_facts.result())))
        f_bench = pool.submit(lambda: write("talent_benchmarks",
                                            seed_benchmarks(spark, f_perf.result(), f_emps.result(), region)))
        emps, perf, psych, papi = f_emps.result(), f_perf.result(), f_psych.result(), f_papi.result()
        comp, strg, bench = f_comp.result(), f_strg.result(), f_bench.result()

    raw = {}
    if with_raw:
        raw = {
            "raw_employees": raw_employees(emps),
            "raw_performance_yearly": raw_performance_yearly(perf),
            "raw_competencies_yearly": raw_competencies_yearly(comp),
            "raw_profiles_psych": raw_profiles_psych(psych),
            "raw_papi_scores": raw_papi_scores(papi),
        }
    return TalentTables(
        employees=emps, performance_yearly=perf, competencies_yearly=comp, profiles_psych=psych,
        papi_scores=papi, strengths=strg, talent_benchmarks=bench, **dims(spark, nation, region), **raw,
    )
