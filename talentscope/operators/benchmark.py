"""Job benchmarks: candidate cohorts, creating and updating jobs.

Jobs and cohorts are two tables (``BenchmarkTables``): one row per job, and
(job, employee) rows, so a cohort of any size stays rows.  Creating a job and
replacing a cohort work on these; the array form of the exported table is made
by ``export_benchmarks`` alone.  ``plans.store`` keeps both as files, with the
results of each job.  Allocating ids concurrently needs a table format with
transactions and is the caller's concern.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentscope.operators.common import at_latest_year, latest_year
from talentscope.sources.tables import TalentTables


@dataclass(frozen=True)
class BenchmarkTables:
    """``jobs``: the benchmark table without ``selected_talent_ids``;
    ``cohorts``: ``job_vacancy_id, employee_id`` rows (an id listed twice is two rows)."""

    jobs: DataFrame
    cohorts: DataFrame


def cohort_rows(job_vacancy_id: int, talent_ids: DataFrame) -> DataFrame:
    """``job_vacancy_id, employee_id``: a cohort of any size as rows, as
    ``cohort_explode`` gives them; ``match.baseline_table(cohort=...)`` takes it."""
    return talent_ids.select(F.lit(job_vacancy_id).cast("int").alias("job_vacancy_id"), "employee_id")


def rated_at_latest_year(perf: DataFrame, rating: float = 5.0, latest: DataFrame | None = None) -> DataFrame:
    """``employee_id`` of every latest-year performance row with ``rating``."""
    latest = latest if latest is not None else latest_year(perf)
    return at_latest_year(perf, latest).filter(F.col("rating") == rating).select("employee_id")


def cohort_candidates(perf: DataFrame, n: int = 20, rating: float = 5.0) -> DataFrame:
    """The first ``n`` ids (by id) rated ``rating`` in their latest year.

    ``orderBy().limit()`` is a TakeOrderedAndProject: every task keeps its
    own top ``n`` and only those meet on the driver.
    """
    return rated_at_latest_year(perf, rating).orderBy("employee_id").limit(n)


def cohort_candidates_by_group(perf: DataFrame, employees: DataFrame, group_col: str,
                               n: int = 50, rating: float = 5.0) -> DataFrame:
    """``<group_col>, cohort``: per group, the first ``n`` qualifying ids as a
    sorted array (at most ``n`` per group, kept by a partial group limit)."""
    cand = rated_at_latest_year(perf, rating).join(employees.select("employee_id", group_col), "employee_id")
    w = Window.partitionBy(group_col).orderBy("employee_id")
    top = cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return top.groupBy(group_col).agg(F.array_sort(F.collect_list("employee_id")).alias("cohort"))


def cohort_explode(benchmarks: DataFrame) -> DataFrame:
    """``job_vacancy_id, employee_id``: one row per listed id.

    ``explode`` drops NULL and empty arrays, as ``UNNEST`` does; an id
    listed twice stays twice (it then counts twice in the median).
    """
    return benchmarks.select("job_vacancy_id", F.explode("selected_talent_ids").alias("employee_id"))


def split_benchmarks(benchmarks: DataFrame) -> BenchmarkTables:
    """The array form as two tables."""
    return BenchmarkTables(benchmarks.drop("selected_talent_ids"), cohort_explode(benchmarks))


def export_benchmarks(b: BenchmarkTables) -> DataFrame:
    """The array form: one row per job with its ids sorted, none for a job without a cohort."""
    ids = F.coalesce("_ids", F.array().cast("array<string>")).alias("selected_talent_ids")
    columns = [c for c in b.jobs.columns if c != "_j"]
    at = columns.index("weights_config") if "weights_config" in columns else len(columns)
    grouped = b.cohorts.groupBy(F.col("job_vacancy_id").alias("_j")).agg(F.array_sort(F.collect_list("employee_id")).alias("_ids"))
    return b.jobs.join(grouped, F.col("job_vacancy_id") == F.col("_j"), "left").select(*columns[:at], ids, *columns[at:])


def new_job(jobs: DataFrame, role_name: str, job_level: str, role_purpose: str, talent_ids: DataFrame,
            created_at: dt.datetime, weights_config: str = "{}") -> tuple[DataFrame, int]:
    """A one-row table of the new job and its id, ``max(id) + 1``.  A blank
    role, level or purpose and an empty cohort are refused."""
    blank = [n for n, v in (("role_name", role_name), ("job_level", job_level), ("role_purpose", role_purpose))
             if not (v or "").strip()]
    if blank:
        raise ValueError(f"blank: {', '.join(blank)}")
    if talent_ids.isEmpty():
        raise ValueError("a benchmark needs role models")
    next_id = jobs.agg(F.coalesce(F.max("job_vacancy_id") + 1, F.lit(1)).cast("int").alias("job_vacancy_id")).first()[0]
    row = jobs.sparkSession.range(1).select(
        F.lit(next_id).cast("int").alias("job_vacancy_id"),
        F.lit(role_name).alias("role_name"),
        F.lit(job_level).alias("job_level"),
        F.lit(role_purpose).alias("role_purpose"),
        F.lit(weights_config).alias("weights_config"),
        F.to_timestamp_ntz(F.lit(created_at.strftime("%Y-%m-%d %H:%M:%S"))).alias("created_at"),
    )
    return row, next_id


def add_job(b: BenchmarkTables, role_name: str, job_level: str, role_purpose: str, talent_ids: DataFrame,
            created_at: dt.datetime, weights_config: str = "{}") -> BenchmarkTables:
    """The tables with one more job, whose cohort is ``talent_ids`` (rows of ``employee_id``)."""
    row, job_id = new_job(b.jobs, role_name, job_level, role_purpose, talent_ids, created_at, weights_config)
    return BenchmarkTables(b.jobs.unionByName(row), b.cohorts.unionByName(cohort_rows(job_id, talent_ids)))


def replace_cohort(b: BenchmarkTables, job_vacancy_id: int, talent_ids: DataFrame) -> BenchmarkTables:
    """The tables with one job's cohort replaced; an unknown job changes nothing."""
    known = b.jobs.where(F.col("job_vacancy_id") == job_vacancy_id).select("job_vacancy_id").distinct()
    new = cohort_rows(job_vacancy_id, talent_ids).join(F.broadcast(known), "job_vacancy_id", "left_semi")  # one row at most
    return BenchmarkTables(b.jobs, b.cohorts.where(F.col("job_vacancy_id") != job_vacancy_id).unionByName(new))


def create_benchmark(benchmarks: DataFrame, role_name: str, job_level: str, role_purpose: str,
                     talent_ids: DataFrame, created_at: dt.datetime, weights_config: str = "{}") -> DataFrame:
    """``add_job`` on the array form."""
    return export_benchmarks(add_job(split_benchmarks(benchmarks), role_name, job_level, role_purpose, talent_ids, created_at, weights_config))


def set_cohort(benchmarks: DataFrame, job_vacancy_id: int, talent_ids: DataFrame) -> DataFrame:
    """``replace_cohort`` on the array form."""
    return export_benchmarks(replace_cohort(split_benchmarks(benchmarks), job_vacancy_id, talent_ids))


def save_benchmarks(benchmarks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a benchmark table as parquet.  ``mode="append"`` adds rows
    (e.g. only the new job from ``create_benchmark``) without rewriting the
    rest; readers see the new files on their next scan."""
    benchmarks.write.mode(mode).parquet(path)


def cohort_summary(benchmarks: DataFrame) -> DataFrame:
    """``job_vacancy_id, cohort_size, cohort``: the ids as comma-joined text."""
    return benchmarks.select(
        "job_vacancy_id",
        F.coalesce(F.size("selected_talent_ids"), F.lit(0)).cast("long").alias("cohort_size"),
        F.array_join("selected_talent_ids", ",").alias("cohort"),
    )


def recent_benchmarks(benchmarks: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` newest jobs by id, ``created_at`` as text."""
    return benchmarks.orderBy(F.col("job_vacancy_id").desc()).limit(n).select(
        "job_vacancy_id", "role_name", "job_level",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def peek(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, in a repeatable order when ``order_by`` is given
    (a per-task top-k, not a global sort)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def employee_directory(t: TalentTables, ordered: bool = True) -> DataFrame:
    """``label, employee_id, fullname`` with label 'Full Name (id)', by name."""
    directory = t.employees.select(
        F.concat(F.col("fullname"), F.lit(" ("), F.col("employee_id"), F.lit(")")).alias("label"),
        "employee_id",
        "fullname",
    )
    return directory.orderBy("fullname", "employee_id") if ordered else directory
