"""Benchmarks kept as tables, with results per job that are refreshed alone.

A store is a shared folder:

* ``jobs``: one row per job, without its cohort;
* ``cohorts``: (job, employee) rows, partitioned by job, so a cohort of any
  size stays rows and is never an array of one task;
* ``groups`` and ``detail``: the group rates and the trait rows of each job's
  candidates, partitioned by job.

A changed cohort overwrites that job's partitions alone (dynamic partition
overwrite), and a reader of one job reads one partition.  The exported
benchmark table with its arrays is made by ``benchmark.export_benchmarks``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.operators import benchmark, match, traits
from talentscope.operators.benchmark import BenchmarkTables
from talentscope.sources.tables import TalentTables

JOB = "job_vacancy_id"


class BenchmarkStore:
    """Benchmarks of ``t`` under ``path``; ``vectors`` are the written trait vectors of everyone."""

    def __init__(self, spark: SparkSession, path: str, t: TalentTables, vectors: DataFrame):
        self.spark, self.path, self.t, self.vectors = spark, path.rstrip("/"), t, vectors

    @classmethod
    def create(cls, spark: SparkSession, path: str, t: TalentTables, vectors: DataFrame) -> BenchmarkStore:
        """A new store holding the jobs and cohorts of ``t.talent_benchmarks``; no results yet."""
        store, b = cls(spark, path, t, vectors), benchmark.split_benchmarks(t.talent_benchmarks)
        b.jobs.write.mode("errorifexists").parquet(f"{store.path}/jobs")
        b.cohorts.write.mode("errorifexists").partitionBy(JOB).parquet(f"{store.path}/cohorts")
        return store

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Overwrite the partitions of the jobs in ``rows``; other jobs' files stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(JOB).parquet(f"{self.path}/{name}")

    def _drop(self, name: str, job_ids: list[int]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for j in job_ids:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{JOB}={j}")
            p.getFileSystem(conf).delete(p, True)

    def benchmarks(self) -> BenchmarkTables:
        return BenchmarkTables(self._read("jobs"), self._read("cohorts").select(F.col(JOB).cast("int").alias(JOB), "employee_id"))

    def set_cohort(self, job_id: int, talent_ids: DataFrame) -> None:
        """Replace one job's cohort (an empty one leaves the job without) and refresh that job."""
        if talent_ids.isEmpty():
            self._drop("cohorts", [job_id])
        else:
            self._replace("cohorts", benchmark.cohort_rows(job_id, talent_ids))
        self.refresh([job_id])

    def add_job(self, role_name: str, job_level: str, role_purpose: str, talent_ids: DataFrame, created_at: dt.datetime | None = None) -> int:
        """Append a job and its cohort, compute its results, return its id."""
        new, job_id = benchmark.new_job(self.benchmarks().jobs, role_name, job_level, role_purpose, talent_ids, created_at or dt.datetime.now().replace(microsecond=0))
        new.write.mode("append").parquet(f"{self.path}/jobs")
        self._replace("cohorts", benchmark.cohort_rows(job_id, talent_ids))
        self.refresh([job_id])
        return job_id

    def refresh(self, job_ids: list[int] | None = None) -> None:
        """Compute the results of the given jobs (default: all) and overwrite their partitions."""
        b = self.benchmarks()
        jobs = job_ids if job_ids is not None else [r[0] for r in b.jobs.select(JOB).collect()]
        base = match.baselines(self.t, cohort=b.cohorts.where(F.col(JOB).isin(jobs)), vectors=self.vectors)
        sets, mine = traits.job_sets(base), F.col(JOB).isNotNull()
        self._replace("groups", traits.match_groups(self.vectors, sets).where(mine))
        self._replace("detail", match.detail_view(traits.match_detail(self.vectors, sets)).where(mine))
        rated = {r[0] for r in base.select(JOB).distinct().collect()}  # some of the given jobs
        for name in ("groups", "detail"):
            self._drop(name, [j for j in jobs if j not in rated])

    def groups(self, job_id: int) -> DataFrame:
        """The group table of one job: one partition."""
        return self._read("groups").where(F.col(JOB) == job_id)

    def detail(self, job_id: int) -> DataFrame:
        """The trait rows of one job's candidates, rounded: one partition."""
        return self._read("detail").where(F.col(JOB) == job_id)
