"""Session settings, the shared checkpoint folder, and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a side we are willing to broadcast after measuring it.
DEFAULT_BROADCAST_BYTES = 64 * 2**20

_written: list[str] = []  # every path of released_path, for release()


def build_session(master: str | None = None, app_name: str = "talentscope",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with AQE (coalescing, skew joins) on and the web UI off."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only a local session with no setting gets a
    folder of its own under the system temp dir (tests); on a cluster a
    missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():  # set only as a runtime conf: apply it to the context
            sc.setCheckpointDir(configured)
        # the configured root, not the per-context sub-folder Spark adds, so
        # tables written by one session stay findable from the next
        return configured
    d = sc.getCheckpointDir()
    if d:
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or S3)")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="talentscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/talentscope/{uuid.uuid4().hex}/{name}"


def released_path(spark: SparkSession, name: str) -> str:
    """A new table path that ``release`` deletes."""
    path = new_table_path(spark, name)
    _written.append(path)
    return path


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of
    recomputing the whole upstream plan) and gives later scans real file
    statistics, pushdown and pruning.  ``release`` deletes the files.
    """
    spark = df.sparkSession
    path = released_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def delete_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete tables through the Hadoop FileSystem API (HDFS, object stores,
    local); returns how many were there."""
    jvm, conf, removed = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p).getParent()  # each table has a folder of its own
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.delete(path, True):
            removed += 1
    return removed


def release_written(spark: SparkSession) -> int:
    """Delete every table under a ``released_path`` of this process."""
    paths, _written[:] = list(_written), []
    return delete_paths(spark, paths)


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` as rows in memory: 16 bytes a row, 8 a value, and the
    measured length of texts and arrays.  One aggregate over ``df``."""
    parts = [F.count(F.lit(1)) * F.lit(16 + 8 * len(df.columns))]
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)))
        elif kind.startswith("array"):
            parts.append(F.coalesce(F.sum(F.greatest(F.size(F.col(c)), F.lit(0)) * 32), F.lit(0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return int(df.agg(total.alias("n")).first()["n"])


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` only after measuring its bytes; otherwise leave the
    join to the planner (sort-merge with AQE skew handling).

    Runs one aggregate when called, so ``df`` must be cheap to read: a small
    table, an aggregate over a written input, or a written result.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def small_aggregate(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """A group-level aggregate that will be joined back to its rows on a
    low-cardinality key (a pillar, a scale): written once, so its input is
    scanned once, measured, and broadcast when small.

    Without this the planner estimates the aggregate as large as its input
    and plans a sort-merge join, which shuffles the raw rows by a key with
    a handful of values -- a few enormous tasks at scale.
    """
    return broadcast_if_small(write_and_read(df, "aggregate"), max_bytes)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame (a global aggregate: bounds,
    medians, a new id) to every row of ``df``.

    ``one_row`` must be an aggregate without grouping keys, which returns
    exactly one row by definition, so this is a broadcast of one row: no
    pairs are formed and nothing grows with the data.
    """
    return df.crossJoin(F.broadcast(one_row))
