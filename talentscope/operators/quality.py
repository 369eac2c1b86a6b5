"""Data-quality checks: missing values, duplicates, key uniqueness, range
and reference rules, and column summaries.  Each is one or two passes of
aggregates over the table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from talentscope.functions.numeric import rnd, to_number
from talentscope.functions.text import is_missing_text
from talentscope.operators.quantiles import exact_quantiles, melted
from talentscope.session import attach_one_row


def _is_missing(df: DataFrame, c: str) -> F.Column:
    col = F.col(c)
    if isinstance(df.schema[c].dataType, NumericType):
        return col.isNull()
    return is_missing_text(col.cast("string"))


def missing_report(df: DataFrame) -> DataFrame:
    """``column_name, n_missing``: what a CSV reader takes as missing, per column, one pass."""
    counts = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_missing")


def missing_before_after(raw: DataFrame, clean: DataFrame, col: str) -> DataFrame:
    """``missing_before, missing_after``: share of unusable values of ``col``
    in the raw export (not a number) and after cleaning (NULL)."""
    before = raw.agg(F.avg(to_number(col).isNull().cast("double")).alias("missing_before"))
    after = clean.agg(F.avg(F.col(col).isNull().cast("double")).alias("missing_after"))
    return attach_one_row(before, after).select(rnd("missing_before", 4).alias("missing_before"),
                                          rnd("missing_after", 4).alias("missing_after"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once (all copies kept).

    The repeated keys come from a grouped count (combined map-side, so a
    key holding a third of the table costs one row per task) and select
    rows by a semi join that AQE may split when a key is hot.  NULL equals
    NULL: the keys meet as one struct, whose hash and equality both sides
    share.  ``df`` is read twice, so it should be a written table.
    """
    keyed = df.withColumn("_key", F.struct(*keys))
    dup_keys = keyed.groupBy("_key").count().filter(F.col("count") > 1).select("_key")
    return keyed.join(dup_keys, "_key", "left_semi").drop("_key")


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """``n_unique, n_rows``."""
    return df.agg(F.countDistinct(key).alias("n_unique"), F.count(F.lit(1)).alias("n_rows"))


def range_violations(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Rows with ``col < lo or col > hi``."""
    return df.filter((F.col(col) < lo) | (F.col(col) > hi))


def missing_reference(df: DataFrame, col: str, show: list[str]) -> DataFrame:
    """``show`` columns of rows whose ``col`` is NULL."""
    return df.filter(F.col(col).isNull()).select(*show)


def describe(df: DataFrame, numeric_cols: list[str], text_cols: list[str] | None = None) -> DataFrame:
    """One row per column: ``column_name, count, n_unique, top, freq, mean,
    std, min, p25, p50, p75, max`` (text stats NULL for numbers and the
    reverse).  Quartiles are exact and interpolated, the columns' ranks
    narrowed together as groups of one long table; ``top`` is the most
    frequent value, ties by smallest value."""
    text_cols = text_cols or []
    rows = []
    if numeric_cols:
        x, long = F.col("x"), melted(df, numeric_cols, "column_name")
        stats = long.groupBy("column_name").agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        q = exact_quantiles(long, ["column_name"], "x", [0.25, 0.5, 0.75]).select("column_name", "q")
        q = F.broadcast(q)  # one row a column
        names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in numeric_cols])).alias("column_name"))  # columns of an empty table too
        rows.append(names.join(stats, "column_name", "left").join(q, "column_name", "left").select(
            "column_name", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            F.lit(None).cast("long").alias("n_unique"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
            rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), "min",
            *[rnd(F.col("q")[i], 4).alias(n) for i, n in enumerate(["p25", "p50", "p75"])], "max"))
    if text_cols:
        # one scan for all text columns: (column, value) pairs, counted per
        # value (combined map-side), then summarised per column
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in text_cols
        ])).alias("p")).select("p.*").filter(F.col("v").isNotNull())
        freq = pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        rows.append(freq.groupBy("column_name").agg(
            F.sum("n").cast("long").alias("count"), F.count(F.lit(1)).alias("n_unique"),
            F.min_by(F.col("v"), F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq"),
        ).select(
            "column_name", "count", "n_unique", "top", "freq",
            *[F.lit(None).cast("double").alias(s) for s in ["mean", "std", "min", "p25", "p50", "p75", "max"]],
        ))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
