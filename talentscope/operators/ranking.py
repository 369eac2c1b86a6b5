"""Rank and cumulative share within a partition, without a per-partition window.

``DENSE_RANK() OVER (PARTITION BY p ORDER BY v DESC)`` and
``CUME_DIST() OVER (PARTITION BY p ORDER BY v)`` sort every row of a
partition in one task.  When ``p`` is a year, one task would hold most of
the data.  Both results depend only on how many rows hold each value, so:

1. count rows per (p, v) and range-partition the counts by (p, v), written
   with the number of their range  -- a value is one row, however frequent;
2. rank and cumulate inside each (range, p)  -- no task holds a whole p;
3. add each range's offset: the values and rows of p in lower ranges, from
   one row per (range, p);
4. join the result back on (p, v)  -- null-safe, so NULL values match.

So the values may be continuous: with a distinct value per row, each task
still holds one range.  The ranked values are measured before they are
broadcast, and the join falls back to a shuffle join beyond the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentscope.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small, write_and_read


def ranked_values(df: DataFrame, partition_cols: list[str], value_col: str) -> DataFrame:
    """One row per (partition, value) of ``df``, columns prefixed ``_h_``:
    ``_h_value``, ``_h_place`` (dense, ascending, NULL last), ``_h_places``
    (values of the partition), ``_h_null`` (1 for the NULL value),
    ``_h_nulls``, ``_h_upto`` (rows at or below) and ``_h_rows`` (all rows)."""
    keys = [f"_h_{c}" for c in partition_cols]
    counts = df.groupBy(*[F.col(c).alias(k) for c, k in zip(partition_cols, keys)], F.col(value_col).alias("_h_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = counts.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], F.col("_h_value").asc_nulls_last())
    # written: the number of a range must stay the same for its rows and its offset
    ranges = write_and_read(ranges.withColumn("_range", F.spark_partition_id()), "ranked_ranges")
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    null = F.col("_h_value").isNull().cast("long")
    offsets = ranges.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_s"), F.sum(null).alias("_e")).select(
        F.col("_range").alias("_o_range"), *[F.col(k).alias(f"_o{k}") for k in keys],
        F.coalesce(F.sum("_d").over(below), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_s0"),
        F.sum("_d").over(whole).alias("_h_places"), F.sum("_s").over(whole).alias("_h_rows"), F.sum("_e").over(whole).alias("_h_nulls"))
    own = Window.partitionBy("_range", *keys).orderBy(F.col("_h_value").asc_nulls_last())
    local = ranges.select("*", F.row_number().over(own).alias("_i"), F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_c"))
    same = F.col("_range") == F.col("_o_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o{k}"))
    return local.join(broadcast_if_small(offsets), same).select(
        *keys, "_h_value", (F.col("_d0") + F.col("_i")).alias("_h_place"), "_h_places", null.alias("_h_null"), "_h_nulls",
        (F.col("_s0") + F.col("_c")).alias("_h_upto"), "_h_rows")


def dense_rank_and_cume_dist(
    df: DataFrame,
    partition_cols: list[str],
    value_col: str,
    rank_col: str = "rank",
    cume_col: str = "cume_dist",
    desc_nulls_first: bool = True,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
) -> DataFrame:
    """Add ``rank_col`` (dense rank, value descending, NULLs first as in
    SQL ``DESC``) and ``cume_col`` (share of rows <= value, ascending with
    NULLs last) to every row of ``df``."""
    # places ascend with NULL as the last one, so descending with NULLs first is their mirror
    place, places = F.col("_h_place"), F.col("_h_places")
    rank = places - place + 1
    if not desc_nulls_first:
        rank = F.when(F.col("_h_null") == 1, places).otherwise(rank - F.col("_h_nulls"))
    hist = ranked_values(df, partition_cols, value_col).select(
        *[f"_h_{c}" for c in partition_cols], "_h_value", rank.cast("int").alias(rank_col),
        (F.col("_h_upto") / F.col("_h_rows")).alias(cume_col))
    hist = broadcast_if_small(hist, max_broadcast_bytes)
    cond = F.col(value_col).eqNullSafe(F.col("_h_value"))
    for c in partition_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return df.join(hist, cond).drop(*[f"_h_{c}" for c in partition_cols], "_h_value")
