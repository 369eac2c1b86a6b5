"""Raw exports in, results out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.sources.schemas import StructType, all_strings


def read_raw(spark: SparkSession, path: str, schema: StructType | None = None, columns: list[str] | None = None,
             sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Read a CSV export with a header, every column as text.

    Give ``schema`` (its names are kept, its types turned into strings) or
    ``columns``; with neither, the header names are used, still as text.
    Nothing is inferred, so a stray word in a number column cannot change
    the column type; ``operators.clean`` coerces afterwards.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(all_strings(schema)).csv(path)
    if columns is not None:
        return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return reader.option("inferSchema", False).csv(path)


@dataclass(frozen=True)
class CheckedRows:
    """``fitting``: rows with as many fields as the schema, all text.
    ``rejected``: the other lines as they are (``line``, ``n_fields``)."""

    fitting: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """``fits, n_fields, n_rows``: how many lines have how many fields."""
        fit = self.fitting.select(F.lit(True).alias("fits"), F.lit(len(self.fitting.columns)).alias("n_fields"))
        return fit.union(self.rejected.select(F.lit(False), "n_fields")).groupBy("fits", "n_fields").agg(F.count(F.lit(1)).alias("n_rows"))


def read_raw_checked(spark: SparkSession, path: str, schema: StructType | None = None, columns: list[str] | None = None,
                     sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> CheckedRows:
    """Read a CSV export like ``read_raw``, but keep apart the lines with too
    few or too many fields, which ``read_raw`` pads or cuts.

    The reader puts such a line into a corrupt-record column, so both parts
    are filters of one scan and nothing is shuffled.  ``schema`` or ``columns``
    must be given: without them there is nothing for a line to fit.
    """
    names = schema.names if schema is not None else columns
    if not names:
        raise ValueError("give schema or columns")
    bad = "_rejected_line"
    while bad in names:
        bad = f"_{bad}"
    rows = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", bad).schema(", ".join(f"`{c}` string" for c in [*names, bad])).csv(path))
    line = F.col(f"`{bad}`")
    unquoted = F.regexp_replace(line, r'"([^"\\]|\\.|"")*"', "")
    n_fields = (F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))) / len(sep) + 1
    # Spark refuses queries that read the corrupt-record column alone, compares only the fields that are read
    # with the line, and would push IS [NOT] NULL into the parser, where the column is still empty
    rows = rows.where(F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in names])) >= 0)
    rejected = F.coalesce(F.length(line), F.lit(-1)) >= 0
    return CheckedRows(rows.where(~rejected).select(*[F.col(f"`{c}`") for c in names]),
                       rows.where(rejected).select(line.alias("line"), n_fields.cast("int").alias("n_fields")))


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None,
           order_by: list | None = None, rows_per_file: int = 0) -> None:
    """Write a result as parquet or CSV (one part file per task, never
    gathered into a single file on one machine).  With ``order_by`` the rows
    are range-partitioned and sorted, so the part files in name order hold
    the result in order.  With ``partition_by`` as well, the ranges are taken
    over (partition columns, order), so the files of each partition folder in
    name order are in order too, and a folder with most rows is spread over
    several tasks; give an id as the last order column if many rows are equal
    in the others.  ``rows_per_file`` splits files further (0: no limit)."""
    if order_by and partition_by:
        keys = [*[F.col(c).asc_nulls_first() for c in partition_by], *order_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    elif order_by:
        df = df.orderBy(*order_by)
    w = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
