"""Cleaning raw (all-string) exports into typed tables.

Medians are exact and interpolated (pandas ``median``), found by narrowing
ranks (``quantiles.exact_quantiles``), whose state doesn't grow with the
distinct values; ``exact=False`` takes ``percentile_approx`` in one scan.
Group medians are joined back on the group key, never a window: a window
would put a whole pillar or scale, possibly most of the table, in one task.
They are written and measured (``small_aggregate``) and broadcast back, so
the rows are never shuffled by their few group codes.  The texts are parsed
once: the medians' passes and the fill read the written numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from talentscope.functions.numeric import rnd_even, strip_ws, to_int, to_number
from talentscope.functions.text import column_names, fill_disc, missing_to_unknown
from talentscope.operators.quantiles import column_medians, group_medians
from talentscope.session import attach_one_row, small_aggregate, write_and_read
from talentscope.sources import schemas

EMPLOYEE_NUMERIC = [f.name for f in schemas.EMPLOYEES.fields if isinstance(f.dataType, NumericType)]
PSYCH_NUMERIC = ["pauli", "faxtor", "iq", "gtq", "tiki"]
PSYCH_TEXT = ["disc", "disc_word", "mbti"]


def standardize_columns(df: DataFrame) -> DataFrame:
    """Standard column names (``column_names``); a rename only, no data moves."""
    return df.toDF(*column_names(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise if any required column is missing; return ``df`` unchanged."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Turn the listed string columns into doubles, bad values into NULL."""
    present = set(df.columns)
    return df.select(*[to_number(c).alias(c) if c in cols and c in present else F.col(c) for c in df.columns])


def clean_employees(raw: DataFrame) -> DataFrame:
    """Standardised names, numeric ids and service months coerced."""
    return coerce_numeric(standardize_columns(raw), EMPLOYEE_NUMERIC)


def impute_global_median(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """NULLs of ``col`` become the column's median (one row, broadcast)."""
    med = group_medians(df, [], col, exact)
    return attach_one_row(df, med).withColumn(col, F.coalesce(F.col(col), F.col("_med"))).drop("_med")


def clean_performance(raw: DataFrame, exact: bool = True) -> DataFrame:
    """``employee_id, year, rating``: rating coerced, missing -> global median."""
    df = standardize_columns(raw).select(
        "employee_id", to_int("year").alias("year"), to_number("rating").alias("rating"))
    df = write_and_read(df, "parsed_performance")
    return impute_global_median(df, "rating", exact)


def clean_competencies(raw: DataFrame, fallback: float = 3.0, exact: bool = True) -> DataFrame:
    """``employee_id, year, pillar_code, score``: missing score -> the
    pillar's median, else ``fallback``; then half-even to one place."""
    df = require_columns(standardize_columns(raw), ["employee_id", "year", "pillar_code", "score"]).select(
        "employee_id", to_int("year").alias("year"), "pillar_code",
        to_number("score").alias("score"),
    )
    df = write_and_read(df, "parsed_competencies")
    med = small_aggregate(group_medians(df.withColumnRenamed("pillar_code", "_key"), ["_key"], "score", exact))
    # plain equality: a row without a pillar code gets no pillar median (a
    # grouped pandas transform leaves it missing too) and takes the fallback
    return df.join(med, F.col("pillar_code") == F.col("_key"), "left").select(
        "employee_id", "year", "pillar_code",
        rnd_even(F.coalesce(F.col("score"), F.col("_med"), F.lit(fallback)), 1).alias("score"),
    )


def clean_profiles(raw: DataFrame, exact: bool = True) -> DataFrame:
    """Psych numbers coerced, missing -> their own median (all five narrowed
    together); missing texts -> 'Unknown'; DISC code filled from the
    DISC phrase where unknown."""
    df = standardize_columns(raw)
    df = df.select("employee_id", *[to_number(c).alias(c) for c in PSYCH_NUMERIC],
                   *[F.col(c) for c in PSYCH_TEXT])
    df = write_and_read(df, "parsed_profiles")
    meds = column_medians(df, PSYCH_NUMERIC, exact).toDF(*[f"_m_{c}" for c in PSYCH_NUMERIC])
    return attach_one_row(df, meds).select(
        "employee_id",
        *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in PSYCH_NUMERIC],
        fill_disc("disc", "disc_word").alias("disc"),
        missing_to_unknown("disc_word").alias("disc_word"),
        missing_to_unknown("mbti").alias("mbti"),
    )


def clean_papi(raw: DataFrame, exact: bool = True) -> DataFrame:
    """``employee_id, scale_code, score``: all whitespace trimmed, score
    coerced, missing -> the scale's median, then -> the median of the
    column as filled so far."""
    df = standardize_columns(raw).select(
        strip_ws("employee_id").alias("employee_id"),
        strip_ws("scale_code").alias("scale_code"),
        to_number("score").alias("score"),
    )
    df = write_and_read(df, "parsed_papi")
    med = small_aggregate(group_medians(df.withColumnRenamed("scale_code", "_key"), ["_key"], "score", exact))
    filled = df.join(med, F.col("scale_code") == F.col("_key"), "left").select(
        "employee_id", "scale_code", F.coalesce(F.col("score"), F.col("_med")).alias("score"))
    return impute_global_median(filled, "score", exact)


def clean_disc(raw_profiles: DataFrame) -> DataFrame:
    """``employee_id, disc, disc_word, disc_filled``: the DISC rule alone."""
    df = standardize_columns(raw_profiles)
    return df.select("employee_id", "disc", "disc_word", fill_disc("disc", "disc_word").alias("disc_filled"))
