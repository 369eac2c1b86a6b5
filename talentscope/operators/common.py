"""Building blocks shared by several operator families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope.sources.tables import TalentTables


def latest_year(perf: DataFrame) -> DataFrame:
    """``employee_id, latest_year``: each person's most recent rated year.

    A plain aggregate (partial max before the shuffle), so a person with
    millions of rows costs one row per map task, not one task.
    """
    return perf.groupBy("employee_id").agg(F.max("year").alias("latest_year"))


def at_latest_year(facts: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows of a yearly fact table that fall in the person's latest year.

    Same rows as an inner join on (id, year), repeated rows included, but
    joined on the id alone and then filtered: the result stays
    hash-partitioned by ``employee_id``, so later per-person aggregates and
    joins need no further shuffle.  One side has one row per id, so a hot id
    is split by AQE's skew join rather than landing in one task.
    """
    ly = latest.select(F.col("employee_id").alias("_ly_id"), F.col("latest_year").alias("_ly_year"))
    return (
        facts.join(ly, F.col("employee_id") == F.col("_ly_id"))
        .filter(F.col("year") == F.col("_ly_year"))
        .drop("_ly_id", "_ly_year")
    )


def high_performer_rows(perf: DataFrame, rating: float = 5.0) -> DataFrame:
    """Every performance row with the given rating (duplicates kept)."""
    return perf.filter(F.col("rating") == rating)


def high_performers(perf: DataFrame, rating: float = 5.0) -> DataFrame:
    """Distinct ``(employee_id, year)`` pairs with the given rating."""
    return high_performer_rows(perf, rating).select("employee_id", "year").dropDuplicates()


def dim_lookup(t: TalentTables, dim: str) -> tuple[DataFrame, str]:
    """(dimension table, its key column) for a dimension short name."""
    table = {
        "grade": (t.dim_grades, "grade_id"),
        "division": (t.dim_divisions, "division_id"),
        "education": (t.dim_education, "education_id"),
        "directorate": (t.dim_directorates, "directorate_id"),
        "position": (t.dim_positions, "position_id"),
    }
    return table[dim]
