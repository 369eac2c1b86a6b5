"""The bundle of talent tables every operator reads from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from talentscope.sources.schemas import TABLE_SCHEMAS

CLEAN_TABLES = tuple(TABLE_SCHEMAS)
RAW_TABLES = (
    "raw_employees",
    "raw_performance_yearly",
    "raw_competencies_yearly",
    "raw_profiles_psych",
    "raw_papi_scores",
)


@dataclass(frozen=True)
class TalentTables:
    """Lazy DataFrames of the star schema.

    Facts are keyed by ``employee_id`` (and ``year`` where yearly); the
    ``dim_*`` tables are small lookups.  ``raw_*`` are the untyped exports
    the cleaning operators start from; they may be absent.
    """

    employees: DataFrame
    performance_yearly: DataFrame
    competencies_yearly: DataFrame
    profiles_psych: DataFrame
    papi_scores: DataFrame
    strengths: DataFrame
    dim_grades: DataFrame
    dim_divisions: DataFrame
    dim_education: DataFrame
    dim_directorates: DataFrame
    dim_positions: DataFrame
    dim_competency_pillars: DataFrame
    talent_benchmarks: DataFrame
    raw_employees: DataFrame | None = None
    raw_performance_yearly: DataFrame | None = None
    raw_competencies_yearly: DataFrame | None = None
    raw_profiles_psych: DataFrame | None = None
    raw_papi_scores: DataFrame | None = None

    def names(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]

    def map(self, fn: Callable[[str, DataFrame], DataFrame]) -> TalentTables:
        """Apply ``fn(name, df)`` to every present table (e.g. to materialise)."""
        return replace(self, **{n: fn(n, getattr(self, n)) for n in self.names()})

    def with_benchmarks(self, benchmarks: DataFrame) -> TalentTables:
        return replace(self, talent_benchmarks=benchmarks)


#: Names under which exports carry a column, tried in turn where the table lacks it.
OTHER_NAMES = {("dim_competency_pillars", "pillar_label"): ["name"], ("profiles_psych", "disc_word"): ["disc"]}


def _named_schema(spark: SparkSession, name: str, schema: StructType, fmt: str, path: str) -> tuple[StructType, dict[str, str]]:
    """The schema by the file's own column names, and which column each renamed one is.

    Only formats that store their column names are looked at (one footer)."""
    wanted = [(col, other) for (table, col), other in OTHER_NAMES.items() if table == name]
    if not wanted or fmt not in ("parquet", "orc"):
        return schema, {}
    present = set(spark.read.format(fmt).load(path).columns)
    source = {col: next((o for o in other if o in present), col) for col, other in wanted if col not in present}
    kept = [f for f in schema.fields if f.name not in source]
    return StructType(kept + [StructField(o, schema[c].dataType, True) for c, o in source.items() if o not in {f.name for f in kept}]), source


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet", max_dim_bytes: int | None = None) -> TalentTables:
    """Read a folder holding one sub-folder per talent table, with explicit
    schemas.  A pillar table with ``name`` for ``pillar_label``, or profiles with
    ``disc`` alone for ``disc_word``, load as well.  Each ``dim_*`` table is measured once here and marked for
    broadcast when it is small enough."""
    from talentscope.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small

    kw = {}
    for name, schema in TABLE_SCHEMAS.items():
        folder = f"{path.rstrip('/')}/{name}"
        read, source = _named_schema(spark, name, schema, fmt, folder)
        df = spark.read.schema(read).format(fmt).load(folder)
        if source:
            df = df.select(*[F.col(source.get(c, c)).alias(c) for c in schema.names])
        kw[name] = broadcast_if_small(df, max_dim_bytes or DEFAULT_BROADCAST_BYTES) if name.startswith("dim_") else df
    return TalentTables(**kw)


def save_tables(tables: TalentTables, path: str, mode: str = "overwrite") -> None:
    """Write every table as parquet under ``path/<name>``."""
    for name in tables.names():
        getattr(tables, name).write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
