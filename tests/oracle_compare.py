"""Run a named Spark query and its DuckDB oracle on the same parquet folder
and compare row count, column names and types, and values (order-free)."""

from __future__ import annotations

import math

import duckdb

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return v.item()
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(type(x).__name__), x) for x in row)


def compare(spark_df, con, sql: str, rows_only: bool = False) -> list[str]:
    """Return a list of problems (empty when the results agree)."""
    problems = []
    s_cols = spark_df.columns
    s_types = dict(spark_df.dtypes)
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows_raw = res.fetchall()
    d_types = {d[0]: str(d[1]) for d in res.description}
    if len(s_rows) != len(d_rows_raw):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows_raw)}")
    if rows_only:
        return problems
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems
    for c in s_cols:
        want = SPARK_TO_DUCK.get(s_types[c], s_types[c])
        if want != d_types[c]:
            problems.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    idx = [d_cols.index(c) for c in sorted(s_cols)]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in d_rows_raw]
    a, b = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    if a != b:
        sa, sb = set(a), set(b)
        only_s = [r for r in a if r not in sb][:3]
        only_d = [r for r in b if r not in sa][:3]
        problems.append(f"values differ; cols={sorted(s_cols)}\n  spark-only {only_s}\n  duck-only  {only_d}")
    return problems
