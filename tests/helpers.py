"""Build tiny talent-table bundles from Python rows."""

from __future__ import annotations

from talentscope.sources import schemas
from talentscope.sources.tables import TalentTables

SF_SMALL = "/root/testdata/sf0.001"

DEFAULT_DIMS = {
    "dim_grades": [(1, "G1")],
    "dim_divisions": [(1, "Div1")],
    "dim_education": [(1, "E1")],
    "dim_directorates": [(1, "Dir1")],
    "dim_positions": [("POS", "Role1")],
    "dim_competency_pillars": [("P1", "Pillar One"), ("P2", "Pillar Two")],
}


def tables(spark, **rows) -> TalentTables:
    kw = {}
    for name, schema in schemas.TABLE_SCHEMAS.items():
        data = rows.get(name, DEFAULT_DIMS.get(name, []))
        kw[name] = spark.createDataFrame(data, schema)
    return TalentTables(**kw)


def emp(eid: str, division: int = 1, grade: int | None = 1):
    return (eid, f"Name {eid}", 1, 1, "POS", 1, division, 1, grade, 1, 1, 12.0)


def psych(eid: str, iq: float, gtq: float, tiki: float = 5.0):
    return (eid, 50.0, 5.0, iq, gtq, tiki, "D", "Dominant", "INTJ")


def bench(job: int, ids):
    import datetime as dt

    return (job, f"Job {job}", "L", "purpose", ids, "{}", dt.datetime(2025, 1, job, 9, 0, 0))
