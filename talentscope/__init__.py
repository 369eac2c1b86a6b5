"""talentscope: people-analytics operators as lazy Spark DataFrame functions.

Layout:
  sources/    table schemas, the table bundle, raw-file readers and writers,
              the mapping from the driver's TPC-H-like tables
  functions/  Column -> Column helpers (rounding, coercion, scoring, text)
  operators/  DataFrame -> DataFrame operators (clean, quality, eda,
              readiness, benchmark, match, insight, ranking)
  plans/      end-to-end pipelines, the named query catalogue and its SQL oracle
"""

from talentscope.session import broadcast_if_small, build_session, checkpoint_root, write_and_read
from talentscope.sources.tables import TalentTables, load_tables, save_tables

__all__ = [
    "TalentTables",
    "broadcast_if_small",
    "build_session",
    "checkpoint_root",
    "load_tables",
    "save_tables",
    "write_and_read",
]
