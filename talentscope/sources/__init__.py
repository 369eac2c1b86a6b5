"""Schemas, the table bundle, file readers/writers and the driver-table mapping."""

from talentscope.sources.files import CheckedRows, export, read_raw, read_raw_checked
from talentscope.sources.mapping import from_driver_tables
from talentscope.sources.schemas import TABLE_SCHEMAS
from talentscope.sources.tables import TalentTables, load_tables, save_tables

__all__ = ["TABLE_SCHEMAS", "CheckedRows", "TalentTables", "export", "from_driver_tables", "load_tables", "read_raw", "read_raw_checked", "save_tables"]
