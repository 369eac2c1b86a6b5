"""Every named query agrees with its independent SQL (DuckDB) on the driver's
smallest tables: same rows, column names, types and values."""

import pytest
from helpers import SF_SMALL
from oracle_compare import compare, duck

import __spark_entry__ as entry_mod
from talentscope.plans.catalog import QUERIES
from talentscope.plans.oracle import ROWS_ONLY

ORACLE = {k: v for k, v in entry_mod.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(QUERIES) == set(ORACLE) | set(ROWS_ONLY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    problems = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert not problems, "\n".join(problems)


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "rank_in_year" in df.columns
