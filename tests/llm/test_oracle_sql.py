"""The queries that SQL expresses agree with it, and every query and stage is registered."""

import os
import sys

import pytest
from llm_cases import SF

import __spark_entry__ as entry
import corpus_pipeline

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_compare import compare, duck  # noqa: E402

from talentscope.llm.oracle import ORACLE  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert not compare(entry.queries()[name](spark, SF), duck(SF), ORACLE[name])


def test_registered():
    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "secret_scan", "packing"]
