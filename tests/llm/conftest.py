import os
import sys

import pytest
from llm_cases import ODD, SCHEMA, SF

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from talentscope.session import build_session

    s = build_session("local[4]", app_name="llm-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("score", "node", "gram", "n", "kept", "_s", "_row", "_t", "hits", "curve", "salt", "lang_pred", "ids", "component_id", "good"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, None), (99, 0, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
