import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from talentscope.session import build_session

    s = build_session("local[4]", app_name="talentscope-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield s
    s.stop()
