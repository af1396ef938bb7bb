import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from taxilens.session import build_session
    wh = str(tmp_path_factory.mktemp("warehouse"))
    s = build_session("local[*]", app="taxilens-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g", "spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("taxilens"))
