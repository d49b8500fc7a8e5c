import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanforge.session import get_spark  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "3g", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALL).exists():
        pytest.skip("no test data here")
    return SMALL
