import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """Build a table from rows and a schema."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make
