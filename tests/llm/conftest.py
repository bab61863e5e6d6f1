import pytest


@pytest.fixture()
def frame(spark):
    """A table from rows and a schema, in several partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
