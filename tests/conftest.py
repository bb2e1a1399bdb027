import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from catalog.session import local_session

    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Make a DataFrame from (schema, row, row, ...)."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column function on one row of texts."""

    def run(fn, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(fn(*[f"c{i}" for i in range(len(values))]).alias("r")).first()[0]

    return run
