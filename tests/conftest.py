import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sugartrace.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("sugartrace-tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows and a DDL schema to a DataFrame spread over a few partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


def collect(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr) if not order else [
        tuple(r) for r in df.orderBy(*order).collect()
    ]
