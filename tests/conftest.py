import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skarn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, partitions=4, memory="4g")


@pytest.fixture
def values(spark):
    """values(expressions, rows, ddl) -> list of tuples of these expressions over rows."""

    def run(columns, rows, ddl):
        return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]

    return run
