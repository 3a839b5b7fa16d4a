import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from backtrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BACKTRAIL_DRIVER_MEMORY", "4g")
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Build a frame from rows and a schema string; plain values, NULL as None."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
