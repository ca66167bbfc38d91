import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def fresh_cache(spark):
    """Plans are compared with everything persisted, so nothing is kept between tests."""
    spark.catalog.clearCache()


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples, floats rounded."""

    def read(df, digits=6):
        out = [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()]
        return sorted(out, key=repr)

    return read
