from __future__ import annotations

import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a small table: ``rows([(1, "a")], "id int, name string")``."""
    return lambda data, schema: spark.createDataFrame(data, schema)
