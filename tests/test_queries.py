"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from millrace.functions.tokens import random_id

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    found = differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    # at the smallest scale a selective query may have nothing to return
    assert [f for f in found if "proves nothing" not in f] == []


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["app_id", "business_date", "total_amount"]


def test_random_id(spark):
    out = entry.queries()["random_id"](spark, SF_DIR)
    assert out.where("NOT in_range").isEmpty()
    assert spark.range(50).select(random_id().alias("n")).distinct().count() > 1
