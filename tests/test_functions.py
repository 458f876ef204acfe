"""Dates, placeholders and names."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import templating as t, tokens
from millrace.plans.context import RunContext

DAY = dt.date(2026, 4, 16)
FORMATS = {
    "YYYYMMDD": "20260416",
    "YYYY-MM-DD": "2026-04-16",
    "YYYYMM": "202604",
    "YYYY/MM/DD": "2026/04/16",
    "DD/MM/YYYY": "16/04/2026",
    "MM/DD/YYYY": "04/16/2026",
    "unknown": "20260416",
}


@pytest.mark.parametrize("name", FORMATS)
def test_formats(spark, name):
    assert t.format_date(DAY, name) == FORMATS[name]
    assert spark.range(1).select(t.format_date_col(F.lit(DAY), name)).first()[0] == FORMATS[name]


RANGES = [
    ("2026-04-16", "single", "2026-04-16", "2026-04-16"),
    ("2026-04-16", "current_month", "2026-04-01", "2026-04-30"),
    ("2025-02-14", "current_month", "2025-02-01", "2025-02-28"),
    ("2024-02-14", "current_month", "2024-02-01", "2024-02-29"),
    ("2026-12-15", "current_month", "2026-12-01", "2026-12-31"),
    ("2026-01-15", "previous_month", "2025-12-01", "2025-12-31"),
    ("2024-03-31", "previous_month", "2024-02-01", "2024-02-29"),
    ("2026-04-16", "custom", "2026-04-16", "2026-04-16"),
    ("2026-04-16", "no such mode", "2026-04-16", "2026-04-16"),
]


@pytest.mark.parametrize("day,mode,first,last", RANGES)
def test_ranges(spark, day, mode, first, last):
    base = dt.date.fromisoformat(day)
    assert [d.isoformat() for d in t.date_range(base, mode)] == [first, last]
    cols = t.date_range_cols(F.lit(base), mode)
    assert [d.isoformat() for d in spark.range(1).select(*cols).first()] == [first, last]


def test_custom_range():
    sql, values = t.render_sql("$business_date_range", "2026-04-16", mode="custom", range_from="2026-01-01",
                               range_to="2026-02-28")
    assert sql == "BETWEEN 20260101 AND 20260228" and values["$business_date"] == "20260416"


def test_longer_names_are_replaced_first():
    sql = "$business_date $business_date_from $business_date_to $app_id $app_name"
    text, _ = t.render_sql(sql, "2026-04-16", mode="current_month", app_id="A1", app_name="Desk")
    assert text == "20260416 20260401 20260430 A1 Desk"
    assert t.render_sql("no names", None) == ("no names", {})
    assert t.render_sql("$app_id $business_date", None, app_id="A1")[0] == "A1 $business_date"
    assert t.replace_names("$a $ab", {"a": 1, "$ab": 2}) == "1 2"


def test_quoted_range():
    options = {"date_format": "YYYY-MM-DD", "mode": "current_month"}
    assert t.render_sql("$business_date_range", "2026-04-16", **options)[0] == "BETWEEN 2026-04-01 AND 2026-04-30"
    quoted = t.render_sql("$business_date_range", "2026-04-16", quoted=True, **options)[0]
    assert quoted == "BETWEEN '2026-04-01' AND '2026-04-30'"


def test_context_parameters():
    got = t.context_parameters({"business_date_to": "x"}, "2026/04/16")
    assert got == {"business_date": "20260416", "business_date_from": "2026-04-16", "business_date_to": "x",
                   "business_date_range": "2026-04-16 / 2026-04-16"}
    assert t.context_parameters(None, None) == {}


def test_dates():
    assert t.resolve_dates(["2026-04-16", "2026/04/17"], "2026-01-01", "2026-01-02") == ["20260416", "20260417"]
    assert t.resolve_dates(date_from="2026-02-27", date_to="2026-03-01") == ["20260227", "20260228", "20260301"]
    assert t.resolve_dates(business_date="2026-04-16") == ["20260416"]
    assert t.resolve_dates(date_from="2026-03-01", date_to="2026-02-01", business_date="2026-04-16") == ["20260416"]
    assert len(t.resolve_dates()[0]) == 8


def test_names():
    assert tokens.path_token(" My Market-Data v2.1 ", "X") == "MY_MARKET_DATA_V2_1"
    assert tokens.path_token(" -- ", "X") == "X" and tokens.path_token(None, "X") == "X"
    assert tokens.view_name("2026-04-16", "PIPE/EXTRACT", "App 1") == "2026_04_16__pipe_extract_app_1"
    assert tokens.compact_date("2026/04/16") == "20260416"
    assert tokens.iso_date("20260416") == "2026-04-16" and tokens.iso_date("2026-4") == "2026-4"
    assert tokens.namespace_name("2026-04-16") == "data_20260416"
    assert tokens.namespace_name("2026-04-16", "") == "20260416"
    assert tokens.namespace_name("2026-04-16", "mkt_", "fixed") == "fixed"
    assert tokens.namespace_name(None) is None


def test_run_context():
    ctx = RunContext("2026-04-16", "previous_month", app_id="A1", run_id=3, namespace_prefix="m_")
    assert ctx.runtime() == {
        "business_date": "2026-04-16", "business_date_from": "2026-03-01", "business_date_to": "2026-03-31",
        "app_id": "A1", "app_name": None, "namespace_db": "m_20260416", "run_id": 3, "pipeline_id": None,
    }
    assert ctx.render("$app_id@$business_date_to") == "A1@20260331"
    assert RunContext().bounds is None and RunContext().variables() == {}
