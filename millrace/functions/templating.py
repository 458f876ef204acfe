"""Business dates and ``$placeholders`` in SQL text."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.tokens import compact_date, iso_date

# The date formats by name, with their Spark pattern.
DATE_PATTERNS = {
    "YYYYMMDD": "yyyyMMdd",
    "YYYY-MM-DD": "yyyy-MM-dd",
    "YYYYMM": "yyyyMM",
    "YYYY/MM/DD": "yyyy/MM/dd",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
}
DEFAULT_FORMAT = "YYYYMMDD"


def format_date(day: dt.date, name: str = DEFAULT_FORMAT) -> str:
    """A date in one of the named formats; an unknown name means ``YYYYMMDD``."""
    pattern = DATE_PATTERNS.get(name, DATE_PATTERNS[DEFAULT_FORMAT])
    parts = {"yyyy": f"{day.year:04d}", "MM": f"{day.month:02d}", "dd": f"{day.day:02d}"}
    for token, text in parts.items():
        pattern = pattern.replace(token, text)
    return pattern


def format_date_col(col: Column, name: str = DEFAULT_FORMAT) -> Column:
    return F.date_format(col, DATE_PATTERNS.get(name, DATE_PATTERNS[DEFAULT_FORMAT]))


def date_range(
    day: dt.date, mode: str = "single", start: dt.date | None = None, end: dt.date | None = None
) -> tuple[dt.date, dt.date]:
    """First and last day of a business date's range. A custom range without both bounds is single."""
    if mode == "custom" and start and end:
        return start, end
    if mode not in ("current_month", "previous_month"):
        return day, day
    first = day.replace(day=1)
    if mode == "previous_month":
        first = (first - dt.timedelta(days=1)).replace(day=1)
    return first, first.replace(day=calendar.monthrange(first.year, first.month)[1])


def date_range_cols(
    day: Column, mode: str = "single", start: Column | None = None, end: Column | None = None
) -> tuple[Column, Column]:
    """The same range for a date column."""
    if mode == "custom" and start is not None and end is not None:
        return start, end
    if mode == "current_month":
        return F.trunc(day, "MM"), F.last_day(day)
    if mode == "previous_month":
        before = F.add_months(F.trunc(day, "MM"), -1)
        return before, F.last_day(before)
    return day, day


def date_variables(
    business_date: str | None,
    date_format: str = DEFAULT_FORMAT,
    mode: str = "single",
    range_from: str | None = None,
    range_to: str | None = None,
    app_id: str | None = None,
    app_name: str | None = None,
    quoted: bool = False,
) -> dict[str, str]:
    """Values of ``$business_date[_from|_to|_range]``, ``$app_id`` and ``$app_name``.

    ``quoted`` puts the bounds of the range in quotes, which formats with
    separators need to be valid SQL.
    """
    found = {"$app_id": app_id, "$app_name": app_name}
    if business_date:
        day = dt.date.fromisoformat(business_date)
        bounds = [dt.date.fromisoformat(t) if t else None for t in (range_from, range_to)]
        first, last = (format_date(d, date_format) for d in date_range(day, mode, *bounds))
        mark = "'" if quoted else ""
        found |= {
            "$business_date": format_date(day, date_format),
            "$business_date_from": first,
            "$business_date_to": last,
            "$business_date_range": f"BETWEEN {mark}{first}{mark} AND {mark}{last}{mark}",
        }
    return {name: text for name, text in found.items() if text}


def replace_names(text: str, values: Mapping[str, object]) -> str:
    """Replace ``$names``, longest first, so that ``$business_date`` spares ``$business_date_from``."""
    for name in sorted(values, key=len, reverse=True):
        text = text.replace(name if name.startswith("$") else f"${name}", str(values[name]))
    return text


def render_sql(sql: str, business_date: str | None = None, **options) -> tuple[str, dict[str, str]]:
    """SQL text with the date and application names replaced, and the values used."""
    values = date_variables(business_date, **options)
    return replace_names(sql, values), values


def context_parameters(params: Mapping[str, str] | None, business_date: str | None) -> dict[str, str]:
    """Parameters of an ad-hoc query; what isn't given follows from the run's business date, a single day."""
    made: dict[str, str] = {}
    if business_date:
        day = business_date.strip()
        bounds = dict.fromkeys(("business_date_from", "business_date_to"), iso_date(day))
        made = {"business_date": compact_date(day) or business_date, **bounds, "business_date_range": " / ".join(bounds.values())}
    return {**made, **(params or {})}


def run_template(spark: SparkSession, sql: str, business_date: str | None = None, **options) -> DataFrame:
    """Run a query with its placeholders replaced."""
    return spark.sql(render_sql(sql, business_date, **options)[0])


def run_parameters(spark: SparkSession, sql: str, params: Mapping[str, object]) -> DataFrame:
    """Run a query with arbitrary ``$name`` parameters replaced."""
    return spark.sql(replace_names(sql, params))


def resolve_dates(
    dates: list[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    business_date: str | None = None,
) -> list[str]:
    """Compact dates of a run: the listed ones, else a range, else the business date, else today."""
    if dates:
        return [compact_date(d) for d in dates]
    if date_from and date_to:
        first, last = dt.date.fromisoformat(date_from), dt.date.fromisoformat(date_to)
        days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
        if days:
            return [format_date(d) for d in days]
    return [compact_date(business_date or dt.datetime.now(dt.timezone.utc).date().isoformat())]


def calendar_days(bounds: DataFrame, first: str = "date_from", last: str = "date_to") -> DataFrame:
    """One row per day between two date columns, with the compact text of the day."""
    days = bounds.select("*", F.explode(F.sequence(first, last)).alias("day"))
    return days.withColumn("business_date", format_date_col(F.col("day")))
