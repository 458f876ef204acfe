"""JDBC scans. Executors connect to the database, so it must be reachable from all of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.templating import render_sql
from millrace.functions.tokens import iso_date
from millrace.sources.files import business_date_filter
from millrace.sources.splits import day_condition, derived, plan_splits

# JDBC URL scheme by dialect name.
SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "impala": "impala"}


@dataclass(frozen=True)
class JdbcConnection:
    """A named database. ``url`` wins over the single parts."""

    dialect: str = "postgresql"
    host: str = ""
    port: int | None = None
    database: str = ""
    username: str = ""
    password: str = field(default="", repr=False)
    driver: str = ""
    url: str = ""

    def jdbc_url(self) -> str:
        if self.url:
            return self.url if self.url.startswith("jdbc:") else f"jdbc:{self.url}"
        place = f"{self.host}:{self.port}" if self.port else self.host
        return f"jdbc:{SCHEMES.get(self.dialect, self.dialect)}://{place}/{self.database}"

    def options(self) -> dict[str, str]:
        found = {"url": self.jdbc_url(), "user": self.username, "password": self.password, "driver": self.driver}
        return {name: text for name, text in found.items() if text}


@dataclass(frozen=True)
class Split:
    """How a scan is read in parallel: one range of the column per task."""

    column: str
    lower: str
    upper: str
    partitions: int


@dataclass(frozen=True)
class QuantileSplit:
    """The same with borders that the source's data give; ``tie`` splits a value of very many rows further."""

    column: str
    partitions: int
    tie: str | None = None


def extract_sql(sql: str | None = None, stored_sql: str | None = None, table: str | None = None) -> str:
    """The query of an extract: its own SQL, else a stored one, else a whole table."""
    text = (sql or stored_sql or "").strip()
    if text:
        return text
    if not table:
        raise ValueError("a JDBC extract needs sql, stored_sql or table")
    return f"SELECT * FROM {table}"


def scan_options(
    connection: JdbcConnection, query: str, split: Split | None = None, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options of the Spark JDBC reader. A split needs the query as a derived table."""
    text = query.rstrip().rstrip(";")
    base = {**connection.options(), "fetchsize": str(fetch_size), "pushDownLimit": "true"}
    if split is None:
        return {**base, "query": text}
    return {
        **base,
        "dbtable": f"({text}) src",
        "partitionColumn": split.column,
        "lowerBound": split.lower,
        "upperBound": split.upper,
        "numPartitions": str(split.partitions),
    }


Load = Callable[[str, "Split | list[str] | None"], DataFrame]


def _reader(spark: SparkSession, connection: JdbcConnection, fetch_size: int) -> Load:
    def load(query: str, split: Split | list[str] | None) -> DataFrame:
        if isinstance(split, list):
            found = {**connection.options(), "fetchsize": str(fetch_size)}
            return spark.read.jdbc(found.pop("url"), f"({query}) src", predicates=split, properties=found)
        return spark.read.format("jdbc").options(**scan_options(connection, query, split, fetch_size)).load()

    return load


def has_limit(sql: str) -> bool:
    return re.search(r"\blimit\s+\d+", sql, re.IGNORECASE) is not None


def scan_jdbc(
    spark: SparkSession,
    connection: JdbcConnection,
    sql: str | None = None,
    stored_sql: str | None = None,
    table: str | None = None,
    business_date: str | None = None,
    app_id: str | None = None,
    app_name: str | None = None,
    date_format: str = "YYYYMMDD",
    date_mode: str = "single",
    date_from: str | None = None,
    date_to: str | None = None,
    date_column: str | None = None,
    limit: int | None = None,
    split: Split | QuantileSplit | None = None,
    fetch_size: int = 10_000,
    load: Load | None = None,
) -> DataFrame:
    """A query or table of a database.

    The date filter and the limit are written into the query that the database
    gets. Only a date filter on a column that is neither date nor time is left
    to Spark, and then the limit too. ``load`` turns a query and its split into
    rows; by default that is Spark's JDBC reader.
    """
    query = extract_sql(sql, stored_sql, table)
    if sql or stored_sql:
        options = {"date_format": date_format, "mode": date_mode, "range_from": date_from, "range_to": date_to}
        query, _ = render_sql(query, business_date, app_id=app_id, app_name=app_name, **options)
    load = load or _reader(spark, connection, fetch_size)
    limit = None if has_limit(query) or not limit or limit <= 0 else limit
    if date_column and business_date:
        kind = load(query, None).schema[date_column].dataType
        condition = day_condition(date_column, kind, iso_date(business_date), connection.dialect)
        if condition is None:
            df = business_date_filter(load(query, split), date_column, business_date)
            return df.limit(limit) if limit else df
        query = derived(query, condition, dialect=connection.dialect)
    query = derived(query, None, limit, connection.dialect)
    if isinstance(split, QuantileSplit) and not limit:
        ask = lambda text: load(text, None).collect()  # noqa: E731  a row per split
        return load(query, plan_splits(ask, query, split.column, split.partitions, connection.dialect, split.tie))
    return load(query, None if limit else split)


def scan_impala(spark: SparkSession, connection: JdbcConnection, **options) -> DataFrame:
    """The same scan; the connection names the Impala dialect and driver."""
    return scan_jdbc(spark, connection, **options)
