"""Registration of queries and helpers to read the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import scratch_path, scratch_root
from millrace.sinks.tables import ensure_namespace

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with equivalent SQL for DuckDB."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql:
            CHECKS[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def views(spark: SparkSession, sf: str, *names: str) -> None:
    """The tables as temporary views, for queries written in SQL."""
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def scratch_db(spark: SparkSession, label: str) -> str:
    """A new database in the shared scratch folder."""
    name = f"mr_{label}_{uuid.uuid4().hex[:8]}"
    ensure_namespace(spark, name, f"{scratch_root(spark)}/millrace/{name}")
    return name


def nation_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as a dictionary: key, value, extra columns and position."""
    regions = table(spark, sf, "region")
    joined = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("n_nationkey").cast("string").alias("key"),
        F.col("n_name").alias("value"),
        F.create_map(
            F.lit("region"), "r_name", F.lit("parity"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd")
        ).alias("extra"),
        F.col("n_nationkey").alias("position"),
    )


def customer_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a dictionary; unlike nations it grows with the data."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"),
        F.col("c_name").alias("value"),
        F.create_map(
            F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"),
            F.lit("funds"), F.when(F.col("c_acctbal") > 0, "yes").otherwise(""),
        ).alias("extra"),
        F.col("c_custkey").alias("position"),
    )
