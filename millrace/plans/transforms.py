"""SQL and callable transforms over a source table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.combine import union_by_name
from millrace.operators.paging import page
from millrace.plans.context import RunContext
from millrace.sinks.tables import quoted, write_table

# First words of the statements the SQL console accepts.
ALLOWED = (
    "SELECT", "SHOW", "DESCRIBE", "EXPLAIN",
    "DROP", "CREATE", "ALTER", "INSERT", "UPDATE", "DELETE",
    "TRUNCATE", "WITH", "CACHE", "UNCACHE", "REFRESH", "ANALYZE",
    "USE", "SET", "RESET",
)
READ_ONLY = ("SELECT", "WITH")

CallableTransform = Callable[[SparkSession, DataFrame, RunContext], DataFrame]


def check_statement(sql: str, allowed: tuple[str, ...] = ALLOWED) -> str:
    if not sql.strip().upper().startswith(allowed):
        raise ValueError(f"statement type not permitted; allowed: {', '.join(allowed)}")
    return sql


def query(spark: SparkSession, sql: str, database: str | None = None) -> DataFrame:
    """Any allowed statement, optionally in a database; the session's own database stays as it was."""
    check_statement(sql)
    if not database:
        return spark.sql(sql)
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(database)
    try:
        return spark.sql(sql)
    finally:
        if not sql.strip().upper().startswith("USE"):
            spark.catalog.setCurrentDatabase(before)


def read_table(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    if database and not spark.catalog.databaseExists(database):
        raise ValueError(f"source database {database!r} was not found")
    return spark.table(quoted(database, table) if database else f"`{table}`")


def sql_over(df: DataFrame, sql: str, name: str = "source") -> DataFrame:
    """Run SQL that names its input ``source``.

    The view lives only while the query is analysed; an earlier view of the same
    name is put back, so nested and repeated transforms do not disturb each other.
    """
    spark = df.sparkSession
    before = spark.table(name) if _temp_view_exists(spark, name) else None
    df.createOrReplaceTempView(name)
    try:
        out = spark.sql(sql)
        out.schema  # analysed here, while the view exists
        return out
    finally:
        if before is None:
            spark.catalog.dropTempView(name)
        else:
            before.createOrReplaceTempView(name)


def _temp_view_exists(spark: SparkSession, name: str) -> bool:
    return any(t.name == name and t.isTemporary for t in spark.catalog.listTables(pattern=name))


def sql_template(df: DataFrame, sql: str) -> DataFrame:
    """SQL with a ``{source}`` placeholder for its input."""
    name = f"source_{uuid.uuid4().hex[:8]}"
    return sql_over(df, sql.replace("{source}", name), name)


def run_sql_transform(
    spark: SparkSession,
    source_table: str | None,
    sql: str,
    target_db: str,
    target_table: str,
    mode: str = "overwrite",
    source_db: str | None = None,
) -> dict:
    """Source table, SQL, target table."""
    if source_table:
        result = sql_over(read_table(spark, source_table, source_db), sql)
    else:
        result = query(spark, sql, source_db)
    return write_table(result, target_db, target_table, mode)


def apply_callable(df: DataFrame, fn: CallableTransform, context: RunContext | None = None) -> DataFrame:
    """A user function ``f(spark, df, context) -> DataFrame``."""
    out = fn(df.sparkSession, df, context or RunContext())
    if not isinstance(out, DataFrame):
        raise TypeError("a callable transform must return a DataFrame")
    return out


def run_callable_transform(
    spark: SparkSession,
    source_table: str,
    fn: CallableTransform,
    target_db: str,
    target_table: str,
    mode: str = "overwrite",
    source_db: str | None = None,
    context: RunContext | None = None,
) -> dict:
    result = apply_callable(read_table(spark, source_table, source_db), fn, context)
    return write_table(result, target_db, target_table, mode)


def export_frames(frames: dict[str, DataFrame], name: str, target_db: str, table: str, mode: str = "overwrite") -> dict:
    """Save one named frame of a notebook as a table."""
    if name not in frames:
        raise ValueError(f"no frame {name!r}; there are {sorted(frames)}")
    return write_table(frames[name], target_db, table, mode)


def export_for_apps(
    spark: SparkSession, fn: CallableTransform, contexts: list[RunContext], target_db: str, table: str, mode: str = "overwrite"
) -> dict:
    """Run a callable once per application and save all results as one table: one union, one write."""
    frames = [fn(spark, None, ctx).withColumn("application_id", F.lit(ctx.app_id)) for ctx in contexts]
    if not frames:
        raise ValueError("no application to run for")
    return write_table(union_by_name(*frames), target_db, table, mode)


def preview(df: DataFrame, transform: str | CallableTransform, limit: int = 100, order_by: list | None = None):
    """First rows of a transform; nothing is written."""
    out = sql_over(df, transform) if isinstance(transform, str) else apply_callable(df, transform)
    return page(out, limit, order_by=order_by)


def preview_sql(spark: SparkSession, sql: str, params: dict | None = None, limit: int = 100) -> DataFrame:
    """First rows of a SELECT with parameters; a limit in the text is kept."""
    from millrace.functions.templating import replace_names

    text = replace_names(check_statement(sql, READ_ONLY), params or {}).rstrip("; \t\n")
    return spark.sql(text) if re.search(r"\blimit\s+\d+", text, re.IGNORECASE) else spark.sql(text).limit(limit)
