"""Files to table: scan by pattern, optional SQL, one write."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.plans.transforms import query, sql_template
from millrace.sinks.tables import write_table
from millrace.sources.files import scan_glob


def ingest_files(
    spark: SparkSession,
    root: str,
    target_db: str,
    target_table: str,
    prefix: str = "",
    pattern: str = "*",
    fmt: str = "auto",
    transform_sql: str | None = None,
    mode: str = "overwrite",
    **scan,
) -> dict:
    """Read matching files in place, apply SQL on ``{source}``, save. Raises when nothing matches."""
    df = scan_glob(spark, root, prefix, pattern, fmt, **scan)
    if transform_sql and transform_sql.strip():
        df = sql_template(df, transform_sql)
    return write_table(df, target_db, target_table, mode)


def sql_source(
    spark: SparkSession, sql: str, target_db: str, target_table: str, source_db: str | None = None, mode="overwrite"
) -> dict:
    """A pipeline without an extract: a stored query over a database, saved as a table."""
    return write_table(query(spark, sql, source_db), target_db, target_table, mode)
