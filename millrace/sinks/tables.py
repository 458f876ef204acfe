"""Catalog table sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.combine import union_by_name
from millrace.sinks.files import by_partition, counted, write_mode
from millrace.sources.files import below, decoded, scan_files


def quoted(namespace: str, table: str) -> str:
    return f"`{namespace}`.`{table}`"


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`{place}")


def _replaces_partitions(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic"


def write_table(
    df: DataFrame,
    namespace: str,
    table: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> dict:
    """Save as a catalog table, creating its database first. Returns table and row count.

    A table that the rows are read from is replaced through a table beside it.
    Overwriting a partitioned table replaces the partitions that come, and
    leaves the others, if the session overwrites partitions dynamically.
    """
    if not namespace or not table:
        raise ValueError("a table target needs a namespace and a table name")
    ensure_namespace(df.sparkSession, namespace)
    frame, seen = counted(by_partition(df, partition_by))
    writer = frame.write.mode(write_mode(mode)).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    name = quoted(namespace, table)
    existed = df.sparkSession.catalog.tableExists(name)
    if existed and partition_by and write_mode(mode) == "overwrite" and _replaces_partitions(df.sparkSession):
        # Columns as the table has them: insertInto goes by position.
        frame.select(*[f"`{c}`" for c in df.sparkSession.table(name).columns]).write.mode("overwrite").insertInto(name)
        return {"table": name, "rows_loaded": seen.get["rows"]}
    try:
        writer.saveAsTable(name)
    except AnalysisException as err:
        if not (err.getCondition() or "").startswith("UNSUPPORTED_OVERWRITE"):
            raise
        return replace_table(df, namespace, table, partition_by)
    rows = 0 if existed and write_mode(mode) == "ignore" else seen.get["rows"]
    return {"table": name, "rows_loaded": rows}


def replace_table(df: DataFrame, namespace: str, table: str, partition_by: list[str] | None = None) -> dict:
    """Overwrite a table that the new rows may be read from: write beside it, then swap the names.

    The old table is dropped only after the new one carries its name.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex[:8]
    done = write_table(df, namespace, f"{table}__new_{tag}", "error", partition_by)
    old = f"{table}__old_{tag}"
    present = spark.catalog.tableExists(quoted(namespace, table))
    if present:
        spark.sql(f"ALTER TABLE {quoted(namespace, table)} RENAME TO {quoted(namespace, old)}")
    spark.sql(f"ALTER TABLE {done['table']} RENAME TO {quoted(namespace, table)}")
    if present:
        spark.sql(f"DROP TABLE {quoted(namespace, old)}")
    return {**done, "table": quoted(namespace, table)}


def write_parts(parts: list[DataFrame], namespace: str, table: str, mode: str = "overwrite") -> dict:
    """Several parts of one load step: one union and one write, the same as overwrite and then append."""
    return write_table(reduce(DataFrame.unionByName, parts), namespace, table, mode)


def write_records(spark: SparkSession, records, namespace: str, table: str, mode: str = "append", schema=None) -> dict:
    """Rows at hand (a small list or a DataFrame) to a table; no rows, no write."""
    if isinstance(records, DataFrame):
        if records.isEmpty():
            return {"table": quoted(namespace, table), "rows_loaded": 0}
        return write_table(records, namespace, table, mode)
    if not records:
        return {"table": quoted(namespace, table), "rows_loaded": 0}
    return write_table(spark.createDataFrame(records, schema), namespace, table, mode)


def merge_segments(
    spark: SparkSession, path: str, namespace: str, table: str, mode: str = "overwrite", view: str | None = None
) -> dict:
    """All segment files of one dataset as a table; the dataset's file view is dropped."""
    done = write_table(scan_files(spark, path), namespace, table, mode)
    if view:
        spark.catalog.dropTempView(view)
    return done


def apps_frame(spark: SparkSession, base: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Files of a dataset and its application folders as one scan, ``application_id`` from the path.

    Files directly in the folder belong to no application. Columns that only some
    files have are null elsewhere; without a schema that takes a look at the footer
    of every file.
    """
    reader = spark.read.options(recursiveFileLookup=True, mergeSchema=schema is None)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=schema is None)
    df = (reader.schema(schema) if schema else reader).format(fmt).load(base)
    folder = F.regexp_extract(decoded(F.col("_metadata.file_path")), f"{below(base)}([^/]+)/.+$", 1)
    return df.withColumn("application_id", F.nullif(folder, F.lit("")))


def load_apps(
    spark: SparkSession,
    base: str,
    namespace: str,
    table: str,
    mode: str = "overwrite",
    apps: list[str] | None = None,
    fmt: str = "parquet",
    schema=None,
) -> dict:
    """All application folders of a dataset as one table.

    With a list of folders each is read on its own and joined by name, which
    allows columns to differ in type-compatible ways; without, one scan reads all.
    """
    if apps is None:
        return write_table(apps_frame(spark, base, fmt, schema), namespace, table, mode)
    frames = [scan_files(spark, f"{base}/{app}", fmt).withColumn("application_id", F.lit(app)) for app in apps]
    return write_table(union_by_name(*frames), namespace, table, mode)
