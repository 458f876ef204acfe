"""File sinks: parquet, CSV, partitioned datasets, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import NullType, StructType

from millrace.operators.columns import schema_descriptor, schema_from_descriptor
from millrace.session import scratch_path

# Mode names by config value.
MODES = {"overwrite": "overwrite", "append": "append", "ignore": "ignore", "error": "errorifexists"}
ROWS_PER_SEGMENT = 100_000
SCHEMA_ROWS = "position int, name string, type string, nullable boolean"


def write_mode(mode) -> str:
    name = str(getattr(mode, "value", mode) or "overwrite").lower()
    if name not in MODES:
        raise ValueError(f"unknown write mode {name!r}")
    return MODES[name]


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """A frame that counts its rows while it is written: no second pass for the count."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows by way of the scratch folder, whatever their columns are called."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    kinds = [f.dataType for f in df.schema.fields]
    voids = {i for i, k in enumerate(kinds) if isinstance(k, NullType)}
    plain = df.toDF(*(f"c{i}" for i in range(len(kinds))))
    plain = plain.select(*(F.col(f"c{i}").cast("string").alias(f"c{i}") if i in voids else f"c{i}" for i in range(len(kinds))))
    plain.write.parquet(path)
    back = spark.read.schema(plain.schema).parquet(path)
    return back.select(*(F.lit(None).alias(n) if i in voids else F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)))


def by_partition(df: DataFrame, partition_by: list[str] | None, rebalance: bool = True) -> DataFrame:
    """Bring the rows of a partition together, so that it gets a few full files instead of one per task.

    Spark splits a partition that is too large for one task and joins small ones.
    Switch it off for rows that are already laid out, such as those of one date.
    """
    return df.hint("rebalance", *partition_by) if partition_by and rebalance else df


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
    rows_per_file: int | None = None,
    rebalance: bool = True,
) -> int:
    """Parquet files, at most ``rows_per_file`` rows each. Returns the number of rows written.

    Only the partitions present in the new rows are replaced: a rerun of one date
    leaves the others. Never overwrite a path that the rows are read from: Spark
    empties it first. Write beside it, or use a table.
    """
    frame, seen = counted(by_partition(df, partition_by, rebalance))
    writer = frame.write.mode(write_mode(mode))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int | None = None, **options) -> int:
    """CSV files with a header. Empty text and null are the same in CSV: both are read back as null."""
    frame, seen = counted(df)
    settings = {"header": True, **options}
    if rows_per_file:
        settings["maxRecordsPerFile"] = rows_per_file
    frame.write.mode(write_mode(mode)).options(**settings).csv(path)
    return seen.get["rows"]


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    frame, seen = counted(df)
    frame.write.mode(write_mode(mode)).json(path)
    return seen.get["rows"]


def extract_to_parquet(df: DataFrame, path: str, chunk_size: int = ROWS_PER_SEGMENT) -> dict:
    """Write a query result in chunks and report rows, files and schema; the schema is kept beside the data."""
    spark: SparkSession = df.sparkSession
    rows = write_parquet(df, path, rows_per_file=chunk_size)
    schema = schema_descriptor(df.schema)
    fields = [(i, f["name"], f["type"], f["nullable"]) for i, f in enumerate(schema)]
    kept = spark.createDataFrame(fields, SCHEMA_ROWS).coalesce(1)
    kept.write.mode("overwrite").json(f"{path}/_schema")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").count()
    return {"total_rows": rows, "file_count": files, "output_dir": path, "schema": schema}


def saved_schema(spark: SparkSession, path: str) -> StructType:
    """The schema that ``extract_to_parquet`` kept beside a dataset."""
    rows = spark.read.schema(SCHEMA_ROWS).json(f"{path}/_schema").orderBy("position").collect()
    return schema_from_descriptor([r.asDict() for r in rows])


def export_csv(df: DataFrame, path: str, max_rows: int | None = None, order_by: list | None = None) -> int:
    """CSV with header, all rows in order; a caller who wants one small file gives ``max_rows``."""
    ordered = df.orderBy(*order_by) if order_by else df
    if max_rows is None:
        return write_csv(ordered, path)
    capped = ordered.limit(max_rows)
    return write_csv(capped.coalesce(1), path)
