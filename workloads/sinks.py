"""Sinks: every query writes, then reads back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.ingest import ingest_files
from millrace.sinks import files, tables
from millrace.sources.files import scan_csv
from millrace.sources.layout import Layout
from workloads.registry import query, scratch, scratch_db, table
from workloads.scans import CUSTOMER, ORDERS


@query("SELECT * FROM lineitem", name="write_parquet")
def to_parquet(spark, sf):
    path = scratch(spark, "parquet")
    files.write_parquet(table(spark, sf, "lineitem"), path)
    return spark.read.parquet(path)


@query("SELECT * FROM customer", name="write_csv")
def to_csv(spark, sf):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf, "customer"), path)
    return scan_csv(spark, path, schema=CUSTOMER)


@query("SELECT COUNT(*) AS row_count, CAST(0 AS BIGINT) AS oversized FROM orders")
def write_segments(spark, sf):
    path = scratch(spark, "segments")
    files.write_parquet(table(spark, sf, "orders"), path, rows_per_file=1000)
    sizes = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("row_count"), F.count_if(F.col("n") > 1000).alias("oversized"))


@query("SELECT * FROM orders")
def write_table(spark, sf):
    db = scratch_db(spark, "table")
    tables.write_table(table(spark, sf, "orders"), db, "orders")
    return spark.table(f"{db}.orders")


def _twice(spark, sf, mode: str):
    """Finished orders written first, open ones second with the mode."""
    db, orders = scratch_db(spark, mode), table(spark, sf, "orders")
    tables.write_table(orders.where("o_orderstatus = 'F'"), db, "t")
    tables.write_table(orders.where("o_orderstatus = 'O'"), db, "t", mode)
    return spark.table(f"{db}.t")


@query("SELECT * FROM orders WHERE o_orderstatus = 'O'")
def write_mode_overwrite(spark, sf):
    return _twice(spark, sf, "overwrite")


@query("SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')")
def write_mode_append(spark, sf):
    return _twice(spark, sf, "append")


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def write_mode_ignore(spark, sf):
    return _twice(spark, sf, "ignore")


@query("SELECT * FROM orders")
def write_mode_error(spark, sf):
    db = scratch_db(spark, "error")
    tables.write_table(table(spark, sf, "orders"), db, "t", "error")
    return spark.table(f"{db}.t")


@query("SELECT * FROM orders")
def write_overwrite_then_append(spark, sf):
    db, orders = scratch_db(spark, "parts"), table(spark, sf, "orders")
    parts = [orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    tables.write_parts(parts, db, "t")
    return spark.table(f"{db}.t")


@query("SELECT * FROM customer")
def write_records_table(spark, sf):
    db = scratch_db(spark, "records")
    customers = table(spark, sf, "customer")
    tables.write_records(spark, customers, db, "t")
    tables.write_records(spark, [], db, "t")
    return spark.table(f"{db}.t")


@query("SELECT * FROM orders")
def write_partitioned(spark, sf):
    db = scratch_db(spark, "partitioned")
    tables.write_table(table(spark, sf, "orders"), db, "t", partition_by=["o_orderpriority"])
    return spark.table(f"{db}.t")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
       o_orderpriority
FROM orders
""")
def write_partitioned_rerun(spark, sf):
    """A second run over one partition replaces it and leaves the others."""
    db = scratch_db(spark, "rerun")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    tables.write_table(orders, db, "t", partition_by=["o_orderpriority"])
    again = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", -F.col("o_totalprice"))
    if spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() != "dynamic":
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    tables.write_table(again, db, "t", partition_by=["o_orderpriority"])
    return spark.table(f"{db}.t")


@query("SELECT o_orderkey, o_orderstatus, 'DAILY' AS pipeline FROM orders")
def write_layout(spark, sf):
    layout = Layout(scratch(spark, "layout"), path_template="{pipeline_name}/{business_date}/{app_id}")
    orders = table(spark, sf, "orders")
    for app in ("F", "O", "P"):
        path = layout.dataset("20260416", "daily", "orders", app)
        files.write_parquet(orders.where(F.col("o_orderstatus") == app), path)
    back = spark.read.option("recursiveFileLookup", True).parquet(layout.root)
    pipeline = F.regexp_extract("_metadata.file_path", "/([^/]+)/20260416/[^/]+/[^/]+$", 1)
    return back.select("o_orderkey", "o_orderstatus", pipeline.alias("pipeline"))


@query("""
SELECT o_orderkey, o_totalprice + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS o_totalprice, o_orderpriority
FROM orders
""")
def write_idempotent_rerun(spark, sf):
    path = scratch(spark, "rerun")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    files.write_parquet(orders, path, partition_by=["o_orderpriority"])
    fixed = orders.where("o_orderpriority = '5-LOW'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for _ in range(2):
        files.write_parquet(fixed, path, partition_by=["o_orderpriority"])
    return spark.read.parquet(path)


@query("SELECT * FROM orders")
def merge_segments_to_table(spark, sf):
    path, db = scratch(spark, "merge"), scratch_db(spark, "merge")
    files.write_parquet(table(spark, sf, "orders"), path, rows_per_file=2000)
    tables.merge_segments(spark, path, db, "orders")
    return spark.table(f"{db}.orders")


@query("""
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'APP_' || o_orderstatus END AS application_id
FROM orders
""")
def load_apps_to_table(spark, sf):
    layout, db = Layout(scratch(spark, "apps")), scratch_db(spark, "apps")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    base = layout.dataset("20260416", "daily", "orders")
    own = orders.where("o_orderstatus = 'P'").drop("o_orderstatus", "o_orderpriority")
    files.write_parquet(own, base)
    for app in ("F", "O"):
        part = orders.where(F.col("o_orderstatus") == app).drop("o_orderstatus")
        files.write_parquet(part, layout.dataset("20260416", "daily", "orders", f"app {app}"))
    tables.load_apps(spark, base, db, "orders")
    return spark.table(f"{db}.orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "application_id")


@query("SELECT o_orderstatus, COUNT(*) AS row_count FROM orders GROUP BY o_orderstatus")
def extract_to_parquet(spark, sf):
    path = scratch(spark, "extract")
    files.extract_to_parquet(table(spark, sf, "orders"), path, chunk_size=5000)
    back = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("row_count"))


@query("""
SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS total FROM orders
WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority
""")
def ingest_files_to_table(spark, sf):
    base, db, orders = scratch(spark, "ingest"), scratch_db(spark, "ingest"), table(spark, sf, "orders")
    for status in ("F", "O", "P"):
        folder = "skip" if status == "P" else "take"
        files.write_csv(orders.where(F.col("o_orderstatus") == status), f"{base}/{folder}/{status}", sep="|")
    sql = "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM {source} GROUP BY o_orderpriority"
    ingest_files(
        spark, base, db, "totals", pattern="take/*.csv", fmt="csv", transform_sql=sql, schema=ORDERS, csv_sep="|"
    )
    return spark.table(f"{db}.totals")


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5000")
def export_query(spark, sf):
    path = scratch(spark, "export")
    order = [F.desc("o_totalprice"), "o_orderkey"]
    files.export_csv(table(spark, sf, "orders"), path, 5000, order)
    return scan_csv(spark, path, schema=ORDERS)
