"""Sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.plans.ingest import sql_source
from millrace.plans.transforms import read_table
from millrace.sinks.files import write_csv, write_json, write_parquet
from millrace.sinks.tables import write_table
from millrace.sources import files
from millrace.sources.jdbc import JdbcConnection, QuantileSplit, scan_jdbc
from millrace.sources.layout import Layout, list_datasets, register_views
from millrace.sources.objectstore import ObjectStore
from millrace.sources.splits import derived
from workloads.registry import query, scratch, scratch_db, table, views

ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT * FROM orders")
def scan_csv(spark, sf):
    path = scratch(spark, "csv")
    write_csv(table(spark, sf, "orders"), path, sep="|")
    return files.scan_csv(spark, path, sep="|", schema=ORDERS)


@query("SELECT event_id, event_type, user_id, value FROM events")
def scan_json(spark, sf):
    path = scratch(spark, "json")
    nested = table(spark, sf, "events").select("event_id", "event_type", F.struct("user_id", "value").alias("metadata"))
    write_json(nested, path)
    schema = "event_id bigint, event_type string, metadata struct<user_id: bigint, value: double>"
    return files.scan_json(spark, path, schema=schema).select("event_id", "event_type", "metadata.*")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'
""")
def scan_parquet(spark, sf):
    recent = files.scan_parquet(spark, f"{sf}/lineitem.parquet").where("l_shipdate >= timestamp_ntz'1998-01-01'")
    return recent.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT * FROM customer")
def scan_orc(spark, sf):
    path = scratch(spark, "orc")
    table(spark, sf, "customer").write.orc(path)
    return files.scan_orc(spark, path)


@query("SELECT * FROM customer")
def scan_auto_format(spark, sf):
    path = scratch(spark, "auto")
    write_csv(table(spark, sf, "customer"), path, compression="gzip")
    return files.scan_files(spark, path, schema=CUSTOMER)


def _status_folders(spark, sf, base: str) -> None:
    orders = table(spark, sf, "orders")
    for folder, status in (("in/2026/a", "F"), ("in/2026/b", "O"), ("in/2025/c", "P"), ("out/2026/d", "P")):
        write_parquet(orders.where(F.col("o_orderstatus") == status), f"{base}/{folder}")


@query("SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')")
def scan_glob(spark, sf):
    base = scratch(spark, "glob")
    _status_folders(spark, sf, base)
    return files.scan_glob(spark, base, "in", "2026/*.parquet")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type FROM events")
def scan_with_options(spark, sf):
    path = scratch(spark, "options")
    kind = F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("NA")
    write_csv(table(spark, sf, "events").select("event_id", kind.alias("event_type")), path, sep=";")
    options = {"nullValue": "NA", "mode": "FAILFAST"}
    return files.scan_files(spark, path, "csv", "event_id bigint, event_type string", csv_sep=";", options=options)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def scan_object_store(spark, sf):
    base = scratch(spark, "bucket")
    _status_folders(spark, sf, base)
    scheme, _, place = base.rpartition("://")
    store = ObjectStore(bucket=place, scheme=scheme or "file")
    return store.scan(spark, "out", "*.parquet", "parquet").select("o_orderkey", "o_orderstatus")


@query("SELECT * FROM orders WHERE o_orderdate = TIMESTAMP '1998-03-05 00:00:00'")
def scan_date_pushdown(spark, sf):
    return files.business_date_filter(table(spark, sf, "orders"), "o_orderdate", "19980305")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def scan_row_limit(spark, sf):
    return files.row_limit(table(spark, sf, "orders"), 1000, ["o_orderkey"])


@query("SELECT * FROM customer")
def scan_catalog_table(spark, sf):
    db = scratch_db(spark, "catalog")
    write_table(table(spark, sf, "customer"), db, "customer")
    return read_table(spark, "customer", db)


@query("""
SELECT o_orderpriority, COUNT(*) AS orders FROM orders
WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
""")
def scan_sql_source(spark, sf):
    db = scratch_db(spark, "sqlsource")
    write_table(table(spark, sf, "orders"), db, "orders")
    sql = f"SELECT o_orderpriority, count(*) AS orders FROM {db}.orders WHERE o_orderstatus = 'F' GROUP BY ALL"
    sql_source(spark, sql, db, "by_priority")
    return spark.table(f"{db}.by_priority")


def _app_datasets(spark, sf, label: str) -> str:
    """Orders by status, as the application folders of one extract."""
    root = scratch(spark, label)
    orders = table(spark, sf, "orders")
    for app in ("F", "O", "P"):
        path = Layout(root).dataset("20260416", "daily load", "all orders", app)
        write_parquet(orders.where(F.col("o_orderstatus") == app), path)
    return root


@query("SELECT * FROM orders WHERE o_orderstatus = 'O'")
def register_file_views(spark, sf):
    register_views(spark, _app_datasets(spark, sf, "views"))
    return spark.table("20260416__daily_load_all_orders_o")


@query("""
SELECT '20260416/DAILY_LOAD/ALL_ORDERS/' || o_orderstatus AS name, 'parquet' AS format,
       '20260416' AS business_date, 'DAILY_LOAD' AS pipeline, 'ALL_ORDERS' AS extract_label, o_orderstatus AS app_id,
       TRUE AS has_files, TRUE AS has_bytes
FROM orders GROUP BY o_orderstatus
""")
def list_file_tables(spark, sf):
    found = list_datasets(spark, _app_datasets(spark, sf, "listing"))
    return found.select(
        "name", "format", "business_date", "pipeline", "extract_label", "app_id",
        (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"),
    )


def _as_database(spark):
    """Sends a scan's SQL to Spark SQL instead of a database; one branch of a union per split."""

    def load(text, split):
        parts = [spark.sql(derived(text, p, dialect="spark")) for p in split or [None]]
        return reduce(DataFrame.union, [p.withColumn("split", F.lit(i)) for i, p in enumerate(parts)]) if split else parts[0]

    return load


@query("""
SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-03-05'
""")
def scan_jdbc_date_pushdown(spark, sf):
    """The query that a database would get, date filter and all, answered by Spark SQL: no database is at hand."""
    views(spark, sf, "orders")
    sql = "SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice FROM orders"
    return scan_jdbc(spark, JdbcConnection("spark"), sql=sql, date_column="day", business_date="19980305", load=_as_database(spark))


@query("""
WITH tiles AS (
  SELECT l_suppkey AS k, NTILE(6) OVER (ORDER BY l_suppkey) AS t FROM lineitem
), low AS (
  SELECT k, row_number() OVER (ORDER BY k) - 1 AS split FROM (SELECT DISTINCT min(k) AS k FROM tiles GROUP BY t)
)
SELECT CAST(low.split AS INTEGER) AS split, COUNT(*) AS n, MIN(l_suppkey) AS least, MAX(l_suppkey) AS most
FROM lineitem ASOF JOIN low ON l_suppkey >= low.k GROUP BY low.split
""")
def scan_jdbc_splits(spark, sf):
    """Splits planned from the quantiles of the source, and the rows that each split's query brings."""
    views(spark, sf, "lineitem")
    split = QuantileSplit("l_suppkey", 6, "l_orderkey")
    df = scan_jdbc(spark, JdbcConnection("spark"), table="lineitem", split=split, load=_as_database(spark))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("least"), F.max("l_suppkey").alias("most"))
