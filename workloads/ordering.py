"""Sorting, numbering and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dictionary, order, paging
from millrace.plans import transforms
from millrace.sinks.files import write_parquet
from millrace.sources.layout import preview_dataset
from workloads.registry import customer_dictionary, query, scratch, table, views


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY kind DESC NULLS FIRST, o_totalprice ASC, o_orderkey) AS position
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE lower(o_orderstatus) END AS kind FROM orders)
""")
def sort(spark, sf):
    """Null first when descending; the position of each row shows the order."""
    kind = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", kind.alias("kind"))
    keys = order.sort_keys(
        orders.schema, [{"column": "kind", "direction": "desc"}, {"column": "o_totalprice"}, {"column": "o_orderkey"}]
    )
    return order.number_sorted(orders, keys, "position").select("o_orderkey", "position")


@query("""
SELECT p_partkey, label, row_number() OVER (ORDER BY label IS NULL, TRY_CAST(label AS DOUBLE) IS NULL,
         TRY_CAST(label AS DOUBLE), lower(label), p_partkey) AS position
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS label
      FROM part)
""")
def sort_mixed(spark, sf):
    """Numbers by value, then text, then null."""
    label = F.expr("CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE cast(p_size AS string) END")
    parts = table(spark, sf, "part").select("p_partkey", label.alias("label"))
    keys = order.sort_keys(parts.schema, [{"column": "label"}, {"column": "p_partkey"}])
    return order.number_sorted(parts, keys, "position")


@query("""
SELECT p_partkey, p_brand, row_number() OVER (ORDER BY lower(regexp_extract(p_brand, '^(.*?)([0-9]*)$', 1)) DESC,
         TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) DESC NULLS LAST, p_partkey) AS position
FROM part
""")
def sort_natural(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    keys = [*order.natural_keys(parts.schema, "p_brand", "desc"), (F.col("p_partkey"), "asc")]
    return order.number_sorted(parts, keys, "position")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, row_number() OVER (ORDER BY lower(c_mktsegment) DESC, c_custkey) AS position
FROM customer
""")
def sort_case_insensitive(spark, sf):
    entries = customer_dictionary(spark, sf)
    keys = [*dictionary.case_insensitive_keys("segment", "desc"), (F.col("position"), "asc")]
    numbered = order.number_sorted(entries.select("key", "extra", "position"), keys, "n")
    return numbered.select("key", F.col("n").alias("position"))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 1000")
def limit_offset(spark, sf):
    return paging.page(table(spark, sf, "orders"), 500, 1000, [F.desc("o_totalprice"), "o_orderkey"])


@query("""
SELECT *, (SELECT COUNT(*) > 10000 FROM lineitem_days) AS truncated
FROM lineitem_days ORDER BY l_orderkey, l_linenumber, l_shipdate LIMIT 10000
""".replace("lineitem_days", "(SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem)"))
def limit_bulk(spark, sf):
    days = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct()
    return paging.bulk(days, 10_000, ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("""
SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders) AS total_rows, TRUE AS truncated
FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 120
""")
def preview_file_table(spark, sf):
    path = scratch(spark, "preview")
    write_parquet(table(spark, sf, "orders").orderBy("o_orderkey"), path)
    page, facts = preview_dataset(spark, path, 50, 120)
    return page.select(
        "o_orderkey",
        "o_totalprice",
        F.lit(facts["total_rows"]).cast("bigint").alias("total_rows"),
        F.lit(facts["truncated"]).alias("truncated"),
    )


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 100
""")
def preview_sql(spark, sf):
    views(spark, sf, "customer")
    sql = (
        "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = '$segment' ORDER BY c_acctbal DESC, c_custkey ; "
    )
    return transforms.preview_sql(spark, sql, {"segment": "BUILDING"})


@query("SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 10")
def topk_recent(spark, sf):
    return paging.top(table(spark, sf, "events"), 20, [F.desc("ts"), F.desc("event_id")], 10)


@query("SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) ORDER BY ts, event_id")
def log_tail(spark, sf):
    return paging.tail(table(spark, sf, "events"), 200, ["ts", "event_id"])


@query("""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS BIGINT) AS segment
FROM orders
""")
def segment_id(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return order.segments(orders, 1000, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "segment")
