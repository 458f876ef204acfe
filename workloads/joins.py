"""Joins and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dictionary, join
from workloads.registry import customer_dictionary, query, table

CUSTOMER_KEY = [{"left": "o_custkey", "right": "c_custkey"}]


@query("""
SELECT o_orderkey, CASE WHEN c_acctbal <= 0 THEN 'n/a' WHEN c_mktsegment = 'BUILDING' THEN 'builder ' || c_custkey
                        ELSE c_name END AS customer_name
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def lookup(spark, sf):
    """Customers without funds are missing from the dictionary; builders are entered twice, the later entry counts."""
    entries = customer_dictionary(spark, sf).where(dictionary.extra_column("funds") == "yes")
    again = entries.where(dictionary.extra_column("segment") == "BUILDING").select(
        "key", F.concat(F.lit("builder "), "key").alias("value"), (F.col("position") + 2**40).alias("position")
    )
    both = entries.drop("extra").union(again)
    mapped = table(spark, sf, "orders").transform(join.lookup(both, "o_custkey", "customer_name", "n/a"))
    return mapped.select("o_orderkey", "customer_name")


@query("""
SELECT o_orderkey, o_custkey, c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
""")
def join_inner(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").transform(
        join.join_tables(customers, CUSTOMER_KEY)
    )


@query("""
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey
""")
def join_left(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_totalprice")
    keys = [{"left": "c_custkey", "right": "o_custkey"}]
    return (
        table(spark, sf, "customer").select("c_custkey", "c_name").transform(join.join_tables(big, keys, "left"))
    ).drop("o_custkey")


@query("""
SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment
FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 100000) o
RIGHT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def join_right(spark, sf):
    few = table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_totalprice < 100000")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = few.select("o_orderkey", "o_custkey").transform(join.join_tables(customers, CUSTOMER_KEY, "right"))
    return joined.drop("o_custkey")


@query("""
SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_acctbal
FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o
FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey
""")
def join_full(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey", "c_acctbal")
    return big.transform(join.join_tables(rich, CUSTOMER_KEY, "full"))


@query("""
SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_linenumber AS right_l_linenumber, b.o_orderkey, b.line_of_day
FROM lineitem a
JOIN (SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INTEGER) AS l_linenumber, dayofmonth(o_orderdate) AS line_of_day
      FROM orders) b
ON a.l_orderkey = b.o_orderkey AND a.l_linenumber = b.l_linenumber
""")
def join_two_keys(spark, sf):
    """Two key pairs, and a right column whose name clashes."""
    marked = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"),
        F.dayofmonth("o_orderdate").cast("bigint").alias("line_of_day"),
    )
    keys = [{"left": "l_orderkey", "right": "o_orderkey"}, {"left": "l_linenumber", "right": "l_linenumber"}]
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.transform(join.join_tables(marked, keys))


@query("""
SELECT l_orderkey, l_linenumber, o_orderkey, o_custkey
FROM (SELECT l_orderkey, l_linenumber FROM lineitem) l
FULL JOIN (SELECT o_orderkey, o_custkey FROM orders) o ON l.l_orderkey * 2 = o.o_orderkey
""")
def join_full_large(spark, sf):
    """Two large sides, half of whose keys have no partner."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 2).alias("twice"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = lines.transform(join.join_tables(orders, [{"left": "twice", "right": "o_orderkey"}], "full", hot_keys=True))
    return joined.drop("twice")


@query("""
SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
""")
def join_left_large(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = [{"left": "o_orderkey", "right": "l_orderkey"}]
    return table(spark, sf, "orders").select("o_orderkey").transform(join.join_tables(lines, keys, "left")).drop("l_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, o_custkey FROM orders RIGHT JOIN lineitem ON o_orderkey = l_orderkey
""")
def join_right_large(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    keys = [{"left": "o_orderkey", "right": "l_orderkey"}]
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.transform(join.join_tables(lines, keys, "right")).drop("o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, COALESCE(o_orderpriority, 'none') AS priority
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""")
def lookup_large(spark, sf):
    """A dictionary as long as the orders."""
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.transform(join.lookup(entries, "l_orderkey", "priority", "none"))
