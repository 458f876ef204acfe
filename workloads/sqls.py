"""SQL console, SQL and callable transforms, and statements Spark takes as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import transforms
from millrace.plans.context import RunContext
from millrace.sinks.tables import write_table
from workloads.registry import query, scratch_db, table, views

BY_SEGMENT = """
SELECT c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
"""


@query(BY_SEGMENT, name="query")
def console(spark, sf):
    views(spark, sf, "orders", "customer")
    return transforms.query(spark, BY_SEGMENT)


@query("""
SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus
""")
def sql_transform(spark, sf):
    db = scratch_db(spark, "sqlt")
    write_table(table(spark, sf, "orders"), db, "orders")
    sql = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM source GROUP BY o_orderstatus"
    transforms.run_sql_transform(spark, "orders", sql, db, "totals", source_db=db)
    return spark.table(f"{db}.totals")


@query("SELECT l_returnflag, MAX(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag")
def sql_template_source(spark, sf):
    sql = "SELECT l_returnflag, max(l_shipdate) AS last FROM {source} GROUP BY l_returnflag"
    return transforms.sql_template(table(spark, sf, "lineitem"), sql)


def _discounted(spark, df, context):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return df.groupBy("l_suppkey").agg(F.round(F.sum(price), 2).alias("revenue"))


@query("""
SELECT l_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_suppkey
""")
def notebook_transform(spark, sf):
    return transforms.apply_callable(table(spark, sf, "lineitem"), _discounted)


CONTEXT = RunContext(business_date="1998-02-14", date_mode="current_month", app_id="F", run_id=7)


@query("""
SELECT o_orderkey, 'F' AS app_id, 'data_19980214' AS namespace_db, 7 AS run_id FROM orders
WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-02-28'
""")
def notebook_context(spark, sf):
    def select_month(spark, df, context):
        values = context.runtime()
        first, last = (F.lit(values[f"business_date_{end}"]).cast("date") for end in ("from", "to"))
        month = df.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < F.date_add(last, 1)))
        mine = month.where(F.col("o_orderstatus") == values["app_id"])
        return mine.select("o_orderkey", *[F.lit(values[n]).alias(n) for n in ("app_id", "namespace_db", "run_id")])

    return transforms.apply_callable(table(spark, sf, "orders"), select_month, CONTEXT)


@query("SELECT * FROM supplier WHERE s_acctbal > 0")
def notebook_export(spark, sf):
    db = scratch_db(spark, "export")
    frames = {"result_df": table(spark, sf, "supplier").where("s_acctbal > 0")}
    transforms.export_frames(frames, "result_df", db, "suppliers")
    return spark.table(f"{db}.suppliers")


@query("""
SELECT o_orderstatus AS application_id, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderstatus
""")
def notebook_export_apps(spark, sf):
    """The same callable once per application, all results in one table."""
    db = scratch_db(spark, "exports")

    def totals(spark, df, context):
        mine = table(spark, sf, "orders").where(F.col("o_orderstatus") == context.app_id)
        return mine.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    transforms.export_for_apps(spark, totals, [RunContext(app_id=a) for a in ("F", "O", "P")], db, "totals")
    return spark.table(f"{db}.totals")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_transform(spark, sf):
    sql = "SELECT o_orderkey, o_totalprice * 2 AS twice FROM source"
    return transforms.preview(table(spark, sf, "orders"), sql, 100, ["o_orderkey"])


def _passthrough(name: str, sql: str, *tables: str, check: str | None = None) -> None:
    """Register a statement that is handed to Spark as it is."""

    def run(spark, sf):
        views(spark, sf, *tables)
        return transforms.query(spark, sql)

    query(check or sql, f"sql_passthrough_{name}")(run)


_passthrough("semi", """
SELECT c_custkey FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)
""", "customer", "orders")  # fmt: skip
_passthrough("anti", """
SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)
""", "customer", "orders")  # fmt: skip
_passthrough("non_equi", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate
""", "lineitem", "orders")  # fmt: skip
_passthrough("window", """
SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn,
       RANK() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_type) AS rk,
       LAG(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS previous,
       ROUND(AVG(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)
         AS moving
FROM events
""", "events", check="""
SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS rn,
       CAST(RANK() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_type) AS INTEGER) AS rk,
       LAG(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS previous,
       ROUND(AVG(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)
         AS moving
FROM events
""")  # fmt: skip
_passthrough("rollup", """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""", "orders")  # fmt: skip
_passthrough("cube", """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""", "orders")  # fmt: skip
_passthrough("grouping_sets", """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""", "orders")  # fmt: skip
_passthrough("intersect", """
SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000
INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000
""", "customer", "supplier")  # fmt: skip
_passthrough("except", """
SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0
""", "orders", "customer")  # fmt: skip
_passthrough("cte", """
WITH spent AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, COUNT(*) AS customers, ROUND(MAX(total), 2) AS most
FROM spent JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""", "orders", "customer")  # fmt: skip
_passthrough("subquery", """
SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)
""", "part")  # fmt: skip
_passthrough("json_path", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "events",
             check="SELECT event_id, props->>'$.k' AS k FROM events")
