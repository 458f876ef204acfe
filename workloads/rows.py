"""Projections, filters and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from millrace.operators import columns, dictionary, grid
from millrace.operators.predicates import filter_equal, filter_rows
from millrace.plans import ledger as runs
from workloads.registry import customer_dictionary, query, table


def _filter(name: str, source: str, conditions: list[tuple], sql: str, logic: str = "AND", prepare=None) -> None:
    """Register a filter over a whole table."""

    def run(spark, sf):
        df = table(spark, sf, source)
        df = prepare(df) if prepare else df
        specs = [{"column": c, "operator": o, "value": v} for c, o, v in conditions]
        return df.transform(filter_rows(specs, logic))

    query(sql, name)(run)


_filter("filter_eq", "lineitem", [("l_quantity", "=", "23.0")],
        "SELECT * FROM lineitem WHERE CAST(l_quantity AS VARCHAR) = '23.0'")
_filter("filter_ne", "orders", [("o_orderstatus", "!=", "F")], "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
_filter("filter_gt", "lineitem", [("l_extendedprice", ">", "50000")],
        "SELECT * FROM lineitem WHERE l_extendedprice > 50000")
_filter("filter_lt", "lineitem", [("l_linenumber", "<", "3.5")], "SELECT * FROM lineitem WHERE l_linenumber < 3.5")
_filter("filter_ge", "part", [("size_text", ">=", "25")],
        """SELECT *, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS size_text
           FROM part WHERE p_size >= 25 AND p_size % 7 <> 0""",
        prepare=lambda df: df.withColumn(
            "size_text", F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")))
        )
_filter("filter_le", "customer", [("c_acctbal", "<=", "0")], "SELECT * FROM customer WHERE c_acctbal <= 0")
_filter("filter_like", "part", [("p_name", "LIKE", "%WIDGET%")],
        "SELECT * FROM part WHERE contains(lower(p_name), 'widget')")
_filter("filter_in", "orders", [("o_orderpriority", "IN", "1-URGENT, 2-HIGH")],
        "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("filter_is_null", "events", [("kind", "IS NULL", "")],
        """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE event_type END AS kind
           FROM events WHERE event_type IN ('error', 'click')""",
        prepare=lambda df: df.select("event_id", F.expr(
            "CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE event_type END").alias("kind"))
        )
_filter("filter_and", "lineitem",
        [("l_returnflag", "=", "A"), ("l_quantity", ">", "10"), ("l_suppkey", "!=", "7"), ("l_tax", "~", "x")],
        "SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10 AND l_suppkey <> 7")
_filter("filter_or", "lineitem", [("l_returnflag", "=", "R"), ("l_quantity", "<", "5"), ("l_orderkey", "IN", "1,2,3")],
        "SELECT * FROM lineitem WHERE l_returnflag = 'R' OR l_quantity < 5 OR l_orderkey IN (1, 2, 3)",
        logic="OR")


def _filter_decimal(name: str, column: str, conditions: list[tuple], sql: str) -> None:
    """Register a filter over lines whose column is a DECIMAL; the rows show it as a double."""

    def run(spark, sf):
        money = F.col(column).cast("decimal(20,2)").alias("amount")
        lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money)
        specs = [{"column": "amount", "operator": o, "value": v} for o, v in conditions]
        return lines.transform(filter_rows(specs)).withColumn("amount", F.col("amount").cast("double"))

    query(f"SELECT l_orderkey, l_linenumber, {column} AS amount FROM lineitem WHERE {sql}", name)(run)


_filter_decimal("filter_decimal_gt", "l_extendedprice", [(">", "50000"), ("!=", "60000.00")],
                "l_extendedprice > 50000 AND l_extendedprice <> 60000")
_filter_decimal("filter_decimal_in", "l_quantity", [("IN", "7.00, 8.00, 9.0")], "l_quantity IN (7, 8)")


@query("SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def drop_columns(spark, sf):
    return table(spark, sf, "lineitem").transform(columns.drop_columns(["l_tax", "l_discount", "not_there"]))


@query("SELECT * RENAME (c_custkey AS id, c_name AS name) FROM customer")
def rename_columns(spark, sf):
    names = {"c_custkey": "id", "c_name": "name", "not_there": "x"}
    return table(spark, sf, "customer").transform(columns.rename_columns(names))


@query("SELECT * RENAME (o_orderstatus AS status) FROM orders WHERE o_orderstatus = 'O'")
def filter_legacy_eq(spark, sf):
    renamed = table(spark, sf, "orders").transform(columns.rename_columns({"o_orderstatus": "status"}))
    return renamed.transform(filter_equal({"status": "O"}))


LINE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount"]


@query("""
SELECT * EXCLUDE (l_tax) RENAME (l_returnflag AS flag) FROM lineitem WHERE l_returnflag = 'N'
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount) = 1
""")
def legacy_transform_chain(spark, sf):
    chain = columns.basic_chain(
        drop=["l_tax"],
        rename={"l_returnflag": "flag"},
        filters={"flag": "N"},
        dedup_on=["l_orderkey", "l_linenumber"],
        order_by=LINE_ORDER,
    )
    return table(spark, sf, "lineitem").transform(chain)


@query("SELECT *, 'APP_01' AS application_id FROM customer")
def add_application_id(spark, sf):
    return table(spark, sf, "customer").transform(columns.add_application_id("APP_01"))


ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_comment", T.StringType()),
    ]
)


def drifted_orders(spark, sf):
    """Orders as text, every 97th key spoilt."""
    key = F.col("o_orderkey").cast("string")
    bad = F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("x"), key)).otherwise(key)
    return table(spark, sf, "orders").select(bad.alias("o_orderkey"), F.col("o_totalprice"))


@query("""
SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_totalprice,
       CAST(NULL AS VARCHAR) AS o_comment
FROM orders
""")
def conform_schema(spark, sf):
    return drifted_orders(spark, sf).transform(columns.conform(ORDER_SCHEMA))


@query("SELECT 'o_orderkey' AS \"column\", COUNT(*) AS bad_cells FROM orders WHERE o_orderkey % 97 = 0")
def conform_schema_report(spark, sf):
    return columns.conform_report(drifted_orders(spark, sf), ORDER_SCHEMA)


@query("""
SELECT * FROM customer
WHERE contains(CAST(c_custkey AS VARCHAR), '99') OR contains(lower(c_name), '99')
   OR contains(CAST(c_nationkey AS VARCHAR), '99') OR contains(CAST(c_acctbal AS VARCHAR), '99')
   OR contains(lower(c_mktsegment), '99')
""")
def grid_search(spark, sf):
    return table(spark, sf, "customer").transform(grid.search("99"))


@query("""
SELECT doc_id, lang FROM documents
WHERE contains(CAST(doc_id AS VARCHAR), 'license') OR contains(lower(text), 'license') OR contains(lower(lang), 'license')
   OR contains(lower(source), 'license') OR contains(CAST(n_chars AS VARCHAR), 'license')
""")
def grid_search_text(spark, sf):
    return table(spark, sf, "documents").transform(grid.search("LICENSE")).select("doc_id", "lang")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind, user_id FROM events
WHERE event_type = 'error' AND contains(CAST(user_id AS VARCHAR), '1')
""")
def grid_column_filters(spark, sf):
    kind = F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind")
    events = table(spark, sf, "events").select("event_id", kind, "user_id")
    return events.transform(grid.column_filters({"kind": "NUL", "user_id": "1"}))


@query("""
WITH page AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer),
cells AS (
  SELECT 0 AS ordinal, 'c_custkey' AS "column", rn, CAST(c_custkey AS VARCHAR) AS cell FROM page WHERE rn <= 3
  UNION ALL SELECT 1, 'c_name', rn, c_name FROM page WHERE rn <= 3
  UNION ALL SELECT 2, 'c_nationkey', rn, CAST(c_nationkey AS VARCHAR) FROM page WHERE rn <= 3
  UNION ALL SELECT 3, 'c_acctbal', rn, CAST(c_acctbal AS VARCHAR) FROM page WHERE rn <= 3
  UNION ALL SELECT 4, 'c_mktsegment', rn, c_mktsegment FROM page WHERE rn <= 3)
SELECT CAST(ordinal AS INTEGER) AS ordinal, "column", max(cell) FILTER (rn = 1) AS row_1,
       max(cell) FILTER (rn = 2) AS row_2, max(cell) FILTER (rn = 3) AS row_3
FROM cells GROUP BY ordinal, "column"
""")
def grid_transpose(spark, sf):
    return grid.transpose(table(spark, sf, "customer"), [F.desc("c_acctbal"), "c_custkey"], 3)


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer
WHERE contains(lower(c_name), 'customer#00000') AND contains(CAST(c_custkey AS VARCHAR), '1') AND c_mktsegment = 'BUILDING'
""")
def dictionary_entry_filter(spark, sf):
    extras = {"segment": "BUILDING", "nation": " "}
    found = dictionary.entry_filter(customer_dictionary(spark, sf), "1", " CUSTOMER#00000 ", extras)
    return found.select("key", "value")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value, c_custkey AS iteration FROM customer
WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0
""")
def iterator_entry_filter(spark, sf):
    """No key selected means all entries, in dictionary order."""
    wanted = [{"column": "segment", "value": "MACHINERY"}, {"column": "funds", "value": "yes"}, {"column": "", "value": "x"}]
    return dictionary.iterator_entries(customer_dictionary(spark, sf), [], wanted).select("key", "value", "iteration")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value,
       list_position(['120', '3', '8', '20', 'none'], CAST(c_custkey AS VARCHAR)) AS iteration
FROM customer WHERE c_custkey IN (120, 3, 8, 20)
""".replace("list_position", "CAST(list_position").replace("AS VARCHAR)) AS iteration", "AS VARCHAR)) AS BIGINT) AS iteration"))
def iterator_selected_keys(spark, sf):
    """Selected keys keep the order of their selection."""
    chosen = ["120", "3", "8", "20", "none"]
    return dictionary.iterator_entries(customer_dictionary(spark, sf), chosen).select("key", "value", "iteration")


@query("""
SELECT event_id FROM events WHERE event_type IN ('error', 'click') AND user_id % 5 = 3 AND contains(props, '"k": 6')
""")
def log_filter(spark, sf):
    logs = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("level"),
        F.concat(F.lit("step_"), (F.col("user_id") % 5).cast("string")).alias("step"),
        F.col("props").alias("message"),
    )
    return runs.filter_logs(logs, ["ERROR", "CLICK"], "step_3", '"K": 6').select("event_id")
