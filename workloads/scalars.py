"""Date, name and text functions, and templated SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import coerce, templating, tokens
from millrace.operators.columns import literal_columns
from millrace.operators.dictionary import extra_column
from workloads.registry import customer_dictionary, query, table, views

# DuckDB spelling of the six date formats.
SQL_FORMATS = {
    "YYYYMMDD": "%Y%m%d",
    "YYYY-MM-DD": "%Y-%m-%d",
    "YYYYMM": "%Y%m",
    "YYYY/MM/DD": "%Y/%m/%d",
    "DD/MM/YYYY": "%d/%m/%Y",
    "MM/DD/YYYY": "%m/%d/%Y",
}


@query(
    "SELECT o_orderkey, "
    + ", ".join(f"strftime(o_orderdate, '{p}') AS f{i}" for i, p in enumerate(SQL_FORMATS.values()))
    + ", strftime(o_orderdate, '%Y%m%d') AS f_unknown FROM orders"
)
def fmt_date(spark, sf):
    day = F.col("o_orderdate")
    named = [templating.format_date_col(day, n).alias(f"f{i}") for i, n in enumerate(SQL_FORMATS)]
    return table(spark, sf, "orders").select(
        "o_orderkey", *named, templating.format_date_col(day, "no such format").alias("f_unknown")
    )


def _range(mode: str, first: str, last: str, start: str | None = None, end: str | None = None) -> None:
    def run(spark, sf):
        orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
        bounds = [F.expr(e) if e else None for e in (start, end)]
        a, b = templating.date_range_cols(F.col("day"), mode, *bounds)
        return orders.select("o_orderkey", a.alias("date_from"), b.alias("date_to"))

    query(
        f"""SELECT o_orderkey, CAST({first} AS DATE) AS date_from, CAST({last} AS DATE) AS date_to
            FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""",
        f"date_range_{mode}",
    )(run)


_range("single", "day", "day")
_range("current_month", "date_trunc('month', day)", "last_day(day)")
_range("previous_month", "date_trunc('month', day) - INTERVAL 1 MONTH", "date_trunc('month', day) - INTERVAL 1 DAY")
_range("custom", "day - 7", "day + 7", "date_sub(day, 7)", "date_add(day, 7)")


@query("""
SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1998-02-01' AND TIMESTAMP '1998-02-28' AND o_orderstatus = 'F'
GROUP BY o_orderpriority
""")
def sql_vars_query(spark, sf):
    views(spark, sf, "orders")
    sql = """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
             WHERE o_orderdate $business_date_range AND o_orderstatus = '$app_id' GROUP BY o_orderpriority"""
    options = {"date_format": "YYYY-MM-DD", "mode": "current_month", "quoted": True, "app_id": "F"}
    return templating.run_template(spark, sql, "1998-02-14", **options)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'MACHINERY'")
def sql_params_query(spark, sf):
    views(spark, sf, "customer")
    sql = "SELECT c_custkey FROM customer WHERE c_nationkey = $nation AND c_mktsegment = '$nation_segment'"
    return templating.run_parameters(spark, sql, {"nation": 7, "nation_segment": "MACHINERY"})


@query("""
SELECT o_orderkey, '1998-03-05 / 1998-03-05' AS label, '19980305' AS compact FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-05' AND DATE '1998-03-09'
""")
def context_params_query(spark, sf):
    views(spark, sf, "orders")
    params = templating.context_parameters({"business_date_to": "1998-03-09"}, "1998/03/05")
    sql = """SELECT o_orderkey, '$business_date_range' AS label, '$business_date' AS compact FROM orders
             WHERE o_orderdate >= '$business_date_from' AND o_orderdate < date_add('$business_date_to', 1)"""
    return templating.run_parameters(spark, sql, params)


@query("""
SELECT c_custkey, strftime(day, '%Y%m%d') AS business_date
FROM (SELECT c_custkey, unnest(range(DATE '2026-04-01', DATE '2026-04-01' + CAST(c_custkey % 5 + 1 AS INTEGER),
                                     INTERVAL 1 DAY)) AS day FROM customer)
""")
def date_list(spark, sf):
    """A list of days per customer, of different lengths."""
    bounds = table(spark, sf, "customer").select(
        "c_custkey",
        F.lit("2026-04-01").cast("date").alias("date_from"),
        F.date_add(F.lit("2026-04-01").cast("date"), (F.col("c_custkey") % 5).cast("int")).alias("date_to"),
    )
    return templating.calendar_days(bounds).select("c_custkey", "business_date")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%d%m%Y') AS b FROM orders")
def compact_date(spark, sf):
    iso, slashed = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    return table(spark, sf, "orders").select(
        "o_orderkey", tokens.compact_date_col(iso).alias("a"), tokens.compact_date_col(slashed).alias("b")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'n/a' AS other FROM orders")
def iso_date(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        tokens.iso_date_col(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("iso"),
        tokens.iso_date_col(F.lit("n/a")).alias("other"),
    )


@query("""
SELECT o_orderkey, 'data_' || strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%Y%m%d') AS b FROM orders
""")
def namespace_name(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", tokens.namespace_col(day).alias("a"), tokens.namespace_col(day, "").alias("b")
    )


@query("""
SELECT p_partkey, upper(trim(regexp_replace(p_name || ' / ' || p_brand || '!', '[^A-Za-z0-9]+', '_', 'g'), '_')) AS token,
       'PIPELINE' AS fallback
FROM part
""")
def path_token(spark, sf):
    raw = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))
    return table(spark, sf, "part").select(
        "p_partkey",
        tokens.path_token_col(raw, "PIPELINE").alias("token"),
        tokens.path_token_col(F.lit(" -- "), "PIPELINE").alias("fallback"),
    )


@query("""
SELECT p_partkey, lower(regexp_replace('2026-04-16__' || p_name || '/' || p_brand, '[^0-9A-Za-z_]', '_', 'g')) AS name
FROM part
""")
def view_name(spark, sf):
    name = tokens.view_name_col(F.lit("2026-04-16"), F.col("p_name"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS number FROM part
""")
def numeric_coerce(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit("d"))).otherwise(F.concat(F.lit(" "), size, F.lit(" ")))
    parts = table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return parts.select("p_partkey", coerce.number(F.col("text"), parts.schema["text"].dataType).alias("number"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 'large' ELSE 'small' END AS size_class,
       'order ' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || ' of ' || upper(left(o_orderpriority, 3)) AS label,
       o_orderkey % 7 AS weekday_slot, CAST(o_orderdate AS DATE) + 30 AS due_date,
       (['first', 'second', 'third'])[o_custkey % 3 + 1] AS batch, CAST(FLOOR(o_totalprice / 12) AS BIGINT) AS monthly
FROM orders
""")
def sql_text_functions(spark, sf):
    batches = F.array(*[F.lit(b) for b in ("first", "second", "third")])
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 150_000, "large").otherwise("small").alias("size_class"),
        F.concat(F.lit("order "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(" of "), F.upper(F.left("o_orderpriority", F.lit(3)))).alias("label"),
        F.pmod("o_orderkey", F.lit(7)).alias("weekday_slot"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("due_date"),
        F.element_at(batches, (F.col("o_custkey") % 3 + 1).cast("int")).alias("batch"),
        F.floor(F.col("o_totalprice") / 12).alias("monthly"),
    )



@query("SELECT o_orderkey, 'TRADE' AS type, 20260424 AS as_of_date FROM orders")
def literal_projection(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").transform(
        literal_columns({"type": "TRADE", "as_of_date": 20260424})
    )


@query("SELECT o_orderkey, TRUE AS in_range FROM orders")
def random_id(spark, sf):
    drawn = table(spark, sf, "orders").select("o_orderkey", tokens.random_id(seed=7).alias("random_id"))
    return drawn.select("o_orderkey", F.col("random_id").between(0, 999_999_999).alias("in_range"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, '' AS missing FROM customer")
def extra_columns(spark, sf):
    return customer_dictionary(spark, sf).select(
        "key", extra_column("segment").alias("segment"), extra_column("not_there").alias("missing")
    )


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_extra_column(spark, sf):
    props = F.from_json("props", "map<string, string>")
    return table(spark, sf, "events").select("event_id", F.try_element_at(props, F.lit("k")).cast("bigint").alias("k"))
