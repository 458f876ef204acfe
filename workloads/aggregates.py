"""Aggregations, dedup and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators import combine, dictionary
from millrace.operators.aggregate import aggregate
from millrace.operators.dedup import dedup
from workloads.registry import customer_dictionary, query, table
from workloads.rows import LINE_ORDER


def _specs(*items: tuple[str, str, str]) -> list[dict]:
    return [{"column": c, "function": f, "alias": a} for c, f, a in items]


def _rounded(df: DataFrame, *names: str, places: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query("""
SELECT ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_quantity), 6) AS mean_qty, COUNT(l_shipdate) AS n,
       MIN(l_discount) AS lowest, MAX(l_tax) AS highest,
       arg_min(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS first_flag
FROM lineitem
""")
def agg_global(spark, sf):
    specs = _specs(
        ("l_extendedprice", "sum", "total"), ("l_quantity", "mean", "mean_qty"), ("l_shipdate", "count", "n"),
        ("l_discount", "min", "lowest"), ("l_tax", "max", "highest"), ("l_returnflag", "first", "first_flag"),
        ("not_there", "sum", "x"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = table(spark, sf, "lineitem").transform(aggregate([], specs, order))
    return _rounded(_rounded(out, "total"), "mean_qty", places=6)


@query("""
SELECT kind, user_id, COUNT(value) AS n, ROUND(SUM(value), 2) AS total, ROUND(AVG(value), 9) AS mean
FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM events)
WHERE kind IS NOT NULL GROUP BY kind, user_id
""")
def agg_group(spark, sf):
    """Rows with a null group key are dropped; one column is aggregated three times."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    specs = _specs(("value", "count", "n"), ("value", "sum", "total"), ("value", "average", "mean"))
    grouped = table(spark, sf, "events").withColumn("kind", kind).transform(aggregate(["kind", "user_id"], specs))
    return _rounded(_rounded(grouped, "total"), "mean", places=9)


def _one(name: str, function: str, expression: str, places: int | None = None) -> None:
    """Register one aggregate function over line items by supplier."""

    def run(spark, sf):
        specs = _specs(("l_extendedprice", function, "result"))
        out = table(spark, sf, "lineitem").transform(aggregate(["l_suppkey"], specs, ["l_orderkey", *LINE_ORDER]))
        return out if places is None else _rounded(out, "result", places=places)

    query(f"SELECT l_suppkey, {expression} AS result FROM lineitem GROUP BY l_suppkey", name)(run)


_one("agg_sum", "sum", "ROUND(SUM(l_extendedprice), 2)", 2)
_one("agg_avg", "avg", "ROUND(AVG(l_extendedprice), 9)", 9)
_one("agg_average_alias", "average", "ROUND(AVG(l_extendedprice), 9)", 9)
_one("agg_count", "count", "COUNT(l_extendedprice)")
_one("agg_min", "min", "MIN(l_extendedprice)")
_one("agg_max", "max", "MAX(l_extendedprice)")
_one("agg_first", "first",
     "arg_min(l_extendedprice, (l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount))")
_one("agg_median", "median", "ROUND(MEDIAN(l_extendedprice), 4)", 4)


@query("""
SELECT l_orderkey, ROUND(MEDIAN(l_quantity), 4) AS mid, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd,
       ROUND(VAR_SAMP(l_quantity), 6) AS vr, COUNT(DISTINCT l_suppkey) AS suppliers,
       arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount)) AS last_flag,
       COUNT(*) AS n, PRODUCT(l_linenumber) AS prod,
       ROUND(STDDEV_SAMP(l_quantity) / SQRT(COUNT(l_quantity)), 6) AS se,
       ROUND(CASE WHEN COUNT(*) >= 3 AND VAR_SAMP(l_quantity) = 0 THEN 0
                  WHEN COUNT(*) >= 3 THEN SKEWNESS(l_quantity) END, 4) AS sk,
       BOOL_OR(l_tax <> 0) AS any_tax, BOOL_AND(l_tax <> 0) AS all_tax
FROM lineitem GROUP BY l_orderkey
""")
def agg_extra(spark, sf):
    specs = _specs(
        ("l_quantity", "median", "mid"), ("l_quantity", "std", "sd"), ("l_quantity", "var", "vr"),
        ("l_suppkey", "nunique", "suppliers"), ("l_returnflag", "last", "last_flag"), ("l_tax", "size", "n"),
        ("l_linenumber", "prod", "prod"), ("l_quantity", "sem", "se"), ("l_quantity", "skew", "sk"),
        ("l_tax", "any", "any_tax"), ("l_tax", "all", "all_tax"),
    )
    out = table(spark, sf, "lineitem").transform(aggregate(["l_orderkey"], specs, ["l_linenumber", *LINE_ORDER]))
    return _rounded(_rounded(out, "sd", "vr", "se", places=6), "mid", "sk", places=4)


@query("""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount) = 1
""")
def dedup_keys(spark, sf):
    return table(spark, sf, "lineitem").transform(dedup(["l_orderkey", "l_linenumber", "not_there"], LINE_ORDER))


@query("""
SELECT CAST(o_orderdate AS DATE) AS business_date, o_orderpriority AS application_id, o_orderstatus AS status,
       COUNT(*) AS trade_count, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_amount,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / COUNT(*) AS avg_amount,
       MAX(o_totalprice) AS max_amount, MIN(o_totalprice) AS min_amount
FROM orders GROUP BY ALL
""")
def daily_summary(spark, sf):
    price = F.col("o_totalprice")
    total = F.sum(price.cast("decimal(18,2)")).cast("double")  # exact, whatever the order of the rows
    keys = [
        F.to_date("o_orderdate").alias("business_date"),
        F.col("o_orderpriority").alias("application_id"),
        F.col("o_orderstatus").alias("status"),
    ]
    summary = table(spark, sf, "orders").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        total.alias("total_amount"),
        (total / F.count(F.lit(1))).alias("avg_amount"),
        F.max(price).alias("max_amount"),
        F.min(price).alias("min_amount"),
    )
    return summary.orderBy(F.desc("business_date"), F.desc("total_amount"))


@query("SELECT p_type, COUNT(*) AS n FROM part GROUP BY p_type ORDER BY n DESC")
def count_by_class(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type")


@query("""
SELECT 'segment' AS "column", c_mktsegment AS value FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY c_nationkey
UNION ALL (SELECT DISTINCT 'funds', 'yes' FROM customer WHERE c_acctbal > 0)
""")
def distinct_facets(spark, sf):
    return dictionary.facets(customer_dictionary(spark, sf), ["segment", "nation", "funds", "not_there"])


TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES))
def table_row_counts(spark, sf):
    counts = [
        table(spark, sf, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t in TABLES
    ]
    return reduce(DataFrame.union, counts).orderBy("table_name")


def _parties(spark, sf):
    """Nations by the party trading there, with repetitions."""
    a = table(spark, sf, "customer").select(F.lit("CUSTOMER").alias("type"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").select(F.lit("SUPPLIER").alias("type"), F.col("s_nationkey").alias("nation"))
    return a, b


@query("""
SELECT 'CUSTOMER' AS type, c_nationkey AS nation FROM customer
UNION SELECT 'SUPPLIER', s_nationkey FROM supplier
""")
def union_distinct(spark, sf):
    return combine.union_distinct(*_parties(spark, sf))


@query("""
SELECT 'CUSTOMER' AS type, c_nationkey AS nation FROM customer
UNION ALL SELECT 'SUPPLIER', s_nationkey FROM supplier
""")
def union_all(spark, sf):
    return combine.union_all(*_parties(spark, sf))


@query("""
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
""")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    b = table(spark, sf, "supplier").selectExpr("s_acctbal AS balance", "s_name AS name", "s_suppkey AS key")
    return combine.union_by_name(a, b)


@query("""
SELECT o_orderstatus, MIN(o_orderpriority) AS least, MAX(o_orderpriority) AS most,
       CAST(SUM(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large
FROM orders GROUP BY o_orderstatus
""")
def agg_minmax_text(spark, sf):
    orders = table(spark, sf, "orders").withColumn("is_large", F.col("o_totalprice") > 100_000)
    specs = _specs(("o_orderpriority", "min", "least"), ("o_orderpriority", "max", "most"), ("is_large", "sum", "large"))
    return orders.transform(aggregate(["o_orderstatus"], specs))


@query("""
SELECT l_returnflag, ROUND(AVG(v), 6) AS mean, MAX(v) AS most, COUNT(v) AS n, ROUND(MEDIAN(v), 4) AS mid
FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS v FROM lineitem) GROUP BY l_returnflag
""")
def agg_nan(spark, sf):
    """NaN counts as no value."""
    value = F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_quantity"))
    specs = _specs(("v", "avg", "mean"), ("v", "max", "most"), ("v", "count", "n"), ("v", "median", "mid"))
    out = table(spark, sf, "lineitem").select("l_returnflag", value.alias("v")).transform(aggregate(["l_returnflag"], specs))
    return _rounded(_rounded(out, "mean", places=6), "mid", places=4)
