"""Pipeline graphs, fan-out and reruns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.columns import split_valid
from millrace.operators.dictionary import iterator_entries
from millrace.plans import fanout, graph, ledger as runs
from millrace.plans.context import RunContext
from millrace.sources.layout import Layout
from workloads.registry import nation_dictionary, query, scratch, scratch_db, table, views
from workloads.rows import ORDER_SCHEMA, drifted_orders


def _node(nid: str, kind: str, **config) -> dict:
    return {"id": nid, "data": {"nodeType": kind, "label": nid, "config": config}}


def _edges(*pairs: tuple[str, str]) -> list[dict]:
    return [{"source": a, "target": b} for a, b in pairs]


def _segments(spark, sf):
    """Market segments as the application dictionary: a small stored table, read by whoever needs it."""
    path = scratch(spark, "segments")
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("key")).distinct()
    named = names.select("key", F.initcap("key").alias("value"), F.lit(0).alias("position"))
    named.withColumn("extra", F.lit(None).cast("map<string,string>")).write.parquet(path)
    return spark.read.parquet(path)


def _orders_by_app(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("c_mktsegment").alias("app_id"),
        F.to_date("o_orderdate").alias("business_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


TEMPLATE_CHECK = """
SELECT c_mktsegment AS app_id, CAST(o_orderdate AS DATE) AS business_date, ROUND(SUM(o_totalprice), 2) AS total_amount
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O') AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
GROUP BY ALL
"""


@query(TEMPLATE_CHECK)
def builtin_template(spark, sf):
    """Iterator, extract per application, aggregate by application and date, table: one plan and one write."""
    db = scratch_db(spark, "template")
    chosen = ["MACHINERY", "BUILDING", "HOUSEHOLD"]

    def extract(spark, config, context):
        return _orders_by_app(spark, sf)

    spec = {
        "nodes": [
            _node("iterator", "iterator", dictionary_id=1, selected_keys=chosen),
            _node("extract", "jdbc_extract", app_column="app_id"),
            _node("settled", "filter", conditions=[{"column": "status", "operator": "IN", "value": "F, O"}]),
            _node(
                "daily",
                "aggregate",
                group_by=["app_id", "business_date"],
                aggregations=[{"column": "amount", "function": "sum", "alias": "total_amount"}],
            ),
            _node("target", "load_sql", namespace_db=db, table_name="app_daily_aggregate"),
        ],
        "edges": _edges(("iterator", "extract"), ("extract", "settled"), ("settled", "daily"), ("daily", "target")),
    }
    env = graph.Environment(readers={"extract": extract}, dictionaries={"1": _segments(spark, sf)})
    graph.run(spark, graph.Graph(spec, "daily"), env)
    return spark.table(f"{db}.app_daily_aggregate").withColumn("total_amount", F.round("total_amount", 2))


def _reader(spark, sf, name: str):
    return lambda spark, config, context: table(spark, sf, name)


@query("""
SELECT n_name AS nation, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 100000 GROUP BY n_name
""")
def compile_graph(spark, sf):
    """Two sources, filter, join, lookup and aggregate; nothing is written."""
    spec = {
        "nodes": [
            _node("orders", "table_extract"),
            _node("customers", "table_extract"),
            _node("big", "filter", conditions=[{"column": "o_totalprice", "operator": ">", "value": "100000"}]),
            _node("both", "join", join_type="inner", keys=[{"left": "o_custkey", "right": "c_custkey"}]),
            _node("named", "lookup", dict_id=1, match_column="c_nationkey", output_column="nation"),
            _node(
                "totals",
                "aggregate",
                group_by=["nation"],
                aggregations=[
                    {"column": "o_orderkey", "function": "count", "alias": "orders"},
                    {"column": "o_totalprice", "function": "sum", "alias": "total"},
                ],
            ),
            _node("out", "load_sql", table_name="by_nation"),
        ],
        "edges": _edges(
            ("orders", "big"), ("big", "both"), ("customers", "both"), ("both", "named"), ("named", "totals"),
            ("totals", "out"),
        ),
    }
    env = graph.Environment(
        readers={"orders": _reader(spark, sf, "orders"), "customers": _reader(spark, sf, "customer")},
        dictionaries={"1": nation_dictionary(spark, sf)},
    )
    frames, _ = graph.build(spark, graph.Graph(spec), env)
    return frames["totals"].withColumn("total", F.round("total", 2))


STEPS = [
    {"type": "filter", "config": {"conditions": [{"column": "l_quantity", "operator": ">=", "value": "10"}]}},
    {"type": "sql_transform", "config": {"sql": "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM source"}},
    {
        "type": "aggregate",
        "config": {
            "group_by": ["l_returnflag", "l_linestatus"],
            "aggregations": [
                {"column": "net", "function": "sum", "alias": "net"},
                {"column": "l_quantity", "function": "avg", "alias": "qty"},
                {"column": "l_quantity", "function": "count", "alias": "lines"},
            ],
        },
    },
    {"type": "sort", "config": {"columns": [{"column": "net", "direction": "desc"}]}},
]


@query("""
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net,
       ROUND(AVG(l_quantity), 6) AS qty, COUNT(*) AS lines
FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL
""")
def transform_steps(spark, sf):
    out = graph.apply_steps(table(spark, sf, "lineitem"), STEPS)
    return out.withColumns({"net": F.round("net", 2), "qty": F.round("qty", 6)})


@query("""
SELECT 'input' AS step, COUNT(*) AS rows_out FROM lineitem
UNION ALL SELECT '1:filter', COUNT(*) FROM lineitem WHERE l_quantity >= 10
UNION ALL SELECT '2:sql_transform', COUNT(*) FROM lineitem WHERE l_quantity >= 10
UNION ALL SELECT '3:aggregate', COUNT(*) FROM
  (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL)
""")
def step_io_metrics(spark, sf):
    """Rows after each step, counted by the one job that writes the result."""
    counted, seen = graph.observe_steps(table(spark, sf, "lineitem"), STEPS[:3])
    counted.write.parquet(scratch(spark, "metrics"))
    rows = [(step, counter.get["rows"]) for step, counter in seen.items()]
    return spark.createDataFrame(rows, "step string, rows_out bigint")


@query("""
SELECT 'CUSTOMERS' AS branch, c_nationkey AS nation, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL
UNION ALL SELECT 'SUPPLIERS', s_nationkey, COUNT(*) FROM supplier WHERE s_acctbal > 0 GROUP BY ALL
""")
def multi_branch(spark, sf):
    """Two sources with their own transforms and tables."""
    db = scratch_db(spark, "branches")
    nodes, edges, readers = [], [], {}
    for source, letter in (("customer", "c"), ("supplier", "s")):
        count = [{"column": f"{letter}_name", "function": "count", "alias": "n"}]
        nodes += [
            _node(source, "table_extract"),
            _node(f"{source}_f", "filter", conditions=[{"column": f"{letter}_acctbal", "operator": ">", "value": 0}]),
            _node(f"{source}_a", "aggregate", group_by=[f"{letter}_nationkey"], aggregations=count),
            _node(f"{source}_l", "load_sql", namespace_db=db, table_name=source),
        ]
        edges += _edges((source, f"{source}_f"), (f"{source}_f", f"{source}_a"), (f"{source}_a", f"{source}_l"))
        readers[source] = _reader(spark, sf, source)
    graph.run(spark, graph.Graph({"nodes": nodes, "edges": edges}), graph.Environment(readers=readers))
    parts = [
        spark.table(f"{db}.{t}").select(F.lit(f"{t.upper()}S").alias("branch"), F.col(f"{c}_nationkey").alias("nation"), "n")
        for t, c in (("customer", "c"), ("supplier", "s"))
    ]
    return parts[0].union(parts[1])


@query("""
SELECT o_orderpriority, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS staged, COUNT(*) AS n
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
""")
def staging_load(spark, sf):
    """A load between two transforms: files are written and the rows flow on from there."""
    db, root = scratch_db(spark, "staging"), scratch(spark, "staging")
    count = [{"column": "o_orderkey", "function": "count", "alias": "n"}]
    spec = {
        "nodes": [
            _node("orders", "table_extract"),
            _node("done", "filter", conditions=[{"column": "o_orderstatus", "operator": "=", "value": "F"}]),
            _node("stage", "load_parquet"),
            _node("totals", "aggregate", group_by=["o_orderpriority"], aggregations=count),
            _node("out", "load_sql", namespace_db=db, table_name="totals"),
        ],
        "edges": _edges(("orders", "done"), ("done", "stage"), ("stage", "totals"), ("totals", "out")),
    }
    env = graph.Environment(readers={"orders": _reader(spark, sf, "orders")}, output=Layout(root))
    done = graph.run(spark, graph.Graph(spec, "staged"), env, RunContext(business_date="2026-04-16"))
    staged = F.lit(done[0]["rows_loaded"]).cast("bigint").alias("staged")
    return spark.table(f"{db}.totals").select("o_orderpriority", staged, "n")


@query("""
SELECT CAST(0 AS INTEGER) AS step_order, 'out' AS step_label, COUNT(*) AS records_in, COUNT(*) AS records_out
FROM orders WHERE o_orderstatus = 'F'
""")
def recorded_run(spark, sf):
    """A graph is run and recorded; its steps are read from the ledger it wrote."""
    db = scratch_db(spark, "recorded")
    spec = {
        "nodes": [
            _node("orders", "table_extract"),
            _node("done", "filter", conditions=[{"column": "o_orderstatus", "operator": "=", "value": "F"}]),
            _node("out", "load_sql", namespace_db=db, table_name="done_orders"),
        ],
        "edges": _edges(("orders", "done"), ("done", "out")),
    }
    env = graph.Environment(readers={"orders": _reader(spark, sf, "orders")})
    runs.record_run(spark, db, "recorded", lambda: graph.run(spark, graph.Graph(spec, "recorded"), env))
    return runs.step_rows(spark.table(f"{db}.run_steps"))


@query("""
SELECT c_custkey, CAST(n_nationkey AS VARCHAR) AS application_id, n_name AS application_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
""")
def foreach_app(spark, sf):
    apps = iterator_entries(nation_dictionary(spark, sf), None, [{"column": "region", "value": "EUROPE"}])
    customers = table(spark, sf, "customer")
    return fanout.foreach_app(customers, "c_nationkey", apps).select(
        "c_custkey", "application_id", "application_name"
    )


@query("""
SELECT o_orderstatus AS key, 'status ' || o_orderstatus AS value, COUNT(*) AS total_rows, FALSE AS failed
FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'X''', 'broken', 0, TRUE
""")
def foreach_extract(spark, sf):
    """One extract per entry; the entry whose text breaks the SQL is reported, the others go on."""
    views(spark, sf, "orders")
    entries = [{"key": s, "value": f"status {s}"} for s in ("F", "O", "P")] + [{"key": "X'", "value": "broken"}]
    report = fanout.foreach_extract(
        spark, "SELECT * FROM orders WHERE o_orderstatus = '$app_id'", entries, scratch(spark, "foreach"), "{app_id}/all"
    )
    return report.select("key", "value", "total_rows", F.col("error").isNotNull().alias("failed"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS business_date FROM orders
WHERE CAST(o_orderdate AS DATE) IN (DATE '1998-03-05', DATE '1998-03-06', DATE '1999-01-04')
""")
def multi_date(spark, sf):
    days = ["19980305", "19980306", "19990104"]
    return fanout.multi_date(table(spark, sf, "orders"), "o_orderdate", days).select("o_orderkey", "business_date")


@query("""
SELECT branch, application_id, date
FROM (SELECT b.branch, c.c_mktsegment AS application_id, d.date
      FROM (SELECT DISTINCT c_mktsegment FROM customer) c,
           (VALUES ('F'), ('O')) b(branch), (VALUES ('19980305'), ('19980306'), ('19980307')) d(date))
WHERE (branch, application_id, date) NOT IN
  (SELECT (o_orderstatus, c_mktsegment, strftime(o_orderdate, '%Y%m%d')) FROM orders JOIN customer ON o_custkey = c_custkey
   WHERE o_totalprice < 300000)
""")
def pending_units(spark, sf):
    """Orders below a price stand for the completed units of an earlier run."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ledger = orders.select(
        F.col("o_orderstatus").alias("branch"),
        F.col("c_mktsegment").alias("application_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        F.when(F.col("o_totalprice") < 300000, "completed").otherwise("failed").alias("status"),
    )
    planned = fanout.planned_units(["F", "O"], _segments(spark, sf), ["19980305", "19980306", "19980307"])
    keys = ["branch", "application_id", "date"]
    return fanout.pending_units(planned, ledger, keys).select(*keys)


@query("""
SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
       o_totalprice, CASE WHEN o_orderkey % 97 = 0 THEN 'o_orderkey' END AS rejected_for
FROM orders
""")
def quarantine_rows(spark, sf):
    good, bad = split_valid(drifted_orders(spark, sf), ORDER_SCHEMA)
    kept = good.select(F.col("o_orderkey").cast("string"), "o_totalprice", F.lit(None).cast("string").alias("rejected_for"))
    return kept.union(bad.select("o_orderkey", "o_totalprice", F.concat_ws(",", "bad_columns")))


@query("""
SELECT o_orderstatus AS application_id, 'status ' || o_orderstatus AS application_name, COUNT(*) AS n
FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus
""")
def foreach_app_text(spark, sf):
    """A query whose text names the application: built once per entry, read as one union."""
    views(spark, sf, "orders")
    path = scratch(spark, "statuses")
    keys = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("key")).distinct()
    entries = keys.select("key", F.concat(F.lit("status "), "key").alias("value"), F.lit(0).alias("position"))
    entries.withColumn("extra", F.lit(None).cast("map<string,string>")).write.parquet(path)
    sql = "SELECT o_orderkey, '$app_name' AS application_name FROM orders WHERE o_orderstatus = '$app_id'"
    count = [{"column": "o_orderkey", "function": "count", "alias": "n"}]
    spec = {
        "nodes": [
            _node("apps", "iterator", dictionary_id=1, selected_keys=["P", "F", "none"]),
            _node("extract", "jdbc_extract", sql=sql),
            _node("totals", "aggregate", group_by=["application_id", "application_name"], aggregations=count),
            _node("out", "load_sql", table_name="unused"),
        ],
        "edges": _edges(("apps", "extract"), ("extract", "totals"), ("totals", "out")),
    }
    env = graph.Environment(
        readers={"extract": lambda spark, config, context: spark.sql(context.render(config["sql"]))},
        dictionaries={"1": spark.read.parquet(path)},
    )
    return graph.build(spark, graph.Graph(spec), env)[0]["totals"]


@query("""
SELECT event_id, strftime(ts, '%Y%m%d') AS business_date FROM events
WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-07')
""")
def multi_date_events(spark, sf):
    """Times of day count to their day."""
    return fanout.multi_date(table(spark, sf, "events"), "ts", ["20240105", "20240107"]).select("event_id", "business_date")


@query("""
SELECT o_orderkey, o_orderpriority AS application_id, 'second ' || o_orderpriority AS application_name
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
""")
def foreach_app_duplicates(spark, sf):
    """An application that is listed twice is extracted once, under its last name."""
    rows = [(k, f"{n} {k}", at) for at, n in enumerate(("first", "second")) for k in ("1-URGENT", "5-LOW")]
    entries = spark.createDataFrame(rows, "key string, value string, position long")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return fanout.foreach_app(orders, "o_orderpriority", entries).drop("o_orderpriority")


PRIORITIES = [{"column": "o_orderkey", "function": "count", "alias": "n"}]


@query("""
SELECT 'good' AS part, o_orderpriority AS name, COUNT(*) AS n FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY ALL
UNION ALL SELECT 'rejected', 'o_orderkey', COUNT(*) FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'node', 'totals', 1 UNION ALL SELECT 'failed', 'gone', 1 UNION ALL SELECT 'skipped', 'gone_out', 1
""")
def reject_run(spark, sf):
    """A run whose one branch lacks its table: the other goes on, and its rows that do not fit go to a reject table."""
    db = scratch_db(spark, "rejects")
    expect = [{"name": "o_orderkey", "type": "bigint"}, {"name": "o_orderpriority", "type": "string"}]
    key = F.col("o_orderkey").cast("string")
    spoilt = F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("x"), key)).otherwise(key)
    drifted = table(spark, sf, "orders").select(spoilt.alias("o_orderkey"), "o_orderpriority")
    spec = {
        "nodes": [
            _node("orders", "table_extract", expect=expect, reject_table="rejected", reject_db=db),
            _node("by_priority", "aggregate", group_by=["o_orderpriority"], aggregations=PRIORITIES),
            _node("totals", "load_sql", namespace_db=db, table_name="totals"),
            _node("gone", "table_extract"),
            _node("gone_out", "load_sql", namespace_db=db, table_name="gone"),
        ],
        "edges": _edges(("orders", "by_priority"), ("by_priority", "totals"), ("gone", "gone_out")),
    }
    env = graph.Environment(readers={"orders": lambda *_: drifted, "gone": lambda spark, *_: spark.table(f"{db}.not_there")})
    results = graph.run(spark, graph.Graph(spec, "rejecting"), env, keep_going=True)
    states = [("skipped" if r.get("skipped") else "failed" if r.get("error") else "node", r["node_id"], 1) for r in results]
    good = spark.table(f"{db}.totals").select(F.lit("good").alias("part"), F.col("o_orderpriority").alias("name"), "n")
    bad = spark.table(f"{db}.rejected").select(F.explode("bad_columns").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return good.union(bad.select(F.lit("rejected"), "name", "n")).union(spark.createDataFrame(states, "part string, name string, n bigint"))


@query("""
SELECT 'lines' AS branch, CAST(l_returnflag AS VARCHAR) AS name, COUNT(*) AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'orders', o_orderstatus, COUNT(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'resumed', 'orders_out', 1
""")
def resumed_run(spark, sf):
    """Two appending branches, of which the second breaks; the run is started again and does only what was left."""
    db, state = scratch_db(spark, "resumed"), {"broken": True}

    def lines(spark, config, context):
        if state["broken"]:
            raise ConnectionError("the source is not there yet")
        return table(spark, sf, "lineitem")

    nodes, pairs = [], []
    for source, column in (("orders", "o_orderstatus"), ("lines", "l_returnflag")):
        count = [{"column": column, "function": "size", "alias": "n"}]
        nodes += [
            _node(source, "table_extract"),
            _node(f"{source}_n", "aggregate", group_by=[column], aggregations=count),
            _node(f"{source}_out", "load_sql", namespace_db=db, table_name=source, mode="append"),
        ]
        pairs += [(source, f"{source}_n"), (f"{source}_n", f"{source}_out")]
    env = graph.Environment(readers={"orders": _reader(spark, sf, "orders"), "lines": lines})
    pipeline, journal = graph.Graph({"nodes": nodes, "edges": _edges(*pairs)}, "resumable"), scratch(spark, "journal")
    context = RunContext(business_date="2026-04-16")
    graph.run(spark, pipeline, env, context, keep_going=True, journal=journal)
    state["broken"] = False
    again = graph.run(spark, pipeline, env, context, journal=journal)
    parts = [
        spark.table(f"{db}.{t}").select(F.lit(t).alias("branch"), F.col(c).alias("name"), "n")
        for t, c in (("lines", "l_returnflag"), ("orders", "o_orderstatus"))
    ]
    resumed = [("resumed", r["node_id"], 1) for r in again if r.get("resumed")]
    return parts[0].union(parts[1]).union(spark.createDataFrame(resumed, "branch string, name string, n bigint"))
