"""Run statistics: events stand for runs, customers for pipelines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.plans import ledger
from workloads.registry import query, table

TODAY = dt.date(2024, 1, 20)

# Run status by event type, in both languages.
STATUS = """CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'completed_with_warnings'
 WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'pending' END"""
RUNS = f"""(SELECT event_id AS id, user_id AS pipeline_id, {STATUS} AS status, ts AS started_at,
 value AS duration_seconds FROM events)"""
PIPELINES = """(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE c_mktsegment END
 AS category, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'draft' END AS status FROM customer)"""


def _runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("pipeline_id"),
        F.expr(STATUS).alias("status"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("duration_seconds"),
    )


def _pipelines(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment")).alias("category"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("draft").alias("status"),
    )


@query(f"SELECT status, COUNT(*) AS runs FROM {RUNS} GROUP BY status")
def status_breakdown(spark, sf):
    return ledger.status_breakdown(_runs(spark, sf))


@query(f"""
SELECT CAST(day AS DATE) AS day, COUNT(*) FILTER (status IN ('completed', 'completed_with_warnings')) AS completed,
       COUNT(*) FILTER (status = 'failed') AS failed
FROM range(DATE '2024-01-14', DATE '2024-01-21', INTERVAL 1 DAY) d(day)
LEFT JOIN {RUNS} ON CAST(started_at AS DATE) = CAST(day AS DATE) GROUP BY ALL
""")
def runs_by_day(spark, sf):
    return ledger.runs_by_day(_runs(spark, sf), TODAY)


@query(f"SELECT ROUND(AVG(duration_seconds), 6) AS avg_duration FROM {RUNS} WHERE status = 'completed'")
def avg_duration(spark, sf):
    return ledger.average_duration(_runs(spark, sf)).withColumn("avg_duration", F.round("avg_duration", 6))


@query(f"""
SELECT COUNT(*) FILTER (today) AS runs_today, COUNT(*) FILTER (today AND status = 'failed') AS failed,
       COUNT(*) FILTER (today AND status IN ('completed', 'completed_with_warnings')) AS completed,
       COUNT(*) FILTER (status IN ('running', 'pending')) AS running,
       (SELECT COUNT(*) FROM {PIPELINES} WHERE status = 'active') AS active_pipelines
FROM (SELECT *, CAST(started_at AS DATE) = DATE '2024-01-20' AS today FROM {RUNS})
""")
def run_kpis(spark, sf):
    return ledger.kpis(_runs(spark, sf), _pipelines(spark, sf), TODAY)


@query(f"""
SELECT p.id AS pipeline_id, p.name, r.id AS last_run_id, r.status AS last_status, r.started_at AS last_started_at,
       COALESCE(n, 0) AS total_runs
FROM {PIPELINES} p
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, id DESC) AS rn,
                  COUNT(*) OVER (PARTITION BY pipeline_id) AS n FROM {RUNS}) r
ON p.id = r.pipeline_id AND rn = 1
""")
def join_latest_run(spark, sf):
    return ledger.latest_run(_runs(spark, sf), _pipelines(spark, sf))


@query(f"""
SELECT r.id, r.pipeline_id, p.name AS pipeline_name, r.status
FROM {RUNS} r LEFT JOIN {PIPELINES} p ON r.pipeline_id = p.id
WHERE r.status = 'failed' AND (contains(CAST(r.id AS VARCHAR), '12') OR contains(lower(coalesce(p.name, '')), '12'))
""")
def join_run_names(spark, sf):
    found = ledger.run_names(_runs(spark, sf), _pipelines(spark, sf), search="12", status="failed")
    return found.select("id", "pipeline_id", "pipeline_name", "status").orderBy("id")


STEP_NAMES = ("extract", "transform", "load")


def _steps(spark, sf):
    """Three steps per run; the failed run fails in its last."""
    steps = F.array(*[F.struct(F.lit(i).alias("step_order"), F.lit(s).alias("step_type")) for i, s in enumerate(STEP_NAMES)])
    exploded = _runs(spark, sf).select(F.col("id").alias("run_id"), "status", F.inline(steps))
    state = F.when((F.col("status") == "failed") & (F.col("step_type") == "load"), "failed").otherwise("completed")
    return exploded.select("run_id", "step_order", "step_type", state.alias("step_status"))


@query(f"""
WITH last AS (SELECT pipeline_id, arg_max(status, (started_at, id)) AS last_run_status FROM {RUNS} GROUP BY pipeline_id)
SELECT p.id AS pipeline_id, p.name, last_run_status,
       CASE WHEN last_run_status IS NULL THEN NULL
            ELSE 'extract=completed,load=' || CASE WHEN last_run_status = 'failed' THEN 'failed' ELSE 'completed' END
                 || ',transform=completed' END AS step_statuses,
       CASE WHEN p.id > 0 THEN p.id - 1 END AS upstream_id
FROM {PIPELINES} p LEFT JOIN last ON p.id = last.pipeline_id
""")
def join_graph_status(spark, sf):
    customers = table(spark, sf, "customer").where("c_custkey > 0")
    edges = customers.select(F.col("c_custkey").alias("pipeline_id"), (F.col("c_custkey") - 1).alias("upstream_id"))
    found = ledger.graph_status(
        _pipelines(spark, sf).select("id", "name"), edges, _runs(spark, sf), _steps(spark, sf)
    )
    return found.select("pipeline_id", "name", "last_run_status", "step_statuses", "upstream_id")


@query(f"""
SELECT CASE WHEN trim(category) = '' THEN 'Unknown' ELSE category END AS category, COUNT(*) AS pipelines,
       trim(category) = '' AS is_default
FROM {PIPELINES} GROUP BY ALL
""")
def category_groups(spark, sf):
    return ledger.category_groups(_pipelines(spark, sf))


@query(f"""
SELECT CASE WHEN trim(category) = '' THEN 'Unknown' ELSE category END AS category, id, name FROM {PIPELINES}
""")
def category_members(spark, sf):
    return ledger.members_by_category(_pipelines(spark, sf)).select("category", "id", "name")


@query("""
SELECT CAST(step_order AS INTEGER) AS step_order, step_label, SUM(records_in) AS records_in, SUM(records_out) AS records_out
FROM (SELECT 0 AS step_order, 'filter' AS step_label, CAST(1 AS BIGINT) AS records_in,
             CAST(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS BIGINT) AS records_out FROM lineitem
      UNION ALL SELECT 1, 'late', CAST(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS BIGINT),
             CAST(CASE WHEN l_quantity > 10 AND l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) FROM lineitem)
GROUP BY ALL
""".replace("SUM(records_in)", "CAST(SUM(records_in) AS BIGINT)")
   .replace("SUM(records_out)", "CAST(SUM(records_out) AS BIGINT)"))
def step_totals(spark, sf):
    """Rows in and out of two steps, summed over the segments of a run (here: suppliers)."""
    big = F.col("l_quantity") > 10
    late = big & (F.col("l_returnflag") == "R")
    per_segment = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(big).alias("big"), F.count_if(late).alias("late")
    )
    rows = F.array(
        F.struct(F.lit(0).alias("step_order"), F.lit("filter").alias("step_label"),
                 F.col("n").alias("records_in"), F.col("big").alias("records_out")),
        F.struct(F.lit(1).alias("step_order"), F.lit("late").alias("step_label"),
                 F.col("big").alias("records_in"), F.col("late").alias("records_out")),
    )
    return ledger.step_rows(per_segment.select(F.inline(rows)))
