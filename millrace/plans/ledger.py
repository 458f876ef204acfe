"""Statistics over the tables of past runs.

``runs`` has id, pipeline_id, status, started_at, duration_seconds; ``run_steps``
and ``run_logs`` refer to it by ``run_id``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.join import join_tables
from millrace.sinks.tables import write_records

RUNS = """id string, pipeline_id string, status string, started_at timestamp, finished_at timestamp,
 duration_seconds double, records_loaded long, error_message string"""
STEPS = """run_id string, step_order int, step_type string, step_label string, step_status string, target string,
 records_in long, records_out long"""
GOOD = ("completed", "completed_with_warnings")
DEFAULT_CATEGORY = "Unknown"


def status_breakdown(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("runs"), "status")


def runs_by_day(runs: DataFrame, today: dt.date, days: int = 7) -> DataFrame:
    """Completed and failed runs of the last days, days without runs as zero."""
    first = today - dt.timedelta(days=days - 1)
    spark = runs.sparkSession
    calendar = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    # Bounds on the raw column, so the scan skips older data.
    recent = runs.where(
        (F.col("started_at") >= F.lit(first).cast("timestamp_ntz"))
        & (F.col("started_at") < F.lit(today + dt.timedelta(days=1)).cast("timestamp_ntz"))
    )
    counts = recent.groupBy(F.to_date("started_at").alias("run_day")).agg(
        F.count_if(F.col("status").isin(*GOOD)).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    joined = calendar.join(counts, F.col("day") == F.col("run_day"), "left")
    return joined.select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("completed", "failed")]).orderBy("day")


def average_duration(runs: DataFrame) -> DataFrame:
    done = runs.where((F.col("status") == "completed") & F.col("duration_seconds").isNotNull())
    return done.agg(F.avg("duration_seconds").alias("avg_duration"))


def kpis(runs: DataFrame, pipelines: DataFrame, today: dt.date) -> DataFrame:
    """Counts for the head of a dashboard, in one pass over the runs."""
    status = F.col("status")
    now = F.to_date("started_at") == F.lit(today)
    head = runs.agg(
        F.count_if(now).alias("runs_today"),
        F.count_if(now & (status == "failed")).alias("failed"),
        F.count_if(now & status.isin(*GOOD)).alias("completed"),
        F.count_if(status.isin("running", "pending")).alias("running"),
    )
    active = pipelines.agg(F.count_if(F.col("status") == "active").alias("active_pipelines"))
    return head.select("*", active.scalar().alias("active_pipelines"))


def latest_run(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Every pipeline with its newest run and its number of runs: one aggregation, no query per pipeline."""
    newest = F.max_by(F.struct("id", "status", "started_at"), F.struct("started_at", "id"))
    last = runs.groupBy("pipeline_id").agg(newest.alias("last"), F.count(F.lit(1)).alias("total_runs"))
    joined = pipelines.join(last, pipelines["id"] == last["pipeline_id"], "left")
    return joined.select(
        pipelines["id"].alias("pipeline_id"),
        "name",
        F.col("last.id").alias("last_run_id"),
        F.col("last.status").alias("last_status"),
        F.col("last.started_at").alias("last_started_at"),
        F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
    )


def run_names(
    runs: DataFrame, pipelines: DataFrame, search: str = "", status: str = "", pipeline_id: str = ""
) -> DataFrame:
    """Runs with their pipeline's name, filtered by status, pipeline and text in id or name."""
    if status:
        runs = runs.where(F.col("status") == status)
    if pipeline_id:
        runs = runs.where(F.col("pipeline_id") == F.lit(pipeline_id).cast(runs.schema["pipeline_id"].dataType))
    names = pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"))
    out = runs.transform(join_tables(names, [{"left": "pipeline_id", "right": "pipeline_id"}], "left", "p_", False))
    out = out.drop("p_pipeline_id")
    if search:
        in_name = F.lower(F.coalesce("pipeline_name", F.lit(""))).contains(search.lower())
        out = out.where(F.col("id").cast("string").contains(search) | in_name)
    return out


def graph_status(pipelines: DataFrame, dependencies: DataFrame, runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Pipelines with upstream pipelines, last status and the step statuses of the last run.

    Rows are joined down to the last runs before step statuses are collected, so a
    collected map holds one entry per step type.
    """
    last = runs.groupBy("pipeline_id").agg(
        F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("last")
    )
    last = last.select("pipeline_id", F.col("last.id").alias("run_id"), F.col("last.status").alias("last_run_status"))
    by_type = (
        steps.join(last, "run_id")
        .groupBy("pipeline_id", "step_type")
        .agg(F.max_by("step_status", "step_order").alias("step_status"))
        .groupBy("pipeline_id")
        .agg(F.array_sort(F.collect_list(F.struct("step_type", "step_status"))).alias("entries"))
    )
    text = F.concat_ws(",", F.transform("entries", lambda e: F.concat_ws("=", e["step_type"], e["step_status"])))
    nodes = (
        pipelines.withColumnRenamed("id", "pipeline_id")
        .join(last.drop("run_id"), "pipeline_id", "left")
        .join(by_type.select("pipeline_id", text.alias("step_statuses")), "pipeline_id", "left")
    )
    return nodes.join(dependencies.select("pipeline_id", "upstream_id"), "pipeline_id", "left")


def category_groups(pipelines: DataFrame, default: str = DEFAULT_CATEGORY) -> DataFrame:
    """Pipelines ordered by category, the default category last; empty categories count as default."""
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(default))
    named = pipelines.withColumn("category", category)
    sizes = named.groupBy("category").agg(F.count(F.lit(1)).alias("pipelines"))
    return sizes.withColumn("is_default", F.col("category") == default).orderBy("is_default", "category")


def members_by_category(pipelines: DataFrame, default: str = DEFAULT_CATEGORY) -> DataFrame:
    """The pipelines themselves in that order."""
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(default))
    return pipelines.withColumn("category", category).orderBy(F.col("category") == default, "category", "id")


def filter_logs(logs: DataFrame, levels: list[str] | None = None, step: str = "", search: str = "") -> DataFrame:
    """Log rows by level set, step and text in message or step."""
    if levels:
        logs = logs.where(F.upper(F.coalesce("level", F.lit(""))).isin([x.upper() for x in levels]))
    if step:
        logs = logs.where(F.col("step") == step)
    if search:
        found: list[Column] = [F.coalesce(F.lower(c).contains(search.lower()), F.lit(False)) for c in ("message", "step")]
        logs = logs.where(found[0] | found[1])
    return logs


def step_rows(steps: DataFrame) -> DataFrame:
    """Rows in and out per step, summed over its segments."""
    return steps.groupBy("step_order", "step_label").agg(
        F.sum("records_in").alias("records_in"), F.sum("records_out").alias("records_out")
    )


def record_run(spark: SparkSession, namespace: str, pipeline: str, work: Callable[[], list[dict]]) -> list[dict]:
    """Run ``work`` and append its outcome to the tables ``runs`` and ``run_steps`` of a namespace.

    These are what the statistics above read. ``work`` returns one result per
    load (``label``, ``rows_loaded``, ``table`` or ``path``, and ``type``, ``rows_in`` if
    it knows them). A failure is recorded and raised again.
    """
    run_id, started = uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc)
    results: list[dict] = []
    status, error = "failed", None
    try:
        results = work()
        status = "completed"
        return results
    except Exception as err:
        error = str(err)
        raise
    finally:
        ended = dt.datetime.now(dt.timezone.utc)
        loaded = sum(r["rows_loaded"] for r in results)
        run = (run_id, pipeline, status, started, ended, (ended - started).total_seconds(), loaded, error)
        write_records(spark, [run], namespace, "runs", schema=RUNS)
        steps = [
            (run_id, i, r.get("type", "load"), r["label"], status, r.get("table") or r.get("path"), r.get("rows_in", r["rows_loaded"]), r["rows_loaded"])
            for i, r in enumerate(results)
        ]
        write_records(spark, steps, namespace, "run_steps", schema=STEPS)
