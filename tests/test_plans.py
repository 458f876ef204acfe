"""Graphs, SQL and callable transforms, fan-out and ledger."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.plans import fanout, graph, ledger, transforms
from millrace.plans.context import RunContext
from millrace.plans.readers import standard_readers
from millrace.sinks import tables, units
from millrace.sources.layout import Layout
from millrace.sources.objectstore import ObjectStore


def node(nid, kind, **config):
    return {"id": nid, "data": {"nodeType": kind, "label": nid, "config": config}}


def spec(nodes, *pairs):
    return {"nodes": nodes, "edges": [{"source": a, "target": b} for a, b in pairs]}


@pytest.fixture
def db(spark):
    name = f"p_{uuid.uuid4().hex[:8]}"
    tables.ensure_namespace(spark, name)
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@pytest.mark.parametrize(
    "bad,words",
    [
        (spec([node("s", "jdbc_extract")]), "without a downstream load"),
        (spec([node("s", "jdbc_extract"), node("f", "filter"), node("l", "load_sql")], ("s", "f")), "no input"),
        (spec([node("x", "blend")]), "unknown type"),
        (spec([node("s", "jdbc_extract")], ("s", "zz")), "unknown node"),
        (spec([node("a", "filter"), node("b", "filter")], ("a", "b"), ("b", "a")), "cycle"),
        (spec([node("s", "jdbc_extract"), node("j", "join"), node("l", "load_sql")], ("s", "j"), ("j", "l")), "two inputs"),
    ],
)
def test_bad_graphs(bad, words):
    with pytest.raises(ValueError, match=words):
        graph.Graph(bad)


def test_branches():
    g = graph.Graph(
        spec(
            [node("it", "iterator"), node("a", "jdbc_extract"), node("b", "s3_extract"), node("f", "filter"),
             node("stage", "load_parquet"), node("s", "sort"), node("out", "load_sql")],
            ("it", "a"), ("a", "f"), ("f", "stage"), ("stage", "s"), ("b", "s"), ("s", "out"),
        ),
        "my pipe",
    )
    a, b = sorted(g.branches(), key=lambda x: x.source)
    assert (a.transforms, a.loads, a.staging, a.iterator) == (["f", "s"], ["stage", "out"], "stage", "it")
    assert (b.transforms, b.loads, b.staging, b.iterator) == (["s"], ["out"], None, None)
    assert a.job_name == "MY_PIPE_A"


def test_run_with_two_sources_and_staging(spark, db, tmp_path):
    reads = []

    def reader(spark, config, ctx):
        reads.append(config["n"])
        return spark.range(config["n"]).withColumn("src", F.lit(config["n"]))

    g = graph.Graph(
        spec(
            [node("a", "table_extract", n=3), node("b", "table_extract", n=2), node("stage", "load_parquet"),
             node("f", "filter", conditions=[{"column": "id", "operator": ">", "value": 0}]),
             node("out", "load_sql", namespace_db=db, table_name="t")],
            ("a", "stage"), ("stage", "f"), ("b", "f"), ("f", "out"),
        )
    )
    env = graph.Environment(readers={"table_extract": reader}, output=Layout(str(tmp_path)))
    done = {r["node_id"]: r for r in graph.run(spark, g, env, RunContext("2026-04-16"))}
    assert done["stage"]["rows_loaded"] == 3 and done["out"]["rows_loaded"] == 3 and sorted(reads) == [2, 3]
    assert done["stage"]["path"] == f"{tmp_path}/20260416/PIPELINE/STAGE"
    assert sorted(tuple(r) for r in spark.table(f"{db}.t").collect()) == [(1, 2), (1, 3), (2, 3)]
    frames, nothing = graph.build(spark, g, env)
    assert nothing == [] and frames["out"].count() == 3


def test_partitioned_staging_passes_on_only_its_own_rows(spark, db, tmp_path):
    rows = lambda s, c, x: s.sql(f"SELECT id, '{x.business_date}' AS bd FROM range(3)").replace("-", "", "bd")
    stage = node("stage", "load_parquet", partition_by=["bd"], path_template="all")
    out = node("out", "load_sql", namespace_db=db, table_name="t")
    g = graph.Graph(spec([node("a", "table_extract"), stage, out], ("a", "stage"), ("stage", "out")))
    env = graph.Environment({"a": rows}, output=Layout(str(tmp_path)))
    for day in ("20260415", "20260416"):
        done = graph.run(spark, g, env, RunContext(day))
        assert [r["rows_loaded"] for r in done] == [3, 3]
        assert {(r.bd, r.id) for r in spark.table(f"{db}.t").collect()} == {(day, n) for n in range(3)}
        assert dict(spark.table(f"{db}.t").dtypes)["bd"] == "string"


def test_csv_load_chunks_and_extracts_with_a_target(spark, db, tmp_path):
    csv = node("csv", "load_parquet", output_format="csv")
    source = node("s", "s3_extract", target_db=db, target_table="raw", chunk_size=4)
    total = node("agg", "aggregate", aggregations=[{"column": "id", "function": "count", "alias": "n"}])
    out = node("out", "load_sql", namespace_db=db, table_name="t")
    g = graph.Graph(spec([source, csv, total, out], ("s", "csv"), ("csv", "agg"), ("agg", "out")))
    env = graph.Environment({"s": lambda s, c, x: s.range(10).coalesce(1)}, output=Layout(str(tmp_path)))
    done = {r["node_id"]: r for r in graph.run(spark, g, env, RunContext("2026-04-16"))}
    assert {k: r["rows_loaded"] for k, r in done.items()} == {"s": 10, "csv": 10, "out": 1}
    assert spark.table(f"{db}.raw").count() == 10 and spark.table(f"{db}.t").first().n == 10
    assert len(spark.read.csv(done["csv"]["path"], header=True).inputFiles()) == 3
    alone = graph.Graph(spec([node("s", "s3_extract", target_db=db, target_table="raw", write_mode="append")]))
    graph.run(spark, alone, env)
    assert spark.table(f"{db}.raw").count() == 20


def test_context_namespace_and_legacy_config(spark):
    name = f"z{uuid.uuid4().hex[:6]}_"
    env = graph.Environment(readers={"csv_extract": lambda s, c, x: s.range(4).withColumn("k", F.col("id") % 2)})
    g = graph.Graph(spec([node("a", "csv_extract"), node("out", "load_sql", table_name="t")], ("a", "out")))
    ctx = RunContext("2026-04-16", namespace_prefix=name)
    done = graph.run(spark, g, env, ctx, {"rename": {"k": "kk"}, "filters": {"kk": 1}})
    assert done[0]["table"] == f"`{name}20260416`.`t`"
    assert sorted(r.id for r in spark.table(f"{name}20260416.t").collect()) == [1, 3]
    spark.sql(f"DROP DATABASE {name}20260416 CASCADE")


def test_misconfigured_steps_raise(spark):
    df = spark.range(3)
    for step in [
        {"type": "lookup", "config": {"dict_id": 9, "match_column": "id", "output_column": "x"}},
        {"type": "aggregate", "config": {"group_by": ["zz"], "aggregations": [{"column": "id"}]}},
        {"type": "blend"},
    ]:
        with pytest.raises(ValueError):
            graph.apply_steps(df, [step])


def test_steps_and_observed_rows(spark, tmp_path):
    steps = [
        {"type": "filter", "config": {"conditions": [{"column": "id", "operator": ">=", "value": "4"}]}},
        {"type": "notebook_transform", "config": {"callable": "double"}},
        {"type": "sql_transform", "config": {"sql": "SELECT sum(id) AS s FROM source"}},
    ]
    env = graph.Environment(callables={"double": lambda spark, df, ctx: df.union(df)})
    out, seen = graph.observe_steps(spark.range(10), steps, env)
    assert out.collect()[0].s == 78
    assert {k: v.get["rows"] for k, v in seen.items()} == {
        "input": 10, "1:filter": 6, "2:notebook_transform": 12, "3:sql_transform": 1,
    }


# ---- SQL and callables


def test_statements():
    assert transforms.check_statement(" with x as (select 1) select * from x")
    for sql in ("GRANT ALL", "", "MERGE INTO t"):
        with pytest.raises(ValueError):
            transforms.check_statement(sql)


def test_source_view_is_put_back(spark):
    spark.range(3).createOrReplaceTempView("source")
    out = transforms.sql_over(spark.range(10), "SELECT count(*) AS n FROM source")
    assert out.first().n == 10 and spark.table("source").count() == 3
    spark.catalog.dropTempView("source")
    nested = transforms.sql_over(out, "SELECT n + 1 AS n FROM source")
    assert nested.first().n == 11 and not spark.catalog.tableExists("source")
    with pytest.raises(Exception):
        transforms.sql_over(out, "SELECT zz FROM source")
    assert not spark.catalog.tableExists("source")
    assert transforms.sql_template(spark.range(4), "SELECT max(id) AS m FROM {source}").first().m == 3


def test_transform_tables(spark, db):
    tables.write_table(spark.range(5), db, "a")
    done = transforms.run_sql_transform(spark, "a", "SELECT id * 2 AS x FROM source", db, "b", source_db=db)
    assert done["rows_loaded"] == 5
    plus = lambda spark, df, ctx: df.withColumn("run", F.lit(ctx.run_id))
    transforms.run_callable_transform(spark, "b", plus, db, "c", source_db=db, context=RunContext(run_id=4))
    assert spark.table(f"{db}.c").select("run").distinct().collect()[0].run == 4
    with pytest.raises(TypeError):
        transforms.apply_callable(spark.range(1), lambda spark, df, ctx: None)
    with pytest.raises(ValueError):
        transforms.read_table(spark, "a", "no_such_db")
    with pytest.raises(ValueError):
        transforms.export_frames({}, "result_df", db, "d")


def test_export_for_apps(spark, db):
    fn = lambda spark, df, ctx: spark.range(int(ctx.app_id))
    done = transforms.export_for_apps(spark, fn, [RunContext(app_id="2"), RunContext(app_id="3")], db, "e")
    assert done["rows_loaded"] == 5
    assert {r.application_id: r["count"] for r in spark.table(f"{db}.e").groupBy("application_id").count().collect()} == {"2": 2, "3": 3}


def test_previews(spark):
    spark.range(300).createOrReplaceTempView("numbers")
    assert transforms.preview_sql(spark, "SELECT * FROM numbers WHERE id >= $from ;", {"from": 10}).count() == 100
    assert transforms.preview_sql(spark, "SELECT * FROM numbers LIMIT 150").count() == 150
    with pytest.raises(ValueError):
        transforms.preview_sql(spark, "DROP VIEW numbers")
    assert transforms.preview(spark.range(9), "SELECT id FROM source", 4, ["id"]).count() == 4


# ---- fan-out


def test_output_paths():
    assert fanout.entry_folder("{app_id}/x y", {"app_id": "a.1"}) == "a_1/x_y"
    assert fanout.entry_folder("{zz}/x", {"app_id": "a"}) == "_zz_/x"


def test_units_and_apps(rows):
    apps = rows([("1", "one"), ("2", "two")], "key string, value string")
    units = fanout.planned_units(["x", "y"], apps, ["20260416"])
    done = rows([("x", "1", "20260416", "completed"), ("y", "1", "20260416", "failed")],
                "branch string, application_id string, date string, status string")
    left = fanout.pending_units(units, done, ["branch", "application_id", "date"])
    assert sorted((r.branch, r.application_id) for r in left.collect()) == [("x", "2"), ("y", "1"), ("y", "2")]
    facts = rows([(1, 5), (3, 6), (None, 7)], "app int, v int")
    assert [tuple(r) for r in fanout.foreach_app(facts, "app", apps, ["1", "2"]).collect()] == [(1, 5, "1", "one")]


def test_foreach_extract_goes_on_after_an_error(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("numbers")
    entries = [{"key": "3", "value": "a"}, {"key": "oops(", "value": "b"}, {"key": "5", "value": "c"}]
    sql = "SELECT * FROM numbers WHERE id < $app_id"
    got = {r.key: r for r in fanout.foreach_extract(spark, sql, entries, str(tmp_path), "{app_id}").collect()}
    assert (got["3"].total_rows, got["5"].total_rows, got["oops("].total_rows) == (3, 5, 0)
    assert got["3"].error is None and got["oops("].error
    with pytest.raises(ValueError):
        fanout.foreach_extract(spark, "DROP TABLE x", entries, str(tmp_path), "x")


def test_dates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT id, date_add(date'2026-04-14', cast(id AS int)) AS d FROM range(5)").write.parquet(path)
    out = fanout.multi_date(spark.read.parquet(path), "d", ["20260415", "20260417"])
    assert sorted((r.id, r.business_date) for r in out.collect()) == [(1, "20260415"), (3, "20260417")]
    assert "In(d, [2026-04-15,2026-04-17])" in out._jdf.queryExecution().executedPlan().toString()


# ---- ledger


def test_statistics(rows):
    at = lambda d, h=0: dt.datetime(2026, 4, d, h)
    runs = rows(
        [(1, 1, "completed", at(16), 2.0), (2, 1, "failed", at(16, 5), 9.0), (3, 2, "completed", at(10), None),
         (4, 2, "running", at(15), None), (5, 9, "completed_with_warnings", at(16), 4.0), (6, 1, "pending", None, None)],
        "id int, pipeline_id int, status string, started_at timestamp_ntz, duration_seconds double",
    )
    pipes = rows([(1, "First", "active", "Risk"), (2, "Second", "draft", None), (3, "Third", "active", " "), (4, "4", "x", "Trade")],
                 "id int, name string, status string, category string")
    today = dt.date(2026, 4, 16)
    assert tuple(ledger.kpis(runs, pipes, today).first()) == (3, 1, 2, 2, 2)
    days = [(r.day.day, r.completed, r.failed) for r in ledger.runs_by_day(runs, today).collect()]
    assert days == [(10, 1, 0), (11, 0, 0), (12, 0, 0), (13, 0, 0), (14, 0, 0), (15, 0, 0), (16, 2, 1)]
    assert ledger.average_duration(runs).first()[0] == 2.0
    assert ledger.average_duration(runs.where("id = 2")).first()[0] is None
    latest = {r.pipeline_id: (r.last_run_id, r.total_runs) for r in ledger.latest_run(runs, pipes).collect()}
    assert latest == {1: (2, 3), 2: (4, 2), 3: (None, 0), 4: (None, 0)}
    assert [r.category for r in ledger.category_groups(pipes).collect()] == ["Risk", "Trade", "Unknown"]
    assert [r.id for r in ledger.members_by_category(pipes).collect()] == [1, 4, 2, 3]
    assert [r.status for r in ledger.status_breakdown(runs).collect()][0] == "completed"
    found = lambda **k: sorted(r.id for r in ledger.run_names(runs, pipes, **k).collect())
    assert found() == [1, 2, 3, 4, 5, 6] and found(search="SEC") == [3, 4] and found(search="5") == [5]
    assert found(status="completed", pipeline_id="2") == [3]


def test_logs(rows):
    logs = rows([("INFO", "Read rows", "extract"), ("warn", "slow READ", None), (None, "x", "load"), ("ERROR", None, "Reader")],
                "level string, message string, step string")
    assert ledger.filter_logs(logs, ["info", "WARN"]).count() == 2
    assert ledger.filter_logs(logs, search="read").count() == 3
    assert ledger.filter_logs(logs, step="load").count() == 1


# ---- sources of a graph


def run_once(spark, db, nodes, env, *edges, ctx=None):
    load = node("out", "load_sql", namespace_db=db, table_name="t")
    graph.run(spark, graph.Graph(spec([*nodes, load], *edges)), env, ctx or RunContext("2026-04-16"))
    return spark.table(f"{db}.t")


@pytest.fixture
def apps(rows):
    return rows([("1", "one", None, 0), ("2", "two", {"desk": "x"}, 1), ("3", "three", {"desk": "x"}, 2)],
                "key string, value string, extra map<string,string>, position int")


def test_iterator_by_column(spark, rows, db, apps):
    facts = rows([(1, 5), (2, 6), (3, 7), (9, 8)], "app int, v int")
    env = graph.Environment({"s": lambda *a: facts}, {"d": apps})
    it = node("it", "iterator", dictionary_id="d", entry_filters=[{"column": "desk", "value": "x"}])
    out = run_once(spark, db, [it, node("s", "jdbc_extract", app_column="app")], env, ("it", "s"), ("s", "out"))
    assert sorted((r.v, r.application_id, r.application_name) for r in out.collect()) == [(6, "2", "two"), (7, "3", "three")]
    with pytest.raises(ValueError, match="dictionary"):
        run_once(spark, db, [it, node("s", "jdbc_extract")], graph.Environment(env.readers), ("it", "s"), ("s", "out"))


def test_iterator_by_text(spark, db, apps):
    read = lambda spark, cfg, ctx: spark.sql(ctx.render(cfg["sql"]))
    env = graph.Environment({"s": read}, {"d": apps})
    it = node("it", "iterator", dictionary_id="d", selected_keys=["3", "1"])
    source = node("s", "jdbc_extract", sql="SELECT '$app_name' AS n, '$business_date' AS d")
    out = run_once(spark, db, [it, source], env, ("it", "s"), ("s", "out"))
    assert sorted(tuple(r) for r in out.collect()) == [("one", "20260416", "1"), ("three", "20260416", "3")]
    none = node("it", "iterator", dictionary_id="d", selected_keys=["zz"])
    with pytest.raises(ValueError, match="no entry"):
        run_once(spark, db, [none, source], env, ("it", "s"), ("s", "out"))


def test_dates_of_a_source(spark, db):
    days = lambda s, c, x: s.sql("SELECT date_add(date'2026-04-10', cast(id AS int)) AS d FROM range(9)")
    source = node("s", "table_extract", date_column="d", date_from="2026-04-12", date_to="2026-04-13")
    out = run_once(spark, db, [source], graph.Environment({"s": days}), ("s", "out"))
    assert sorted(r.business_date for r in out.collect()) == ["20260412", "20260413"]


def test_graph_may_start_with_sql_or_a_callable(spark, db):
    sql = node("q", "sql_transform", sql="SELECT '$business_date' AS d, count(*) AS n FROM range(5)", source_db="default")
    assert [tuple(r) for r in run_once(spark, db, [sql], graph.Environment(), ("q", "out")).collect()] == [("20260416", 5)]
    call = node("c", "notebook_transform", callable="f")
    env = graph.Environment(callables={"f": lambda spark, df, ctx: spark.range(4)})
    assert run_once(spark, db, [call], env, ("c", "out")).count() == 4


def test_standard_readers(spark, db, tmp_path):
    (tmp_path / "2026").mkdir()
    (tmp_path / "2026" / "a.csv").write_text("k;v\na;1\n")
    (tmp_path / "b.json").write_text('{"k": "b", "v": 2}\n')
    spark.range(3).write.saveAsTable(f"{db}.numbers")
    env = graph.Environment(
        standard_readers(stores={"7": ObjectStore(str(tmp_path), "file")}, sources_dir=str(tmp_path))
    )
    nodes = [
        node("c", "csv_extract", file_path="2026/a.csv", csv_delimiter=";"),
        node("j", "json_extract", file_path="b.json"),
        node("o", "s3_extract", connection_id=7, pattern="*.csv", csv_sep=";", transform_sql="SELECT k, v + 10 AS v FROM {source}"),
        node("n", "table_extract", table="numbers", database=db),
    ]
    out = run_once(spark, db, nodes, env, *[(n["id"], "out") for n in nodes])
    got = sorted(((r.k, r.v, r.id) for r in out.collect()), key=str)
    assert got == sorted([("a", 1, None), ("b", 2, None), ("a", 11, None), (None, None, 0), (None, None, 1), (None, None, 2)], key=str)
    with pytest.raises(ValueError, match="connection"):
        run_once(spark, db, [node("x", "jdbc_extract", connection_id=1, sql="SELECT 1")], env, ("x", "out"))


def test_run_is_recorded(spark, db, rows):
    work = lambda: [{"label": "out", "table": "t", "rows_loaded": 3}]
    ledger.record_run(spark, db, "daily", work)
    with pytest.raises(RuntimeError):
        ledger.record_run(spark, db, "daily", lambda: (_ for _ in ()).throw(RuntimeError("boom")))
    got = {r.status: (r.records_loaded, r.error_message) for r in spark.table(f"{db}.runs").collect()}
    assert got == {"completed": (3, None), "failed": (0, "boom")}
    assert [(r.step_label, r.records_out) for r in spark.table(f"{db}.run_steps").collect()] == [("out", 3)]
    # The statistics read what was recorded.
    runs, steps = spark.table(f"{db}.runs"), spark.table(f"{db}.run_steps")
    pipes = rows([("daily", "Daily")], "id string, name string")
    last = ledger.latest_run(runs, pipes).first()
    assert (last.last_status, last.total_runs) == ("failed", 2)
    assert ledger.run_names(runs, pipes, search="DAI", status="completed").count() == 1
    assert [tuple(r) for r in ledger.step_rows(steps).collect()] == [(0, "out", 3, 3)]
    good = runs.where("status = 'completed'")
    edges = rows([("daily", "before")], "pipeline_id string, upstream_id string")
    shown = ledger.graph_status(pipes, edges, good, steps).first()
    assert (shown.last_run_status, shown.step_statuses, shown.upstream_id) == ("completed", "load=completed", "before")


def branches(db, mode="append"):
    """One source, two transforms with two loads each below it, and a branch of its own."""
    count = [{"column": "x", "function": "count", "alias": "n"}]
    nodes = [
        node("src", "table_extract"),
        node("sq", "sql_transform", sql="SELECT k, x * 2 AS x FROM source"),
        node("a", "load_sql", namespace_db=db, table_name="a", mode=mode),
        node("g", "aggregate", group_by=["k"], aggregations=count),
        node("b", "load_sql", namespace_db=db, table_name="b", mode=mode),
        node("other", "table_extract"),
        node("c", "load_sql", namespace_db=db, table_name="c", mode=mode),
    ]
    return graph.Graph(spec(nodes, ("src", "sq"), ("sq", "a"), ("sq", "g"), ("g", "b"), ("other", "c")), "branches")


def test_a_broken_branch_leaves_the_others(spark, rows, db):
    def broken(*_):
        raise ValueError("no such source\nmore")

    good = rows([("p", 1), ("q", 2), ("p", 3)], "k string, x long")
    env = graph.Environment(readers={"src": broken, "other": lambda *_: good})
    out = {r["node_id"]: r for r in graph.run(spark, branches(db), env, keep_going=True)}
    assert out["src"]["error"] == "no such source" and not out["src"]["skipped"]
    assert all(out[n]["skipped"] for n in ("sq", "a", "g", "b")) and out["c"]["rows_loaded"] == 3
    assert spark.table(f"{db}.c").count() == 3
    with pytest.raises(ValueError, match="no such source"):
        graph.run(spark, branches(db), env)


def test_a_broken_run_goes_on_without_doubles(spark, rows, db, tmp_path):
    frame, read = rows([("p", 1), ("q", 2), ("p", 3)], "k string, x long"), []
    fail = {"other": True}

    def reader(nid):
        def get(*_):
            read.append(nid)
            if fail.get(nid):
                raise ValueError("gone")
            return frame

        return get

    env = graph.Environment(readers={n: reader(n) for n in ("src", "other")})
    go = lambda date="2026-04-16": graph.run(spark, branches(db), env, RunContext(business_date=date), keep_going=True, journal=f"{tmp_path}/j")
    first = {r["node_id"]: r for r in go()}
    assert first["a"]["rows_loaded"] == 3 and first["c"]["skipped"]
    fail.clear()
    read.clear()
    second = {r["node_id"]: r for r in go()}
    assert read == ["other"] and second["a"]["resumed"] and second["b"]["resumed"] and second["c"]["rows_loaded"] == 3
    third = go()
    assert all(r["resumed"] for r in third) and read == ["other"]
    assert {t: spark.table(f"{db}.{t}").count() for t in "abc"} == {"a": 3, "b": 2, "c": 3}
    go("2026-04-17")  # another date is other units
    assert {t: spark.table(f"{db}.{t}").count() for t in "abc"} == {"a": 6, "b": 4, "c": 6}


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_a_unit_that_is_done_again_replaces_its_rows(spark, rows, db, tmp_path, monkeypatch, keys):
    frame = rows([("p", 1), ("q", 2), ("p", 3)], "k string, x long").select("x", "k")
    frame.limit(1).write.partitionBy(*keys or []).saveAsTable(f"{db}.t")
    units.append_unit_table(frame, f"{db}.t", "u-1", keys)
    assert units.append_unit_table(frame, f"{db}.t", "u-1", keys) == 3  # its record was lost
    units.append_unit_table(frame, f"{db}.t", "u-2", keys)
    assert spark.table(f"{db}.t").count() == 7
    journal = units.Journal(f"{tmp_path}/j")
    assert journal.done(spark, "u-1") is None
    journal.finish(spark, "u-1", {"rows_loaded": 3})
    assert journal.done(spark, "u-1") == {"rows_loaded": 3}
    # files that a broken run had moved already are replaced
    units.append_unit(frame, f"{tmp_path}/d", "u-1")
    (tmp_path / "d" / "_staged-u-1").mkdir()
    assert units.append_unit(frame.limit(2), f"{tmp_path}/d", "u-1") == 2 and spark.read.parquet(f"{tmp_path}/d").count() == 2


def test_a_shared_node_is_computed_once(spark, db, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    spark.range(40).select(F.lit("p").alias("k"), F.col("id").alias("x")).write.parquet(f"{tmp_path}/s")
    g = branches(db, "overwrite")
    twice = lambda _, frame, *__: frame.withColumn("x", counted("x"))
    g.nodes["sq"].type, g.nodes["sq"].config = "notebook_transform", {"callable": "twice"}
    source = spark.read.parquet(f"{tmp_path}/s")
    env = graph.Environment(readers={"src": lambda *_: source, "other": lambda *_: source}, callables={"twice": twice})
    graph.run(spark, g, env)
    assert seen.value == 40 and spark.table(f"{db}.b").first()["n"] == 40


def test_rows_that_do_not_fit_go_to_the_reject_table(spark, rows, db):
    frame = rows([("p", "1", None), ("q", "x", "2026-01-01"), ("r", "3", "never"), ("s", None, None)], "k string, x string, d string")
    expect = [{"name": n, "type": t} for n, t in (("k", "string"), ("x", "bigint"), ("d", "date"))]
    nodes = [node("src", "table_extract", expect=expect, reject_table="bad", reject_db=db), node("out", "load_sql", namespace_db=db, table_name="good")]
    env = graph.Environment(readers={"src": lambda *_: frame})
    for _ in range(2):  # a repeated run replaces its rejects
        graph.run(spark, graph.Graph(spec(nodes, ("src", "out"))), env)
    assert sorted((r.k, r.x) for r in spark.table(f"{db}.good").collect()) == [("p", 1), ("s", None)]
    bad = sorted(tuple(r) for r in spark.table(f"{db}.bad").collect())
    assert bad == [("src", ["d"], '{"k":"r","x":"3","d":"never"}'), ("src", ["x"], '{"k":"q","x":"x","d":"2026-01-01"}')]
