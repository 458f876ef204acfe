"""Scans, sinks and the folder layout."""

from __future__ import annotations

import fnmatch
import functools
import re
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from millrace.plans.ingest import ingest_files
from millrace.sinks import files as sink, tables
from millrace.sources import files, jdbc, layout, splits
from millrace.sources.objectstore import ObjectStore


@pytest.fixture
def db(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    tables.ensure_namespace(spark, name)
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv(spark, tmp_path):
    plain = put(tmp_path / "a.csv", "id,val\n1,alpha\n2,beta\n")
    assert [tuple(r) for r in files.scan_csv(spark, plain).collect()] == [(1, "alpha"), (2, "beta")]
    bare = put(tmp_path / "b.txt", "1;ä\n2;ö\n", "latin-1")
    df = files.scan_csv(spark, bare, sep=";", header=False, encoding="latin1")
    assert df.columns == ["0", "1"] and [r["1"] for r in df.collect()] == ["ä", "ö"]


def test_json(spark, tmp_path):
    lines = put(tmp_path / "a.json", '{"a": 1, "m": {"ip": "x"}}\n{"a": 2}\n')
    assert [r.a for r in files.scan_json(spark, lines).collect()] == [1, 2]
    array = put(tmp_path / "b.json", '[{"a": 1},\n {"a": 2, "m": {"ip": "y"}}]')
    df = files.scan_json(spark, array, lines=False)
    assert [r[0] for r in df.select("m.ip").collect()] == [None, "y"]


def test_formats():
    names = {"x.PARQUET": "parquet", "a.snappy.parquet": "parquet", "a.csv": "csv", "a.csv.gz": "csv", "a.json": "json",
             "a.jsonl": "json", "a.orc": "orc", "a.txt": "parquet"}
    assert {n: files.detect_format(n) for n in names} == names


@pytest.mark.parametrize("pattern", ["*", "*.json", "2026-*/*.json", "2026-04-1?/a.json", "*/[ab].json", "a*", "in/2026*.json",
                                     "in/*", "zz*", "*/b.json", "2026-04-16/deep/*"])
def test_glob_follows_fnmatch(spark, tmp_path, pattern):
    names = ["in/2026-04-16/a.json", "in/2026-04-17/b.json", "in/2026-04-16/deep/c.json", "in/a.json", "out/a.json"]
    for n in names:
        put(tmp_path / n, f'{{"n": "{n}"}}\n')
    keys = [n for n in names if n.startswith("in/")]
    expected = {k for k in keys if fnmatch.fnmatch(k[3:], pattern) or fnmatch.fnmatch(k, pattern)}
    got = files.scan_glob(spark, str(tmp_path), "in", pattern, "json", "n string")
    assert {r.n for r in got.collect()} == expected
    if expected:
        found = files.scan_glob(spark, f"file://{tmp_path}", "in", pattern, schema="n string")
        assert {r.n for r in found.collect()} == expected
    else:
        with pytest.raises(FileNotFoundError):
            files.scan_glob(spark, str(tmp_path), "in", pattern)


def test_glob_with_odd_names(spark, tmp_path):
    put(tmp_path / "my in/a b+c.json", '{"n": 1}\n')
    put(tmp_path / "my in/a_b+c.json", '{"n": 2}\n')
    got = files.scan_glob(spark, str(tmp_path), "my in", "a b+*.json", schema="n int")
    assert [r.n for r in got.collect()] == [1]


def test_object_store_options():
    store = ObjectStore("bucket", access_key="k", secret_key="s", endpoint_url="http://minio:9000")
    assert store.root == "s3a://bucket" and "secret" not in repr(store)
    assert store.options()["fs.s3a.path.style.access"] == "true"
    assert ObjectStore("b").options() == {"fs.s3a.endpoint.region": "us-east-1"}


def test_jdbc_options():
    conn = jdbc.JdbcConnection(host="db", port=5432, database="d", username="u", password="p")
    assert conn.jdbc_url() == "jdbc:postgresql://db:5432/d" and "password" not in repr(conn)
    assert jdbc.JdbcConnection("impala", "h", 21050, "d").jdbc_url() == "jdbc:impala://h:21050/d"
    assert jdbc.JdbcConnection(url="postgresql://h/d").jdbc_url() == "jdbc:postgresql://h/d"
    assert jdbc.scan_options(conn, "SELECT 1 ; ")["query"] == "SELECT 1 "
    split = jdbc.scan_options(conn, "SELECT * FROM t", jdbc.Split("id", "0", "100", 8))
    assert split["dbtable"] == "(SELECT * FROM t) src" and split["numPartitions"] == "8" and "query" not in split
    assert jdbc.extract_sql(" a ", "b", "c") == "a" and jdbc.extract_sql(None, "b", "c") == "b"
    assert jdbc.extract_sql(table="c") == "SELECT * FROM c"
    assert jdbc.has_limit("select 1 Limit 5") and not jdbc.has_limit("select limits")
    with pytest.raises(ValueError):
        jdbc.extract_sql()


DIALECTS = ("postgresql", "mysql", "impala", "oracle", "sqlserver")


@pytest.mark.parametrize("dialect", DIALECTS)
def test_filter_and_limit_are_in_the_query(spark, dialect):
    """What the database gets holds predicate and limit for every dialect, whatever Spark pushes by itself."""
    frame = spark.sql("SELECT 1 AS id, DATE'2026-04-16' AS d, TIMESTAMP_NTZ'2026-04-16 10:00:00' AS t, '2026-04-16' AS s")
    sent = []

    def load(query, split):
        sent.append((query, split))
        return frame

    scan = lambda **kw: jdbc.scan_jdbc(spark, jdbc.JdbcConnection(dialect, "h"), table="x", load=load, **kw)
    scan(date_column="d", business_date="20260416", limit=7)
    stop = {"oracle": "SELECT * FROM ({}) src FETCH FIRST 7 ROWS ONLY", "sqlserver": "SELECT TOP 7 * FROM ({}) src"}.get(dialect, "SELECT * FROM ({}) src LIMIT 7")
    assert sent[-1] == (stop.format("SELECT * FROM (SELECT * FROM x) src WHERE d = DATE '2026-04-16'"), None)
    scan(date_column="t", business_date="2026-04-16")
    assert sent[-1][0].endswith("WHERE t >= TIMESTAMP '2026-04-16 00:00:00.000000' AND t < TIMESTAMP '2026-04-17 00:00:00.000000'")
    assert scan(date_column="s", business_date="20260416", limit=1).count() == 1 and sent[-1] == ("SELECT * FROM x", None)  # Spark reads the text
    jdbc.scan_jdbc(spark, jdbc.JdbcConnection(dialect, "h"), sql="SELECT 1 LIMIT 3", limit=9, load=load)
    assert sent[-1][0] == "SELECT 1 LIMIT 3"


def test_names_and_values_in_sql():
    assert [splits.name_sql("a b", d) for d in ("postgresql", "mysql")] == ['"a b"', "`a b`"] and splits.name_sql("ab", "mysql") == "ab"
    assert splits.literal("O'Neil \\", "postgresql") == "'O''Neil \\'" and splits.literal("O'Neil \\", "mysql") == "'O\\'Neil \\\\'"
    assert splits.literal(True, "x") == "TRUE" and splits.literal(1.5, "x") == "1.5"


@pytest.mark.parametrize("kind", ["uneven", "hot", "text", "dates", "all null", "one value", "empty"])
@pytest.mark.parametrize("tie", [None, "tie"])
def test_each_row_is_in_one_split(spark, kind, tie):
    value = {
        "uneven": "cast(pow(id, 4) % 100003 as long)", "hot": "if(id % 3 = 0, 7, id)", "text": "concat('k\\'\\\\', id % 50)",
        "dates": "date_add(date'2026-01-01', cast(sqrt(id) as int))", "all null": "cast(null as int)", "one value": "5", "empty": "id",
    }[kind]
    rows = spark.range(0 if kind == "empty" else 3000).selectExpr("id", f"if(id % 11 = 0, null, {value}) AS k", "if(id % 7 = 0, null, id % 100) AS tie")
    rows.createOrReplaceTempView("split_source")
    found = splits.plan_splits(lambda q: spark.sql(q).collect(), "SELECT * FROM split_source", "k", 8, "spark", tie)
    assert len(found) == len(set(found))
    met = spark.table("split_source").select(*[F.coalesce(F.expr(p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(found)]).toPandas()
    assert (met.sum(axis=1) == 1).all()
    if kind in ("uneven", "dates", "text") or kind == "hot" and tie:
        assert met.sum().max() <= 2 * 3000 / 8


@pytest.mark.parametrize("kind", ["uneven", "hot", "text", "words", "dates", "times", "decimals", "floats", "wide floats", "flags", "all null", "one value", "few"])
@pytest.mark.parametrize("n", [1, 7, 40])
def test_tiles_start_where_ntile_starts_them(spark, monkeypatch, kind, n):
    """Counts between pivots find the tiles that a sort of the whole column gives; no window has more than a few rows."""
    value = {
        "uneven": "cast(pow(id, 4) % 100003 as long) - 50000", "hot": "if(id % 3 = 0, 7, id)", "text": "concat('k\\'\\\\', id % 50)",
        "words": "concat_ws('', element_at(array('Zü', 'zu', '', 'a b', '日本', 'A'), cast(1 + id % 6 as int)), id * 37 % 211)",
        "dates": "date_add(date'2026-01-01', cast(sqrt(id) as int))", "times": "timestamp_micros(id * id * 1234567)",
        "decimals": "cast(id * id as decimal(38, 20)) / 1000000000", "floats": "sin(id) * id", "flags": "id % 5 = 0",
        "wide floats": "case when id % 50 = 0 then double('NaN') when id % 50 = 1 then double('-Infinity') when id % 50 = 2 then double('Infinity') else exp(id / 5) end",
        "all null": "cast(null as int)", "one value": "5", "few": "if(id < 3, id, null)",
    }[kind]
    monkeypatch.setattr(splits, "SORTED", 30)
    monkeypatch.setattr(splits, "PIVOTS", 12)
    spark.range(1500).selectExpr(f"if(id % 11 = 5, null, {value}) AS k").createOrReplaceTempView("tile_source")
    rows = spark.sql(f"SELECT MIN(k) AS lo FROM (SELECT k, NTILE({n}) OVER (ORDER BY k) AS t FROM tile_source WHERE k IS NOT NULL) GROUP BY t ORDER BY t")
    asked = []

    def ask(text):
        asked.append(text)
        return spark.sql(text).collect()

    got = splits.starts_of_tiles(ask, "SELECT * FROM tile_source ; ", "k", n, "spark")
    assert list(map(str, got)) == [str(r.lo) for r in rows.collect()]
    assert len(asked) < 40 and not any("NTILE" in x for x in asked)
    for x in asked:
        if "ROW_NUMBER" in x:
            cut = x[x.index("(SELECT k, CASE") if "(SELECT k, CASE" in x else x.index("(SELECT k, 0 AS t") : x.index(") cut")] + ")"
            assert spark.sql(f"SELECT COUNT(*) AS n FROM {cut} GROUP BY t ORDER BY n DESC").first().n <= 30


def test_a_source_with_an_order_of_its_own(monkeypatch):
    """A source that ignores case, and orders the signs in another way than Python does, still gives its own tiles."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(splits, "SORTED", 10)
    monkeypatch.setattr(splits, "PIVOTS", 8)
    db = duckdb.connect()
    db.sql("CREATE TABLE words AS SELECT (CASE i % 3 WHEN 0 THEN 'Ab' WHEN 1 THEN 'aB' ELSE '_z' END || CASE WHEN i % 2 = 0 THEN 'X' ELSE 'x' END || (i * 7 % 23)) COLLATE NOCASE AS k FROM range(600) t(i)")
    ask = lambda text: [dict(zip((d[0] for d in c.description), r, strict=True)) for c in [db.execute(text)] for r in c.fetchall()]
    got = splits.starts_of_tiles(ask, "SELECT k COLLATE NOCASE AS k FROM words", "k", 9, "postgresql")
    rows = ask("SELECT t, MIN(lower(k)) AS lo FROM (SELECT k, NTILE(9) OVER (ORDER BY k) AS t FROM words) x GROUP BY t ORDER BY t")
    assert [x.lower() for x in got] == [r["lo"] for r in rows]


def test_a_scan_by_quantiles(spark):
    spark.range(1000).selectExpr("id * id AS k").createOrReplaceTempView("squares")
    seen = []

    def load(query, split):
        seen.append(split)
        parts = [spark.sql(splits.derived(query, p, dialect="spark")) for p in split or ["1 = 1"]]
        return parts[0] if len(parts) == 1 else functools.reduce(DataFrame.union, parts)

    df = jdbc.scan_jdbc(spark, jdbc.JdbcConnection("spark"), table="squares", split=jdbc.QuantileSplit("k", 4), load=load)
    assert len(seen[-1]) == 5 and df.count() == df.distinct().count() == 1000


def test_date_filter_and_limit(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT id, date_add(date'2026-04-14', cast(id AS int)) AS d FROM range(5)").write.parquet(path)
    df = files.business_date_filter(spark.read.parquet(path), "d", "2026/04/16")
    assert [r.id for r in df.collect()] == [2]
    assert "EqualTo(d,2026-04-16)" in df._jdf.queryExecution().executedPlan().toString()
    assert files.row_limit(df, None).count() == 1 and files.row_limit(spark.range(9), 4).count() == 4


# ---- sinks


def test_modes(spark, db):
    one, two = spark.range(1), spark.range(5, 7)
    save = lambda df, mode: tables.write_table(df, db, "t", mode)["rows_loaded"]
    ids = lambda: sorted(r.id for r in spark.table(f"{db}.t").collect())
    assert save(one, "error") == 1 and ids() == [0]
    with pytest.raises(AnalysisException):
        save(two, "error")
    assert save(two, "ignore") == 0 and ids() == [0]
    assert save(two, "append") == 2 and ids() == [0, 5, 6]
    assert save(one, "overwrite") == 1 and ids() == [0]
    with pytest.raises(ValueError):
        save(one, "upsert")
    with pytest.raises(ValueError):
        tables.write_table(one, "", "t")


def test_table_can_replace_itself(spark, db):
    tables.write_table(spark.range(5), db, "t")
    done = tables.replace_table(spark.table(f"{db}.t").where("id > 2"), db, "t")
    assert done == {"table": f"`{db}`.`t`", "rows_loaded": 2}
    assert sorted(r.id for r in spark.table(f"{db}.t").collect()) == [3, 4]
    assert tables.write_table(spark.table(f"{db}.t").where("id > 3"), db, "t")["rows_loaded"] == 1
    assert [r.id for r in spark.table(f"{db}.t").collect()] == [4]
    assert [t.name for t in spark.catalog.listTables(db) if not t.isTemporary] == ["t"]


def test_records(spark, db):
    assert tables.write_records(spark, [], db, "t")["rows_loaded"] == 0
    assert not spark.catalog.tableExists(f"{db}.t")
    tables.write_records(spark, [(1, "a")], db, "t", schema="id int, s string")
    tables.write_records(spark, spark.createDataFrame([(2, "b")], "id int, s string"), db, "t")
    assert spark.table(f"{db}.t").count() == 2


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.sql("SELECT id, id % 3 AS d FROM range(30)")
    assert sink.write_parquet(first, path, partition_by=["d"]) == 30
    sink.write_parquet(first.where("d = 1").limit(2), path, partition_by=["d"])
    got = {r.d: r["count"] for r in spark.read.parquet(path).groupBy("d").count().collect()}
    assert got == {0: 10, 1: 2, 2: 10}


def test_partitioned_write_makes_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.write_parquet(spark.range(0, 10_000, 1, 16).selectExpr("id", "id % 4 AS d"), path, partition_by=["d"])
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 8


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None), (3, "")], "id int, s string")
    assert sink.write_csv(df, path) == 3
    assert sorted((tuple(r) for r in files.scan_csv(spark, path, schema="id int, s string").collect()), key=str) == sorted(
        [(1, 'a "q", b'), (2, None), (3, None)], key=str
    )


def test_extract_report(spark, tmp_path):
    got = sink.extract_to_parquet(spark.range(0, 25, 1, 1), str(tmp_path / "x"), 10)
    assert (got["total_rows"], got["file_count"]) == (25, 3)
    assert got["schema"] == [{"name": "id", "type": "bigint", "nullable": False}]
    assert spark.read.parquet(str(tmp_path / "x")).count() == 25
    assert sink.saved_schema(spark, str(tmp_path / "x")) == spark.range(1).schema


def test_export_is_one_capped_file(spark, tmp_path):
    assert sink.export_csv(spark.range(0, 100, 1, 8), str(tmp_path / "x"), 30, ["id"]) == 30
    assert len(list((tmp_path / "x").glob("*.csv"))) == 1
    assert sink.export_csv(spark.range(1000), str(tmp_path / "y")) == 1000


# ---- layout


def test_layout_paths():
    plain = layout.Layout("/data/")
    assert plain.dataset("20260416", "my pipe", "pos.v1", "app 1") == "/data/20260416/MY_PIPE/POS_V1/APP_1"
    assert plain.dataset("20260416", None, "x") == "/data/20260416/PIPELINE/X"
    fixed = layout.Layout("/data", output_dir="a/b", path_template="ignored")
    assert fixed.dataset("20260416", "p", "x") == "/data/a/b/20260416/P/X"
    made = layout.Layout("/data", path_template="{pipeline_name}/{app_id}/{business_date}")
    assert made.dataset("20260416", "p", "x") == "/data/P/20260416"


def test_listing_views_and_merge(spark, tmp_path, db):
    root = str(tmp_path)
    place = layout.Layout(root)
    sink.write_parquet(spark.range(3), place.dataset("20260416", "p", "x", "a1"))
    sink.write_csv(spark.range(4), place.dataset("20260416", "p", "x", "a1"), "append")
    sink.write_csv(spark.range(5), place.dataset("20260417", "p", "y"))
    listed = {r.name: r.format for r in layout.list_datasets(spark, root).collect()}
    assert listed == {"20260416/P/X/A1": "parquet", "20260417/P/Y": "csv"}
    names = layout.register_views(spark, root, suppress={"20260417__p_y_"})
    assert names == {"20260416__p_x_a1"} and spark.table("20260416__p_x_a1").count() == 3
    spark.range(1).createOrReplaceTempView("gone_view")
    assert layout.register_views(spark, root, known={"gone_view"}) == {"20260416__p_x_a1", "20260417__p_y_"}
    assert not spark.catalog.tableExists("gone_view") and spark.table("20260417__p_y_").count() == 5
    tables.merge_segments(spark, place.dataset("20260417", "p", "y"), db, "y", view="20260417__p_y_")
    assert spark.table(f"{db}.y").count() == 5 and not spark.catalog.tableExists("20260417__p_y_")


def test_listing_where_the_root_name_comes_again(spark, tmp_path):
    root = str(tmp_path / "data")
    sink.write_parquet(spark.range(2), f"{root}/20260416/P/X_data/data")
    assert [r.name for r in layout.list_datasets(spark, root).collect()] == ["20260416/P/X_data/data"]


def test_apps_differ_in_columns(spark, tmp_path, db):
    place = layout.Layout(str(tmp_path))
    base = place.dataset("20260416", "p", "x")
    sink.write_parquet(spark.sql("SELECT 1L AS a, 'r' AS b"), base)
    sink.write_parquet(spark.sql("SELECT 2L AS a, 2.5D AS c"), f"{base}/APP_1/X/deeper")
    tables.load_apps(spark, base, db, "t")
    got = sorted((tuple(r) for r in spark.table(f"{db}.t").select("a", "b", "c", "application_id").collect()))
    assert got == [(1, "r", None, None), (2, None, 2.5, "APP_1")]
    tables.load_apps(spark, base, db, "u", apps=["APP_1"])
    assert [tuple(r) for r in spark.table(f"{db}.u").collect()] == [(2, 2.5, "APP_1")]


def test_preview(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 4).write.parquet(path)
    page, facts = layout.preview_dataset(spark, path, 10, 95)
    assert [r.id for r in page.collect()] == [95, 96, 97, 98, 99]
    assert facts == {"row_count": 5, "total_rows": 100, "truncated": False, "file_count": 4, "format": "parquet"}
    page, facts = layout.preview_dataset(spark, path, 30, 20)
    assert [r.id for r in page.collect()] == list(range(20, 50))
    assert facts["truncated"] and facts["row_count"] == 30
    page, facts = layout.preview_dataset(spark, path, 5000, 0)
    assert page.count() == 100 and not facts["truncated"]
    page, facts = layout.preview_dataset(spark, path, 10, 100)
    assert page.columns == ["id"] and page.count() == facts["row_count"] == 0
    spark.range(0).write.parquet(empty := str(tmp_path / "empty"))
    page, facts = layout.preview_dataset(spark, empty)
    assert page.count() == facts["total_rows"] == facts["file_count"] == 0


def test_ingest(spark, tmp_path, db):
    put(tmp_path / "in/a.csv", "k,v\na,1\nb,2\n")
    put(tmp_path / "in/b.csv", "k,v\na,5\n")
    put(tmp_path / "in/c.txt", "nothing\n")
    sql = "SELECT k, sum(v) AS total FROM {source} GROUP BY k"
    done = ingest_files(spark, str(tmp_path), db, "t", prefix="in", pattern="*.csv", transform_sql=sql)
    assert done["rows_loaded"] == 2
    assert {r.k: r.total for r in spark.table(f"{db}.t").collect()} == {"a": 6, "b": 2}
    with pytest.raises(FileNotFoundError):
        ingest_files(spark, str(tmp_path), db, "t", prefix="in", pattern="*.orc")


def test_patterns_compile():
    for glob in ("a[!b]c", "[", "x{1}y", "a.b*"):
        for name in ("abc", "axc", "[", "x{1}y", "a.bzz", "aXbzz"):
            assert bool(re.fullmatch(files._pattern(glob), name, re.S)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_counted_rows(spark):
    frame, seen = sink.counted(spark.range(7))
    frame.agg(F.sum("id")).collect()
    assert seen.get["rows"] == 7
