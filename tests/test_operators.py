"""Transforms on small tables, most of them against plain Python or pandas."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from millrace.operators import columns, dictionary, grid, join, order, paging
from millrace.operators import aggregate as aggregates
from millrace.operators.aggregate import aggregate
from millrace.operators.combine import union_by_name
from millrace.operators.dedup import dedup
from millrace.sinks import files

SAMPLE = [(1, "Alice", "eng", 90), (2, "Bob", "eng", 85), (3, "Carol", "hr", 92), (2, "Bob", "eng", 85)]


@pytest.fixture
def sample(rows):
    return rows(SAMPLE, "id int, name string, dept string, score int")


def values(df, *order_by):
    return [tuple(r) for r in (df.orderBy(*order_by) if order_by else df).collect()]


# ---- drop, rename, filter, dedup


def test_drop_and_rename(sample):
    assert sample.transform(columns.drop_columns(["score", "zz"])).columns == ["id", "name", "dept"]
    assert sample.transform(columns.rename_columns({"name": "who", "zz": "y"})).columns == ["id", "who", "dept", "score"]


def test_chain_filters_after_renaming(sample):
    out = sample.transform(columns.basic_chain(["score"], {"dept": "d"}, {"d": "eng"}, ["id"]))
    assert values(out, "id") == [(1, "Alice", "eng"), (2, "Bob", "eng")]
    assert sample.transform(columns.basic_chain()).count() == 4
    assert sample.transform(columns.basic_chain(filters={"dept": "eng", "id": 2})).count() == 2
    assert sample.transform(columns.basic_chain(filters={"dept": "ops"})).count() == 0


def test_dedup(rows):
    df = rows([(1, 2, "x"), (1, 2, "y"), (1, 3, "z"), (None, 1, "p"), (None, 1, "q")], "a int, b int, c string")
    assert values(df.transform(dedup(["a", "b"], ["c"])), "c") == [(None, 1, "p"), (1, 2, "x"), (1, 3, "z")]
    assert values(df.transform(dedup(["a", "b"], [F.desc("c")])), "c") == [(None, 1, "q"), (1, 2, "y"), (1, 3, "z")]
    assert df.transform(dedup(["zz"])).count() == 5
    assert df.transform(dedup(["b", "zz"], ["c"])).count() == 3


def test_dedup_keeps_the_first_row_of_a_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 1).selectExpr("id % 10 AS k", "1000 - id AS v").write.parquet(path)
    out = spark.read.parquet(path).transform(dedup(["k"]))
    assert values(out, "k") == [(k, 1000 - k) for k in range(10)]


def test_dedup_cuts_hot_keys_before_the_shuffle(spark):
    plan = spark.range(100).selectExpr("id % 3 AS k", "id").transform(dedup(["k"], ["id"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and text.rindex("WindowGroupLimit") > text.index("Exchange")


# ---- conform


TARGET = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])


def test_conform_and_split(rows):
    df = rows([("1", "2.5"), ("x", "1"), (None, "zz"), ("y", "z")], "a string, b string")
    assert sorted(values(df.transform(columns.conform(TARGET))), key=str) == sorted(
        [(1, 2.5, None), (None, 1.0, None), (None, None, None), (None, None, None)], key=str
    )
    assert dict(values(columns.conform_report(df, TARGET))) == {"a": 2, "b": 2}
    good, bad = columns.split_valid(df, TARGET)
    assert values(good) == [(1, 2.5, None)] and good.schema == TARGET
    assert sorted(values(bad), key=str) == sorted(
        [("x", "1", ["a"]), (None, "zz", ["b"]), ("y", "z", ["a", "b"])], key=str
    )
    kept = columns.schema_descriptor(TARGET)
    assert kept[0] == {"name": "a", "type": "int", "nullable": True}
    assert columns.schema_from_descriptor(kept) == TARGET


# ---- aggregate


def test_global_aggregate_reads_text_as_numbers(rows):
    df = rows([("1", "a"), ("x", None), ("2.5", "c"), (None, "d")], "n string, s string")
    specs = [{"column": "n", "function": f, "alias": f} for f in ("sum", "avg", "mean", "count", "min", "max")]
    out = df.transform(aggregate([], specs + [{"column": "zz"}, {"column": "s", "function": "first", "alias": "f"}]))
    assert values(out) == [(3.5, 1.75, 1.75, 3, 1.0, 2.5, "a")]


def test_aggregate_of_nothing(rows):
    empty = rows([], "k string, n double")
    for keys in ([], ["k"]):
        assert empty.transform(aggregate(keys, [{"column": "n"}])).count() == 0
    nulls = rows([("a", None), ("a", None)], "k string, n double")
    assert values(nulls.transform(aggregate([], [{"column": "n"}]))) == [(0.0,)]
    specs = [{"column": "n", "function": f, "alias": f} for f in ("median", "sum")]
    assert values(nulls.transform(aggregate(["k"], specs)).select("sum", "median")) == [(0.0, None)]
    assert nulls.transform(aggregate(["k"], [])).count() == 2


def test_global_mix(rows):
    specs = [{"column": "n", "function": f, "alias": f} for f in ("nunique", "sum", "median", "size")]
    df = rows([("a", 1.0), ("b", 1.0), ("c", 4.0), ("c", None)], "k string, n double")
    assert values(df.transform(aggregate([], specs))) == [(2, 6.0, 1.0, 4)]
    assert values(df.transform(aggregate([], specs[:1]))) == [(2,)]
    assert values(df.transform(aggregate([], specs[:2]))) == [(2, 6.0)]
    for some in (specs, specs[:1], specs[:2], specs[2:3]):
        assert df.limit(0).transform(aggregate([], some)).count() == 0


def test_grouping_drops_null_keys_and_keeps_every_measure(rows):
    df = rows([("a", 1), ("a", 2), (None, 9), ("b", None)], "k string, v int")
    specs = [{"column": "v", "function": f, "alias": f"v_{f}"} for f in ("sum", "average", "count", "nunique", "size")]
    assert values(df.transform(aggregate(["k", "zz"], specs)), "k") == [("a", 3, 1.5, 2, 2, 2), ("b", 0, None, 0, 0, 1)]
    same = [{"column": "v", "function": "min"}, {"column": "v", "function": "max"}]
    assert df.transform(aggregate(["k"], same)).columns == ["k", "v", "v_max"]


def test_bad_aggregates_are_refused(sample):
    for keys, specs in [
        (["zz"], [{"column": "score"}]),
        ([], [{"column": "zz"}]),
        (["dept"], [{"column": "score", "function": "mode"}]),
    ]:
        with pytest.raises(ValueError):
            sample.transform(aggregate(keys, specs))


def test_first_skips_null_in_groups_only(rows):
    df = rows([(1, "a", None), (2, "a", "x"), (3, "a", "y")], "i int, k string, v string")
    first, last = ({"column": "v", "function": f, "alias": f} for f in ("first", "last"))
    assert values(df.transform(aggregate(["k"], [first, last], ["i"]))) == [("a", "x", "y")]
    assert values(df.transform(aggregate([], [first], ["i"]))) == [(None,)]
    assert values(df.transform(aggregate([], [first], [-F.col("i")]))) == [("y",)]


def test_group_functions_match_pandas(spark):
    rng = random.Random(5)
    data = [(rng.choice("abcd"), rng.choice([None, 0.0, 1.5, 2.0, 7.25, rng.random()])) for _ in range(400)]
    data += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("flat", 4.0), ("flat", 4.0), ("flat", 4.0)]
    fns = ["sum", "mean", "count", "min", "max", "median", "std", "var", "nunique", "size", "prod", "sem", "skew", "any", "all"]
    df = spark.createDataFrame(data, "k string, v double")
    ours = df.transform(aggregate(["k"], [{"column": "v", "function": f, "alias": f} for f in fns])).toPandas()
    theirs = pd.DataFrame(data, columns=["k", "v"]).groupby("k")["v"].agg(fns).reset_index()
    merged = ours.sort_values("k").reset_index(drop=True)
    for f in fns:
        for k, a, b in zip(theirs["k"], merged[f], theirs[f]):
            if f in ("any", "all"):
                b = bool(pd.Series([v for g, v in data if g == k and v is not None]).agg(f))
            same = (pd.isna(a) and pd.isna(b)) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
            assert same, (f, k, a, b)


def test_median_of_a_hot_group(spark):
    """Two thirds of the rows in one group, many of them equal, others all distinct."""
    df = spark.range(0, 90_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, id % 50, -1) AS k", "IF(id % 5 = 0, 0.0, cast(hash(id) AS double)) AS v"
    )
    median = [{"column": "v", "function": "median", "alias": "m"}]
    pdf = df.toPandas()
    assert dict(values(df.transform(aggregate(["k"], median)))) == pdf.groupby("k")["v"].median().to_dict()
    assert df.transform(aggregate([], median)).first()["m"] == pdf["v"].median()


def test_medians_need_three_scans_at_most(spark, tmp_path, monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 3000), "v": rng.normal(size=3000).round(2), "w": rng.integers(0, 3, 3000)})
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/t")
    written = []
    monkeypatch.setattr(files, "scratch_path", lambda *a: written.append(1) or f"{tmp_path}/scratch{len(written)}")
    specs = [{"column": c, "function": f, "alias": f"{f}_{c}"} for c, f in (("v", "median"), ("w", "median"), ("v", "max"))]
    got = spark.read.parquet(f"{tmp_path}/t").transform(aggregate(["k"], specs))

    def scanned(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("Relation [k#" in line for line in plan.split("\n"))

    scans = scanned(got)
    assert scans == 0  # groups of this size need one pass
    monkeypatch.setattr(aggregates, "ACCURACY", 1000)
    got = spark.read.parquet(f"{tmp_path}/t").transform(aggregate(["k"], specs))
    assert len(written) == 4 and 1 <= scanned(got) <= 2  # one more built what was written
    expected = pdf.groupby("k").agg({"v": "median", "w": "median"})
    assert {r["k"]: (r["median_v"], r["median_w"]) for r in got.collect()} == {k: (r.v, r.w) for k, r in expected.iterrows()}


def test_medians_between_rough_bounds(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(aggregates, "ACCURACY", 20)
    monkeypatch.setattr(aggregates, "PARTS", 3)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 40, 6000) ** 2 // 100, "v": np.round(rng.lognormal(0, 3, 6000), 1) - 1})
    pdf.loc[::50, "v"] = np.inf
    pdf.loc[::70, "v"] = -np.inf
    median = [{"column": "v", "function": "median", "alias": "m"}]
    got = dict(values(spark.createDataFrame(pdf).repartition(7).transform(aggregate(["k"], median))))
    assert got == {k: sorted(g)[(len(g) - 1) // 2] / 2 + sorted(g)[len(g) // 2] / 2 for k, g in ((k, list(g)) for k, g in pdf.groupby("k")["v"])}
    empty = spark.createDataFrame(pdf).where("false").transform(aggregate([], median))
    assert empty.count() == 0
    odd = spark.createDataFrame([(1, None), (1, None)], "`a b` int, v double").selectExpr("`a b`", "`a b` as `A,B`", "v", "null as nothing")
    first = odd.transform(aggregate(["a b"], [*median, {"column": "nothing", "function": "first", "alias": "V"}]))
    assert values(first) == [(1, None, None)]


def test_nan_text_and_truth_in_aggregates(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, "x", True), ("a", nan, "b", False), ("a", None, None, True), ("b", nan, "10", None)], "k string, v double, t string, f boolean")
    specs = [{"column": c, "function": f, "alias": f"{f}_{c}"} for c, f in (("v", "sum"), ("v", "avg"), ("v", "max"), ("v", "count"), ("v", "median"), ("t", "min"), ("t", "max"), ("f", "sum"))]
    got = {r["k"]: r.asDict() for r in df.transform(aggregate(["k"], specs)).collect()}
    assert got["a"] == {"k": "a", "sum_v": 1.0, "avg_v": 1.0, "max_v": 1.0, "count_v": 1, "median_v": 1.0, "min_t": "b", "max_t": "x", "sum_f": 2}
    assert (got["b"]["avg_v"], got["b"]["count_v"], got["b"]["median_v"], got["b"]["max_t"]) == (None, 0, None, "10")


# ---- joins


LEFT = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (5, "e")]
RIGHT = [(1, "x"), (3, "y"), (1, "z"), (None, "w"), (2, "v")]


def brute_join(kind):
    pairs = [(lk, lv, rk, rv) for lk, lv in LEFT for rk, rv in RIGHT if lk is not None and lk == rk]
    if kind in ("left", "full"):
        pairs += [(lk, lv, None, None) for lk, lv in LEFT if lk not in [r for r, _ in RIGHT if r is not None]]
    if kind in ("right", "full"):
        pairs += [(None, None, rk, rv) for rk, rv in RIGHT if rk not in [k for k, _ in LEFT if k is not None]]
    return sorted(pairs, key=str)


@pytest.mark.parametrize("hot", [True, False], ids=["split", "plain"])
@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
def test_joins(rows, kind, hot):
    left, right = rows(LEFT, "k int, v string"), rows(RIGHT, "id int, v string")
    out = left.transform(join.join_tables(right, [{"left": "k", "right": "id"}], kind, hot_keys=hot))
    assert out.columns == ["k", "v", "id", "right_v"]
    assert sorted(values(out), key=str) == brute_join(kind)


def test_join_names_stay_unique(rows):
    left, right = rows([(1, 2)], "k int, right_k int"), rows([(1, 3)], "k int, right_right_k int")
    out = left.transform(join.join_tables(right, [{"left": "k", "right": "k"}]))
    assert out.columns == ["k", "right_k", "right_right_k", "right_right_right_k"]


def skewed(spark):
    """Settings under which a small table already counts as skewed."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    return before


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_keys_are_split(spark):
    before = skewed(spark)
    try:
        hot = spark.range(0, 300_000, 1, 16).selectExpr("IF(id % 3 = 0, 7, id % 50000) AS k", "id AS v", "uuid() AS pad")
        one = spark.range(0, 60_000, 1, 8).selectExpr("id AS k2", "id * 2 AS w")
        there, back = [{"left": "k", "right": "k2"}], [{"left": "k2", "right": "k"}]
        kept = hot.transform(join.join_tables(one, there, "left", hot_keys=True))
        plan = final_plan(kept)
        assert plan.count("skew=true") == 2 and "ReusedExchange" in plan
        assert kept.count() == 300_000
        missing = one.transform(join.join_tables(hot, back, "left", hot_keys=True))
        assert "SortMergeJoin(skew=true)" in final_plan(missing)
        entries = one.selectExpr("string(k2) AS key", "string(w) AS value", "k2 AS position")
        assert "SortMergeJoin(skew=true)" in final_plan(hot.transform(join.lookup(entries, "k", "w")))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_lookup(rows):
    entries = rows([("1", "one", 0), ("1", "uno", 9), ("None", "nil", 1), ("3", None, 2), ("5.0", "five", 3)],
                   "key string, value string, position int")
    df = rows([(1, 5.0), (2, 1.0), (None, None), (3, 5.5)], "k int, d double")
    out = df.transform(join.lookup(entries, "k", "name", "?", "hit"))
    assert sorted(values(out.select("k", "name", "hit")), key=str) == sorted(
        [(1, "uno", True), (2, "?", False), (None, "nil", True), (3, "?", False)], key=str
    )
    over = df.transform(join.lookup(entries, "d", "k"))
    assert over.columns == ["k", "d"] and sorted(r.k for r in over.collect()) == ["", "", "five", "nil"]
    assert {r.x for r in df.transform(join.lookup(entries, "zz", "x", "none")).collect()} == {"none"}
    with pytest.raises(ValueError):
        join.lookup(entries, "", "x")



# ---- order


def python_sort(data, specs):
    for index, desc in reversed(specs):
        def key(row, index=index):
            v = row[index]
            if v is None:
                return (1, 0, 0.0, "")
            try:
                return (0, 0, float(v), "")
            except ValueError:
                return (0, 1, 0.0, str(v).lower())
        data = sorted(data, key=key, reverse=desc)
    return data


@pytest.mark.parametrize("desc", [False, True])
def test_sort_is_stable_and_mixes_types(spark, desc):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "10", "9", "b", "A", "a", "1e1", ""]), rng.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(data, "i int, s string, n int").coalesce(1)
    specs = [{"column": "n"}, {"column": "zz"}, {"column": "s", "direction": "desc" if desc else "asc"}]
    assert values(df.transform(order.sort_rows(specs))) == python_sort(data, [(2, False), (1, desc)])
    assert df.transform(order.sort_rows([])).count() == 300


def test_number_rows_over_many_partitions_and_ties(spark):
    df = spark.range(0, 20_000, 1, 16).selectExpr("id", "IF(id % 3 = 0, 0, hash(id) % 100) AS k")
    got = order.number_rows(df, [F.col("k").desc()], "n").toPandas().sort_values("n")
    assert list(got["n"]) == list(range(1, 20_001))
    assert got["k"].is_monotonic_decreasing and sorted(got["id"]) == list(range(20_000))
    assert order.number_rows(df.limit(0), ["k"]).count() == 0


def test_segments_in_reading_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 2500, 1, 1).write.parquet(path)
    sizes = order.segments(spark.read.parquet(path), 1000).groupBy("segment").agg(F.count("*"), F.min("id"))
    assert values(sizes, "segment") == [(0, 1000, 0), (1, 1000, 1000), (2, 500, 2000)]


def test_natural_sort(rows):
    df = rows([("f10",), ("f9",), (None,), ("F2",), ("100",), ("20",)], "s string")
    assert [r.s for r in df.transform(grid.sort_natural("s")).collect()] == ["20", "100", "F2", "f9", "f10", None]
    assert [r.s for r in df.transform(grid.sort_natural("s", "desc")).collect()][-1] is None
    several = rows([("a10b2",), ("a2b10",), ("a02b9",), ("a2",), ("ab",), ("",), ("a" + "9" * 50,)], "s string")
    got = [r.s for r in several.transform(grid.sort_natural("s")).collect()]
    assert got == ["", "a2", "a02b9", "a2b10", "a10b2", "a" + "9" * 50, "ab"]


# ---- grid, dictionary, pages


def test_search_and_column_filters(rows):
    df = rows([(1, "Alpha", None), (21, None, 2.0), (3, "beta", 1.5)], "i int, s string, d double")
    assert [r.i for r in df.transform(grid.search("AL")).collect()] == [1]
    assert sorted(r.i for r in df.transform(grid.search("2")).collect()) == [21]
    assert df.transform(grid.search("null")).count() == 0 and df.transform(grid.search("")).count() == 3
    assert [r.i for r in df.transform(grid.column_filters({"s": "NUL", "i": "1"})).collect()] == [21]
    assert df.transform(grid.column_filters({"s": ""})).count() == 3


def test_transpose(rows):
    df = rows([(2, "b"), (1, None), (3, "c")], "id int, name string")
    out = grid.transpose(df, ["id"], 2)
    assert values(out, "ordinal") == [(0, "id", "1", "2"), (1, "name", None, "b")]
    assert values(grid.transpose(df, ["id"], 2, "NAM")) == [(1, "name", None, "b")]
    assert values(grid.transpose(df, ["id"], 2, row_filters={1: "nul", 2: "B"})) == [(1, "name", None, "b")]
    with pytest.raises(ValueError):
        grid.transpose(df, ["id"], 0)


@pytest.fixture
def entries(rows):
    return rows(
        [("k1", "Alpha", {"region": "EU"}, 1), ("k2", "beta", {"region": " "}, 2), ("k1", "Gamma", {"region": "EU"}, 3),
         ("k3", "delta", None, 4)],
        "key string, value string, extra map<string,string>, position int",
    )


def test_dictionary(entries):
    assert [r.value for r in dictionary.entry_filter(entries, "K1", "a", {"region": "EU"}).orderBy("position").collect()] == ["Alpha", "Gamma"]
    assert values(dictionary.facets(entries, ["region", "zz"])) == [("region", "EU")]
    picked = dictionary.iterator_entries(entries, ["k3", "k1", "zz"])
    assert values(picked.select("iteration", "value"), "iteration") == [(1, "delta"), (2, "Gamma")]
    some = dictionary.iterator_entries(entries, None, [{"column": "region", "value": "EU"}, {"column": "", "value": "x"}])
    assert values(some.select("iteration", "value"), "iteration") == [(1, "Alpha"), (3, "Gamma")]
    assert [r.value for r in dictionary.sort_case_insensitive(entries, "value", "desc").collect()] == ["Gamma", "delta", "beta", "Alpha"]


def test_pages(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    got = paging.fetch(df, 3, 2, [F.desc("n")])
    assert got["rows"] == [[7], [6], [5]] and got["truncated"] and got["row_count"] == 3
    assert not paging.fetch(df, 10)["truncated"] and paging.fetch(df, 9)["truncated"]
    assert paging.fetch_bulk(df, 4)["truncated"]
    flags = lambda n: {r.truncated for r in paging.bulk(df, n, ["n"]).collect()}
    assert flags(10) == {False} and flags(9) == {True} and paging.bulk(df, 9, ["n"]).count() == 9
    assert [r.n for r in paging.tail(df, 3, ["n"]).collect()] == [7, 8, 9]
    with pytest.raises(ValueError):
        paging.page(df, 0)


def test_union_by_name(rows):
    a, b = rows([(1, "x")], "a int, b string"), rows([("y", 2.0)], "b string, c double")
    assert sorted(values(union_by_name(a, b)), key=str) == sorted([(1, "x", None), (None, "y", 2.0)], key=str)
