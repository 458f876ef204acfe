"""Text and number rules against a plain Python model of them."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from millrace.functions import coerce
from millrace.operators.predicates import condition, equals_text, filter_equal, filter_rows

DOUBLES = [
    None, 0.0, -0.0, 1.0, 5.0, -5.5, 0.1, 123456.789, 1e7, 12345678.25, 1e15, 123456789012345.6, 1e16, 1.5e16, 2.5e300,
    0.001, 0.0001, 0.00012, 1e-5, 1.25e-7, -3e-10, 1e100, float("inf"), float("-inf"), float("nan"),
]
TEXTS = [None, "", "None", "nan", "abc", " 12 ", "12", "1e3", "1_000", "1d", "2f", "-3.5", "inf", "-Infinity", ".5", "5.",
         "true", "Größe", "a,b", "50%", "x_y", "٣"]
INTS = [None, 0, 5, -5, 12, 2**31 - 1, -(2**31), 1000]
LONGS = [None, 0, 5, 2**53 + 1, -(2**63), 2**63 - 1]
DATES = [None, dt.date(2026, 4, 16), dt.date(1999, 12, 31)]
TIMES = [None, dt.datetime(2026, 4, 16), dt.datetime(2026, 4, 16, 1, 2, 3), dt.datetime(2026, 4, 16, 1, 2, 3, 4500)]
BOOLS = [None, True, False]

COLUMNS = [
    (T.DoubleType(), DOUBLES), (T.StringType(), TEXTS), (T.IntegerType(), INTS), (T.LongType(), LONGS),
    (T.DateType(), DATES), (T.TimestampNTZType(), TIMES), (T.BooleanType(), BOOLS),
]
IDS = [t.simpleString() for t, _ in COLUMNS]

VALUES = ["", "5", "5.0", "-5.5", "0.0", "0", "1e+16", "1e16", "12", " 12 ", "None", "nan", "inf", "abc", "True", "true",
          "2026-04-16", "2026-04-16 00:00:00", "2026-04-16 01:02:03.004500", "9007199254740993", "a,b", "5,12, abc",
          "99999999999999999999", "4.5", "1000", "%B%", "x_y", "50%", "0.0001", "1e-05"]
OPERATORS = ["=", "!=", ">", "<", ">=", "<=", "LIKE", "IN", "IS NULL", "~"]


def column(spark, dtype, values):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("c", dtype)])
    return spark.createDataFrame(list(enumerate(values)), schema)


@pytest.mark.parametrize("dtype,values", COLUMNS, ids=IDS)
def test_cell_text_is_python_str(spark, dtype, values):
    df = column(spark, dtype, values)
    got = [r[0] for r in df.orderBy("i").select(coerce.cell_text(F.col("c"), dtype)).collect()]
    assert got == [None if v is None else str(v) for v in values]


def as_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def holds(op: str, cell, value: str) -> bool:
    """The rule in plain Python."""
    text = "" if cell is None else str(cell)
    if op in (">", "<", ">=", "<="):
        a, b = as_float(text), as_float(value)
        if a is None or b is None:
            return False
        if isinstance(cell, int) and not isinstance(cell, bool) and math.isfinite(b):
            a = cell  # integers compare exactly
        return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return {
        "=": text == value,
        "!=": text != value,
        "LIKE": value.replace("%", "").lower() in text.lower(),
        "IN": text in {v.strip() for v in value.split(",")},
        "IS NULL": text == "",
    }.get(op, True)


@pytest.mark.parametrize("dtype,values", COLUMNS, ids=IDS)
def test_conditions_match_the_rule(spark, dtype, values):
    df = column(spark, dtype, values)
    cases = [(op, value) for op in OPERATORS for value in VALUES]
    tests = [F.coalesce(condition(df.schema, "c", op, v), F.lit(False)).alias(f"t{n}") for n, (op, v) in enumerate(cases)]
    got = df.orderBy("i").select(*tests).collect()
    wrong = [
        (op, value, cell, row[n])
        for row, cell in zip(got, values)
        for n, (op, value) in enumerate(cases)
        if row[n] != holds(op, cell, value) and cell != "٣"  # digits of other scripts count as text here
    ]
    assert wrong == []


@pytest.mark.parametrize("dtype,values", COLUMNS, ids=IDS)
def test_plain_equality_reads_null_as_none(spark, dtype, values):
    df = column(spark, dtype, values)
    tests = [F.coalesce(equals_text(df.schema, "c", v), F.lit(False)).alias(f"t{n}") for n, v in enumerate(VALUES)]
    for row, cell in zip(df.orderBy("i").select(*tests).collect(), values):
        assert [row[n] for n in range(len(VALUES))] == [str(cell) == v for v in VALUES]


def test_missing_column(spark, rows):
    df = rows([(1,)], "a int")
    keep = lambda **c: df.transform(filter_rows([{"column": "zz", **c}])).count() == 1
    assert keep(operator="=", value="") and not keep(operator="=", value="1")
    assert not keep(operator="!=", value="") and keep(operator="!=", value="1")
    assert not keep(operator=">", value="0") and keep(operator="IS NULL")
    assert keep(operator="LIKE", value="%") and not keep(operator="LIKE", value="x")
    assert keep(operator="IN", value="a,,b") and not keep(operator="IN", value="a,b")
    assert df.transform(filter_equal({"zz": ""})).count() == 1 and df.transform(filter_equal({"zz": "1"})).count() == 0


def test_logic(spark, rows):
    df = rows([(1, "x"), (2, None), (3, "y")], "a int, b string")
    some = [{"column": "b", "operator": "=", "value": "x"}, {"column": "a", "operator": ">=", "value": 3}]
    assert [r.a for r in df.transform(filter_rows(some, "OR")).orderBy("a").collect()] == [1, 3]
    assert df.transform(filter_rows(some, "AND")).count() == 0
    assert df.transform(filter_rows([], "OR")).count() == 3
    assert df.transform(filter_rows([{"column": "a", "operator": "??", "value": "1"}])).count() == 3


def test_number(spark):
    df = column(spark, T.StringType(), TEXTS)
    got = [r[0] for r in df.orderBy("i").select(coerce.number(F.col("c"), T.StringType())).collect()]
    for text, value in zip(TEXTS, got):
        expected = None if text in (None, "1_000", "٣") else as_float(text)
        assert value == expected or (math.isnan(value) and math.isnan(expected)), text


def test_float_conditions(spark):
    values = [None, 0.1, 0.5, -2.25, 3.4e38, 1e-5, 16777216.0, 0.0, float("nan")]
    df = column(spark, T.FloatType(), values)
    texts = [None, "0.1", "0.5", "-2.25", "3.4e+38", "1e-05", "16777216.0", "0.0", "nan"]
    for value in ["0.1", "0.10", "0.5", "-2.25", "3.4e+38", "1e-05", "16777216.0", "1e400", "0.0", "nan", "x"]:
        got = [r.i for r in df.where(condition(df.schema, "c", "=", value)).orderBy("i").collect()]
        assert got == [i for i, t in enumerate(texts) if t == value], value


def test_decimal_conditions(spark):
    values = [None, *map(Decimal, ("5.00", "5.01", "-0.10", "0.00", "99999999.99", "-5.00", "0.07"))]
    df = column(spark, T.DecimalType(10, 2), values)
    cases = [(op, v) for op in OPERATORS for v in [*VALUES, "5.00", "-0.00", "0.00", "-0.10", "0.07", "999999999.00", "1e300", "-1e308"]]
    tests = [F.coalesce(condition(df.schema, "c", op, v), F.lit(False)).alias(f"t{n}") for n, (op, v) in enumerate(cases)]
    got = df.orderBy("i").select(*tests).collect()
    wrong = [(c, v) for row, v in zip(got, values) for n, c in enumerate(cases) if row[n] != holds(c[0], v, c[1])]
    assert wrong == []


def test_large_decimals_compare_as_floats(spark):
    values = [Decimal(9007199254740992), Decimal(9007199254740993), Decimal(9007199254740994), Decimal(10) ** 29]
    df = column(spark, T.DecimalType(30, 0), values)
    for op in (">", ">=", "<", "<="):
        for value in ("9007199254740992", "9007199254740993", "9007199254740994", "1e29", "1e40"):
            got = [r.i for r in df.where(condition(df.schema, "c", op, value)).orderBy("i").collect()]
            assert got == [i for i, v in enumerate(values) if holds(op, float(v), value)], (op, value)


def test_time_conditions(spark):
    df = spark.sql("SELECT timestamp'2026-04-16 01:02:03' AS t UNION ALL SELECT timestamp'2026-04-16 00:00:00' UNION ALL SELECT NULL")
    count = lambda v: df.where(condition(df.schema, "t", "=", v)).count()
    assert [count(v) for v in ("2026-04-16 01:02:03", "2026-04-16 00:00:00", "2026-04-16", "", "x")] == [1, 1, 0, 1, 0]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.range(10).selectExpr(
        "id", "cast(id AS double) AS d", "cast(id AS string) AS s", "cast(id AS decimal(20,2)) AS n", "cast(id AS float) AS f",
        "timestamp_seconds(id) AS t",
    )
    frame.write.parquet(path)
    df = spark.read.parquet(path)
    for cond, pushed in [
        (("s", "=", "5"), "EqualTo(s,5)"),
        (("id", "=", "5"), "EqualTo(id,5)"),
        (("d", "=", "5.0"), "EqualTo(d,5.0)"),
        (("id", ">", "4.5"), "GreaterThan(id,4)"),
        (("id", "<=", "7.9"), "LessThanOrEqual(id,7)"),
        (("d", ">=", "5"), "GreaterThanOrEqual(d,5.0)"),
        (("id", "IN", "1,2"), "In(id, [1,2])"),
        (("s", "!=", "5"), "Not(EqualTo(s,5))"),
        (("n", "=", "5.00"), "EqualTo(n,5.00)"),
        (("n", "IN", "1.00,2.00"), "In(n, [1.00,2.00])"),
        (("n", ">", "5"), "GreaterThanOrEqual(n,4.99)"),
        (("n", "<=", "5"), "LessThanOrEqual(n,5.01)"),
        (("f", "=", "5.0"), "EqualTo(f,5.0)"),
        (("t", "=", "2026-04-16 00:00:00"), "LessThanOrEqual(t,2026-04-1"),
    ]:
        plan = df.where(condition(df.schema, *cond))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        assert pushed in plan.split("PushedFilters:")[1].split("\n")[0], cond
