"""Grouped and global aggregation driven by ``{column, function, alias}`` lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions import coerce
from millrace.operators.order import input_order
from millrace.sinks.files import written

Transform = Callable[[DataFrame], DataFrame]

ALIASES = {"average": "avg", "mean": "avg"}
ORDERED = ("first", "last")
# Ranks that a median's summary tells apart, and bins between its bounds.
ACCURACY = 10_000
PARTS = 65_536


def _value(col: Column, dtype: T.DataType) -> Column:
    """Text is read as a number; numbers and dates stay what they are. NaN is no value."""
    if isinstance(dtype, T.StringType):
        return F.nullif(coerce.number(col, dtype), F.lit(float("nan")))
    if isinstance(dtype, coerce.FRACTIONAL):
        return F.when(~F.isnan(col), col)
    return col


def _truth(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col
    if isinstance(dtype, T.StringType):
        return col != ""
    return col != F.lit(0)


def _measure(fn: str, col: Column, dtype: T.DataType, grouped: bool) -> Column:
    value = _value(col, dtype)
    double = _value(coerce.number(col, dtype), T.DoubleType())
    plain = col if isinstance(dtype, T.StringType) else value  # what a group compares: text as text
    if isinstance(dtype, T.BooleanType):
        value = col.cast("long")
    if isinstance(dtype, coerce.TEMPORAL) and fn not in ("count", "min", "max", "first", "last", "nunique", "size"):
        raise ValueError(f"{fn} does not apply to a date or time column")
    if fn == "sum":
        total = F.sum(value if grouped else double)
        return F.coalesce(total, F.lit(0).cast("double") if not grouped else F.lit(0))
    if fn == "first":
        kept = F.when(col.isNotNull(), F.struct("__at")) if grouped else F.struct("__at")
        return F.min_by(col, kept)
    n = F.count(double)
    return {
        "avg": lambda: F.avg(double),
        "count": lambda: F.count(plain),
        "min": lambda: F.min(plain if grouped else value),
        "max": lambda: F.max(plain if grouped else value),
        "last": lambda: F.max_by(col, F.when(col.isNotNull(), F.struct("__at"))),
        "std": lambda: F.stddev_samp(double),
        "var": lambda: F.var_samp(double),
        "sem": lambda: F.stddev_samp(double) / F.sqrt(n),
        "nunique": lambda: F.count_distinct(col),
        "size": lambda: F.count(F.lit(1)),
        "prod": lambda: F.coalesce(F.product(double), F.lit(1.0)),
        "any": lambda: F.coalesce(F.bool_or(_truth(col, dtype)), F.lit(False)),
        "all": lambda: F.coalesce(F.bool_and(_truth(col, dtype)), F.lit(True)),
        "skew": lambda: F.when(
            n >= 3,
            F.when(F.var_samp(double) == 0, 0.0).otherwise(
                F.skewness(double) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
            ),
        ),
    }[fn]()


KNOWN = {
    "sum", "avg", "count", "min", "max", "first", "last", "std", "var", "sem",
    "nunique", "size", "prod", "any", "all", "skew", "median",
}


def _bounds(value: Column) -> Column:
    """Two values that the middle ranks lie between, by a summary of bounded size that tasks merge.

    The summary is off by at most 1 / ``ACCURACY`` of the rows, a quarter of what the bounds leave.
    """
    return F.percentile_approx(value, [0.5 - 4 / ACCURACY, 0.5 + 4 / ACCURACY], ACCURACY)


def _large(count: Column) -> Column:
    """Whether a group has more values than its summary holds one by one; else its bounds are its middle values."""
    return count > ACCURACY // 8


def _medians(out: DataFrame, rows: DataFrame, groups: dict[str, Column], values: list[Column]) -> DataFrame:
    """Exact medians of several columns in large groups by one more pass: only what lies between the bounds is told apart.

    ``out`` has per large group the columns ``__n0``, ``__b0`` and so on: count
    and bounds of each value. What is below its lower bound counts as one value,
    what is above the upper one not at all. Counts are combined before the
    shuffle, and no group is ever together in one task: what is sorted are
    ``PARTS`` bins between the bounds, and then the values of the middle ones.
    """
    by = [*groups, "__i"]
    named = [c.alias(g) for g, c in groups.items()]
    limits = out.select(*groups, *(f"__b{i}" for i in range(len(values))))
    each = rows.select(*named, *(v.alias(f"__v{i}") for i, v in enumerate(values))).join(limits, list(groups))
    cells = F.array(*(F.struct(F.lit(i).alias("__i"), F.col(f"__v{i}").alias("v"), F.get(f"__b{i}", F.lit(0)).alias("lo"), F.get(f"__b{i}", F.lit(1)).alias("hi")) for i in range(len(values))))
    inside = each.select(*groups, F.inline(cells)).where("v <= hi")
    share = F.nanvl((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS, F.lit(float(PARTS)))
    bins = F.when(F.col("v") < F.col("lo"), -1).when(F.col("hi") > F.col("lo"), share).otherwise(0).cast("long")
    counts = inside.select(*by, bins.alias("__bin"), F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("__x"))
    counts = counts.groupBy(*by, "__bin", "__x").agg(F.count(F.lit(1)).alias("__c"))

    ranks = lambda i: F.array_distinct(F.array(F.expr(f"(__n{i} + 1) div 2"), F.expr(f"__n{i} div 2 + 1")))
    wanted = F.array(*(F.struct(F.lit(i).alias("__i"), F.when(F.col(f"__n{i}") > 0, ranks(i)).alias("r")) for i in range(len(values))))
    wanted = out.select(*groups, F.inline(wanted)).select(*by, F.explode("r").alias("__r"))

    def placed(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return cells.withColumn("__to", F.sum("__c").over(upto))

    totals = placed(counts.groupBy(*by, "__bin").agg(F.sum("__c").alias("__c")), by, "__bin")
    held = totals.join(wanted, by).where("__to - __c < __r AND __r <= __to")
    held = held.select(*by, "__bin", (F.col("__r") - F.col("__to") + F.col("__c")).alias("__r"))
    exact = placed(counts.join(held, [*by, "__bin"]), [*by, "__bin", "__r"], "__x").where("__to - __c < __r AND __r <= __to")
    return exact.groupBy(*groups).agg(*(F.avg(F.when(F.col("__i") == i, F.col("__x"))).alias(f"__m{i}") for i in range(len(values))))


def aggregate(
    group_by: list[str] | None = None,
    aggregations: list[dict] | None = None,
    order_by: list | None = None,
    sort_output: bool = False,
) -> Transform:
    """Aggregate by groups or over the whole table.

    Columns the table lacks are skipped; rows with a null group key are dropped; an
    empty table gives an empty result, also without groups. ``first`` and ``last``
    follow the ascending ``order_by`` columns (default: reading order). With a
    ``median`` the aggregate is written to the scratch folder first: small
    groups have theirs in it, for large ones its bounds say which values the
    second pass over the table has to tell apart.
    """
    wanted, specs = group_by or [], aggregations or []

    def apply(df: DataFrame) -> DataFrame:
        if not specs:
            return df
        keys = [k for k in wanted if k in df.columns]
        if wanted and not keys:
            raise ValueError(f"none of the group columns {wanted} is in the table")
        present = [s for s in specs if s.get("column") in df.columns]
        if not present:
            raise ValueError("no aggregated column is in the table")
        measures, medians, order = {}, {}, []
        for spec in present:
            column, fn = spec["column"], (spec.get("function") or "sum").lower()
            fn = ALIASES.get(fn, fn)
            if fn not in KNOWN:
                raise ValueError(f"unknown aggregate function {fn!r}")
            alias = spec.get("alias") or column
            if alias in order:
                alias = f"{alias}_{fn}"
            order.append(alias)
            col, dtype = F.col(f"`{column}`"), df.schema[column].dataType
            if fn == "median":
                value = _value(coerce.number(col, dtype), T.DoubleType())
                measures[f"__n{len(medians)}"], measures[f"__b{len(medians)}"] = F.count(value), _bounds(value)
                medians[alias] = value
            else:
                measures[alias] = _measure(fn, col, dtype, bool(keys))

        rows = df
        if any((s.get("function") or "").lower() in ORDERED for s in present):
            rows = rows.withColumn("__at", F.struct(*(order_by or input_order(df))))
        for k in keys:
            rows = rows.where(F.col(f"`{k}`").isNotNull())
            if isinstance(df.schema[k].dataType, coerce.FRACTIONAL):
                rows = rows.where(~F.isnan(f"`{k}`"))

        named = [m.alias(a) for a, m in measures.items()]
        if keys:
            out = rows.groupBy(*[f"`{k}`" for k in keys]).agg(*named)
        else:
            out = rows.agg(*named, F.count(F.lit(1)).alias("__rows")).where("__rows > 0")
        if medians:
            groups = {f"__g{i}": F.col(f"`{k}`") for i, k in enumerate(keys)} or {"__g0": F.lit(0)}
            out = written(out.withColumns(groups), "aggregate")
            middle = {a: (F.get(f"__b{i}", F.lit(0)) + F.get(f"__b{i}", F.lit(1))) / 2 for i, a in enumerate(medians)}
            large = [_large(F.col(f"__n{i}")) for i in range(len(medians))]
            limits = out.where(reduce(or_, large)).select(*groups, *(f"__{x}{i}" for i in range(len(medians)) for x in "nb"))
            limits = written(limits, "bounds")  # a table of its own, so that its size is known
            if limits.isEmpty():
                out = out.withColumns(middle)
            else:
                found = _medians(limits, rows, groups, list(medians.values()))
                out = out.join(found, list(groups), "left")
                out = out.withColumns({a: F.when(large[i], F.col(f"__m{i}")).otherwise(m) for i, (a, m) in enumerate(middle.items())})
        out = out.select(*[f"`{c}`" for c in [*keys, *order]])
        return out.orderBy(*[f"`{k}`" for k in keys]) if sort_output and keys else out

    return apply
