"""Equi joins of two tables and dictionary lookup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import coerce

Transform = Callable[[DataFrame], DataFrame]

_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full"}


def _on(keys: list[dict]) -> Column:
    return reduce(and_, [F.col(f"l.`{k['left']}`") == F.col(f"r.`{k['right']}`") for k in keys])


def _right_names(left: DataFrame, right: DataFrame, prefix: str) -> list[str]:
    """Output names of the right columns: one that clashes gets the prefix."""
    taken, names = set(left.columns), []
    for name in right.columns:
        while name in taken:
            name = f"{prefix}{name}"
        taken.add(name)
        names.append(name)
    return names


def _padded(columns: list[str], frame: DataFrame, names: list[str]) -> list[Column]:
    return [F.lit(None).cast(frame.schema[c].dataType).alias(n) for c, n in zip(columns, names)]


def _without_partner(kept: DataFrame, other: DataFrame, mine: list[str], theirs: list[str]) -> DataFrame:
    """Rows of ``kept`` with no match.

    The other side shrinks to its distinct keys before the shuffle. Rows with a
    null key are set aside first; the rest is then the same input as the inner
    join's, so Spark shuffles it once for both.
    """
    key = F.struct(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(theirs)])
    # Grouped as one struct and taken apart again: the join then shuffles the keys by itself, and
    # only between two plain shuffles does Spark split a hot key of the kept rows over several tasks.
    keys = other.select(key.alias("__key")).distinct().select("__key.*")
    test = reduce(and_, [F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(mine)])
    whole = reduce(and_, [F.col(f"`{c}`").isNotNull() for c in mine])
    return kept.where(whole).join(keys, test, "left_anti").union(kept.where(~whole))


def join_tables(
    other: DataFrame, keys: list[dict], how: str = "inner", prefix: str = "right_", hot_keys: bool = False
) -> Transform:
    """Join on key pairs ``[{left, right}]`` whose names may differ. Null keys never match.

    The plan is left to Spark, which broadcasts small inputs and splits skewed
    partitions. What it can't split is a hot key on the side of an outer join
    that may be missing (on either side of a full join). ``hot_keys=True`` says
    that there is one: the join then runs as the inner join plus the unmatched
    rows, both of which can be split and reuse the same shuffle of the kept side.
    """
    kind = _KINDS[how.lower()]

    def apply(left: DataFrame) -> DataFrame:
        lk, rk = [k["left"] for k in keys], [k["right"] for k in keys]
        l_names, r_names = left.columns, _right_names(left, other, prefix)
        out = [F.col(f"l.`{c}`").alias(c) for c in l_names]
        out += [F.col(f"r.`{c}`").alias(n) for c, n in zip(other.columns, r_names)]

        def plain(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
            return a.alias("l").join(b.alias("r"), _on(keys), mode).select(*out)

        def left_only() -> DataFrame:
            rest = _without_partner(left, other, lk, rk)
            return rest.select(*[F.col(f"`{c}`") for c in l_names], *_padded(other.columns, other, r_names))

        def right_only() -> DataFrame:
            rest = _without_partner(other, left, rk, lk)
            return rest.select(
                *_padded(l_names, left, l_names), *[F.col(f"`{c}`").alias(n) for c, n in zip(other.columns, r_names)]
            )

        if kind == "inner" or not hot_keys:
            return plain(left, other, kind)
        matched = plain(left, other, "inner")
        if kind != "right":
            matched = matched.unionByName(left_only())
        return matched if kind == "left" else matched.unionByName(right_only())

    return apply


def last_per_key(dictionary: DataFrame) -> DataFrame:
    """One value per dictionary key: the entry with the highest ``position``, or the last one read."""
    order = F.col("position") if "position" in dictionary.columns else F.monotonically_increasing_id()
    entries = dictionary.select(F.col("key").cast("string"), F.col("value").cast("string"), order.alias("__at"))
    last = entries.groupBy(F.struct("key").alias("__key")).agg(F.max_by("value", "__at").alias("value"))
    return last.select("__key.key", "value")  # as a struct for the reason given in _without_partner


def lookup(
    dictionary: DataFrame, match_column: str, output_column: str, default: str = "", hit_column: str | None = None
) -> Transform:
    """Map a column through a dictionary ``(key, value[, position])``; rows without an entry get the default.

    Duplicate keys are collapsed first, so the join never multiplies rows.
    """
    if not match_column or not output_column:
        raise ValueError("lookup needs match_column and output_column")

    def apply(df: DataFrame) -> DataFrame:
        if match_column in df.columns:
            key = coerce.text_or_none(F.col(f"`{match_column}`"), df.schema[match_column].dataType)
        else:
            key = F.lit("")
        entries = last_per_key(dictionary).withColumnsRenamed({"key": "__key", "value": "__value"})
        joined = df.withColumn("__match", key).join(entries, F.col("__match") == F.col("__key"), "left")
        found = {output_column: F.coalesce("__value", F.lit(default))}
        if hit_column:
            found[hit_column] = F.col("__value").isNotNull()
        return joined.withColumns(found).drop("__match", "__key", "__value")

    return apply
