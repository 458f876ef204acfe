"""Conditions written as ``{column, operator, value}``, combined by AND or OR."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import coerce


def _missing(op: str, text: str) -> Column:
    """A column the table does not have reads as an empty cell."""
    verdict = {
        "=": text == "",
        "!=": text != "",
        "LIKE": text.replace("%", "") == "",
        "IN": "" in [o.strip() for o in text.split(",")],
        "IS NULL": True,
        ">": False,
        "<": False,
        ">=": False,
        "<=": False,
    }
    return F.lit(verdict.get(op, True))


def condition(schema: T.StructType, column: str, op: str = "=", value=None) -> Column:
    """One condition as a boolean column. Null and false both mean "drop"."""
    text = "" if value is None else str(value)
    if column not in schema.names:
        return _missing(op, text)
    col, dtype = F.col(f"`{column}`"), schema[column].dataType
    is_text = isinstance(dtype, T.StringType)

    if op == "=":
        if text == "":
            return col.isNull() | (col == "") if is_text else col.isNull()
        return coerce.text_equals(col, dtype, text)
    if op == "!=":
        if text == "":
            return col.isNotNull() & (col != "") if is_text else col.isNotNull()
        return col.isNull() | ~coerce.text_equals(col, dtype, text)
    if op in (">", "<", ">=", "<="):
        return coerce.compare_number(col, dtype, op, text)
    if op == "LIKE":
        needle = text.replace("%", "").lower()
        return F.lower(coerce.text_or_empty(col, dtype)).contains(needle) if needle else F.lit(True)
    if op == "IN":
        options = [o.strip() for o in text.split(",")]
        found = coerce.text_in(col, dtype, [o for o in options if o] + ([""] if is_text and "" in options else []))
        return found | col.isNull() if "" in options else found
    if op == "IS NULL":
        return col.isNull() | (col == "") if is_text else col.isNull()
    return F.lit(True)


def filter_rows(conditions: list[dict], logic: str = "AND") -> Callable[[DataFrame], DataFrame]:
    """Keep rows by conditions; none at all keeps every row."""

    def apply(df: DataFrame) -> DataFrame:
        tests = [
            condition(df.schema, c.get("column", ""), c.get("operator", "="), c.get("value", "")) for c in conditions
        ]
        if not tests:
            return df
        combine = and_ if (logic or "AND").upper() == "AND" else or_
        return df.where(reduce(combine, tests))

    return apply


def equals_text(schema: T.StructType, column: str, value) -> Column:
    """Plain equality of a config's ``filters`` map: null prints as ``None``."""
    text = str(value)
    if column not in schema.names:
        return F.lit(text == "")
    col, dtype = F.col(f"`{column}`"), schema[column].dataType
    same = coerce.text_equals(col, dtype, text)
    return col.isNull() | same if text == "None" else same


def filter_equal(filters: dict) -> Callable[[DataFrame], DataFrame]:
    """AND of plain equalities."""

    def apply(df: DataFrame) -> DataFrame:
        tests = [equals_text(df.schema, c, v) for c, v in filters.items()]
        return df.where(reduce(and_, tests)) if tests else df

    return apply
