"""Search, filter, sort and transpose as the result grid offers them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import coerce
from millrace.operators.order import natural_keys, sort_by

Transform = Callable[[DataFrame], DataFrame]



def _lower(df: DataFrame, name: str) -> Column:
    return F.lower(coerce.cell_text(F.col(f"`{name}`"), df.schema[name].dataType))


def search(text: str) -> Transform:
    """Rows in which any cell contains the text; null cells never match."""

    def apply(df: DataFrame) -> DataFrame:
        if not text:
            return df
        hits = [F.coalesce(_lower(df, c).contains(text.lower()), F.lit(False)) for c in df.columns]
        return df.where(reduce(or_, hits))

    return apply


def column_filters(filters: dict[str, str]) -> Transform:
    """Rows whose cells contain every column's text; a null cell reads ``null``."""

    def apply(df: DataFrame) -> DataFrame:
        tests = [
            F.coalesce(_lower(df, c), F.lit("null")).contains(text.lower())
            for c, text in filters.items()
            if text and c in df.columns
        ]
        return df.where(reduce(and_, tests)) if tests else df

    return apply


def sort_natural(column: str, direction: str = "asc") -> Transform:
    """Sort by a column with numbers inside text compared by value, nulls last both ways."""

    return lambda df: sort_by(df, natural_keys(df.schema, column, direction))


def transpose(
    page: DataFrame, order_by: list, rows: int, name_filter: str = "", row_filters: dict[int, str] | None = None
) -> DataFrame:
    """A page shown as one row per column, with columns ``row_1 .. row_n``.

    The result has a column per row of the page, so pages are for display.
    """
    if rows < 1:
        raise ValueError("a page has one row at least")
    top = page.orderBy(*order_by).limit(rows)
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), coerce.cell_text(F.col(f"`{c}`"), f.dataType).alias("cell"))
        for i, (c, f) in enumerate(zip(page.columns, page.schema.fields))
        if name_filter.lower() in c.lower()
    ]
    numbered = top.withColumn("__rn", F.row_number().over(Window.orderBy(*order_by)))
    long = numbered.select("__rn", F.inline(F.array(*cells)))
    wide = long.groupBy("ordinal", "column").pivot("__rn", list(range(1, rows + 1))).agg(F.first("cell"))
    wide = wide.select("ordinal", "column", *[F.col(f"`{i}`").alias(f"row_{i}") for i in range(1, rows + 1)])
    for i, text in (row_filters or {}).items():
        wide = wide.where(F.lower(F.coalesce(f"row_{i}", F.lit("null"))).contains(text.lower()))
    return wide
