"""Pages, bulk results and previews of a query."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

def page(df: DataFrame, limit: int, offset: int = 0, order_by: list | None = None) -> DataFrame:
    """Rows ``offset .. offset + limit`` of a result. Pages only line up under a total order."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def fetch(df: DataFrame, limit: int, offset: int = 0, order_by: list | None = None) -> dict:
    """One page for display. One row more than asked tells whether the result goes on."""
    started = time.perf_counter()
    rows = page(df, limit + 1, offset, order_by).collect()
    return {
        "columns": df.columns,
        "rows": [list(r) for r in rows[:limit]],
        "row_count": min(len(rows), limit),
        "truncated": len(rows) > limit,
        "duration_ms": round((time.perf_counter() - started) * 1000, 2),
    }


def fetch_bulk(df: DataFrame, max_rows: int = 100_000) -> dict:
    return fetch(df, max_rows)


def bulk(df: DataFrame, max_rows: int, order_by: list) -> DataFrame:
    """At most ``max_rows`` rows, each with the flag whether the result had more."""
    more = df.limit(max_rows + 1).agg((F.count(F.lit(1)) > max_rows).alias("truncated"))
    return df.orderBy(*order_by).limit(max_rows).withColumn("truncated", more.scalar())


def top(df: DataFrame, n: int, order_by: list, offset: int = 0) -> DataFrame:
    """The first ``n`` rows of an order: a top-k, not a sort of the table."""
    return page(df, n, offset, order_by)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The last ``n`` rows, in ascending order."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n).orderBy(*order_by)
