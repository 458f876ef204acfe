"""Union of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by position."""
    return reduce(DataFrame.union, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """UNION: by position, without duplicates."""
    return union_all(*frames).distinct()


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
