"""Keep the first row of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def dedup(keys: list[str], order_by: list | None = None) -> Callable[[DataFrame], DataFrame]:
    """First row per key set in the given order (default: reading order); null keys are equal.

    Written as ``row_number() = 1``, which Spark cuts down to one row per key in
    every map task before the shuffle: a key that holds a third of the table
    sends one row per task, not its whole group.
    """

    def apply(df: DataFrame) -> DataFrame:
        present = [k for k in keys if k in df.columns]
        if not present:
            return df
        order = order_by
        ranked, helpers = df, []
        if not order:
            from millrace.operators.order import input_order

            columns = input_order(df)
            helpers = [f"__o{i}" for i in range(len(columns))]
            ranked, order = df.withColumns(dict(zip(helpers, columns))), helpers
        window = Window.partitionBy(*[f"`{k}`" for k in present]).orderBy(*order)
        return ranked.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", *helpers)

    return apply
