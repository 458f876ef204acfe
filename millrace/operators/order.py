"""Sorting and numbering rows without a one-partition window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions import coerce
from millrace.session import scratch_path

Transform = Callable[[DataFrame], DataFrame]


def input_order(df: DataFrame) -> list[Column]:
    """Columns that give the order in which rows were read.

    A parquet scan knows file and row; for anything else the position inside the
    current partitioning is the best there is.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    except AnalysisException:
        return [F.monotonically_increasing_id()]


def sort_keys(schema: T.StructType, columns: list[dict]) -> list[tuple[Column, str]]:
    """Key expressions, each with its direction.

    Null comes last when ascending and first when descending; numbers before text.
    """
    keys: list[tuple[Column, str]] = []
    for spec in columns:
        name = spec.get("column", "")
        if name not in schema.names:
            continue
        col, dtype = F.col(f"`{name}`"), schema[name].dataType
        if isinstance(dtype, T.StringType):
            value = coerce.number(col, dtype)
            parts = [col.isNull(), value.isNull(), value, F.when(value.isNull(), F.lower(col))]
        elif isinstance(dtype, coerce.NESTED):
            parts = [F.lower(coerce.cell_text(col, dtype))]
        else:
            parts = [col]
        down = (spec.get("direction") or "asc").lower() == "desc"
        keys += [(p, "desc_nulls_first" if down else "asc_nulls_last") for p in parts]
    return keys


def keyed(df: DataFrame, keys: list[tuple[Column, str]]) -> tuple[DataFrame, list[Column]]:
    """The table with its sort keys as columns ``__k0 ..`` and the order over them.

    A sort evaluates its expressions anew in every comparison, a column once per row.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    df = df.withColumns({n: e for n, (e, _) in zip(names, keys)})
    return df, [getattr(F.col(n), direction)() for n, (_, direction) in zip(names, keys)]


def sort_by(df: DataFrame, keys: list[tuple[Column, str]]) -> DataFrame:
    """Stable sort by keys.

    The row's position is the last key: ties keep their order, and a value shared
    by a large part of the table is still split over many range partitions.
    """
    if not keys:
        return df
    wide, order = keyed(df.withColumn("__at", F.monotonically_increasing_id()), keys)
    return wide.orderBy(*order, "__at").select(*[f"`{c}`" for c in df.columns])


def sort_rows(columns: list[dict]) -> Transform:
    """Stable sort over several columns ``{column, direction}``."""
    return lambda df: sort_by(df, sort_keys(df.schema, columns))


def number_sorted(df: DataFrame, keys: list[tuple[Column, str]], name: str = "row_number") -> DataFrame:
    """Number all rows in the order of sort keys."""
    wide, order = keyed(df, keys)
    return number_rows(wide, order, name).drop(*[f"__k{i}" for i in range(len(keys))])


def number_rows(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """Number all rows 1, 2, ... in the order of columns, in parallel.

    Rows are range partitioned and sorted, each with its place in its partition,
    and written once to the shared scratch folder (the sampled range borders must
    not be drawn twice). Adding the size of all earlier partitions gives the row
    number; that table has one row per partition, so it is safe to broadcast.
    """
    path = scratch_path(df.sparkSession, "numbered")
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    (
        df.withColumn("__at", F.monotonically_increasing_id())
        .repartitionByRange(*order, "__at")
        .sortWithinPartitions(*order, "__at")
        .drop("__at")
        .withColumns({"__part": F.spark_partition_id(), "__place": place})
        .write.parquet(path)
    )
    rows = df.sparkSession.read.parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    )
    number = (F.col("__start") + F.col("__place") + 1).alias(name)
    return rows.join(F.broadcast(starts), "__part").select(*df.columns, number)


def segments(df: DataFrame, size: int, order: list | None = None) -> DataFrame:
    """Cut a table into numbered segments of ``size`` rows, in key or reading order."""
    numbered = number_rows(df, order or input_order(df), "__n")
    return numbered.withColumn("segment", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def _pieces(text: Column) -> Column:
    """The numbers in a text and what is between them, as an array to sort by: 'a2b10' comes before 'a10b2'.

    Numbers come before text; digits without leading zeros are compared by length
    first, so a number may have any length.
    """

    def key(piece: Column) -> Column:
        digits, bare = piece.rlike("^[0-9]"), F.ltrim(piece, F.lit("0"))
        return F.struct(~digits, F.when(digits, F.length(bare)), F.when(digits, bare).otherwise(piece))

    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), key)


def natural_keys(schema: T.StructType, column: str, direction: str = "asc") -> list[tuple[Column, str]]:
    """Keys of a grid sort: numeric text by value, nulls last both ways."""
    col, dtype = F.col(f"`{column}`"), schema[column].dataType
    text = coerce.cell_text(col, dtype)
    value = coerce.number(col, dtype)
    parts = [value] if coerce.is_numeric(dtype) else [value.isNull(), value, _pieces(text), text]
    down = direction.lower() == "desc"
    return [(col.isNull(), "asc")] + [(p, "desc_nulls_last" if down else "asc_nulls_last") for p in parts]
