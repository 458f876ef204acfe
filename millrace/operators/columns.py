"""Column selection: drop, rename, constants, schema conformity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.operators.dedup import dedup
from millrace.operators.predicates import filter_equal

Transform = Callable[[DataFrame], DataFrame]


def drop_columns(names: list[str]) -> Transform:
    """Remove columns; names the table lacks, in this very case, are ignored."""
    return lambda df: df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def rename_columns(mapping: dict[str, str]) -> Transform:
    """Rename columns; names the table lacks are ignored."""
    return lambda df: df.toDF(*[mapping.get(c, c) for c in df.columns])


def add_application_id(value: str | Column | None) -> Transform:
    """Tag rows with the application they came from."""
    col = value if isinstance(value, Column) else F.lit(value).cast("string")
    return lambda df: df.withColumn("application_id", col)


def literal_columns(values: dict) -> Transform:
    """Add constants as columns."""
    return lambda df: df.withColumns({name: F.lit(v) for name, v in values.items()})


def basic_chain(
    drop: list[str] | None = None,
    rename: dict[str, str] | None = None,
    filters: dict | None = None,
    dedup_on: list[str] | None = None,
    order_by: list | None = None,
) -> Transform:
    """The fixed chain of a simple job: drop, rename, filter, then dedup."""

    def apply(df: DataFrame) -> DataFrame:
        df = df.transform(drop_columns(drop or [])).transform(rename_columns(rename or {}))
        df = df.transform(filter_equal(filters or {}))
        return df.transform(dedup(dedup_on, order_by)) if dedup_on else df

    return apply


def _attempt(schema: T.StructType, field: T.StructField) -> Column:
    if field.name not in schema.names:
        return F.lit(None).cast(field.dataType)
    return F.col(f"`{field.name}`").try_cast(field.dataType)


def _failed(schema: T.StructType, target: T.StructType) -> Column:
    """Names of the cells that hold a value which the target type cannot."""
    marks = [
        F.when(F.col(f"`{f.name}`").isNotNull() & _attempt(schema, f).isNull(), f.name)
        for f in target
        if f.name in schema.names and schema[f.name].dataType != f.dataType
    ]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def conform(target: T.StructType) -> Transform:
    """Cast to a saved schema; missing columns and cells that do not fit become null."""
    return lambda df: df.select(*[_attempt(df.schema, f).alias(f.name) for f in target])


def conform_report(df: DataFrame, target: T.StructType) -> DataFrame:
    """How many cells of each column ``conform`` would turn into null."""
    return (
        df.select(F.explode(_failed(df.schema, target)).alias("column"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("bad_cells"))
    )


def split_valid(df: DataFrame, target: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit a schema, typed, and the rows that do not, as they came, with the bad columns named."""
    failed = _failed(df.schema, target)
    good = df.where(F.size(failed) == 0).transform(conform(target))
    bad = df.withColumn("bad_columns", failed).where(F.size("bad_columns") > 0)
    return good, bad


def schema_descriptor(schema: T.StructType) -> list[dict]:
    """Schema as ``[{name, type, nullable}]``, the form kept beside a dataset."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in schema]


def schema_from_descriptor(fields: list[dict]) -> T.StructType:
    return T.StructType(
        [T.StructField(f["name"], T.DataType.fromDDL(f["type"]), bool(f.get("nullable", True))) for f in fields]
    )
