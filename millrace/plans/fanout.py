"""Repeating an extract over applications and dates as one plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from millrace.functions.coerce import on_day, text_in
from millrace.functions.templating import replace_names
from millrace.functions.tokens import folder_name, iso_date
from millrace.operators.join import last_per_key
from millrace.plans.transforms import READ_ONLY, check_statement
from millrace.sinks.files import ROWS_PER_SEGMENT, extract_to_parquet

PLACE = re.compile(r"\{(\w+)\}")


def foreach_app(df: DataFrame, app_column: str, entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of every listed application, tagged with its id and name.

    One join replaces one extract per application. ``entries`` has ``key`` and
    ``value``; of several entries of a key the last counts. Known ``keys`` also become a filter, which reaches
    the scan.
    """
    dtype = df.schema[app_column].dataType
    if keys:
        df = df.where(text_in(F.col(app_column), dtype, [str(k) for k in keys]))
    apps = last_per_key(entries).withColumnsRenamed({"key": "application_id", "value": "application_name"})
    return df.join(apps, F.col(app_column).cast("string") == F.col("application_id"))


def multi_date(df: DataFrame, column: str, dates: list[str], name: str = "business_date") -> DataFrame:
    """Rows of several business dates (compact text), with the date as a text column to partition by."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        wanted = reduce(or_, [on_day(F.col(column), dtype, iso_date(d)) for d in dates], F.lit(False))
    else:
        wanted = F.col(column).isin([F.lit(iso_date(d)).cast(dtype) for d in dates])
    return df.where(wanted).withColumn(name, F.date_format(column, "yyyyMMdd"))


def pending_units(planned: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Planned units without a completed record in the ledger."""
    done = ledger.where(F.col("status") == "completed").select(*keys).distinct()
    return planned.join(done, keys, "left_anti")


def planned_units(branches: list[str], entries: DataFrame, dates: list[str]) -> DataFrame:
    """Every (branch, application, date) a run consists of."""
    pairs = F.array(*[F.struct(F.lit(b).alias("branch"), F.lit(d).alias("date")) for b in branches for d in dates])
    return entries.select(F.col("key").alias("application_id"), F.inline(pairs))


def entry_folder(template: str, values: dict[str, str]) -> str:
    """Folder of one entry below the root. Places are filled in only if all of them are known."""
    places = set(PLACE.findall(template))
    if places <= values.keys():
        template = PLACE.sub(lambda m: str(values[m[1]]), template)
    return "/".join(map(folder_name, template.split("/")))


def foreach_extract(
    spark: SparkSession,
    sql: str,
    entries: list[dict],
    root: str,
    path_template: str,
    key_param: str = "app_id",
    value_param: str = "app_name",
    static_params: dict[str, str] | None = None,
    chunk_size: int = ROWS_PER_SEGMENT,
    read: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    """An extract whose text differs per entry. An entry that fails is reported in its row; the others go on."""
    check_statement(sql, READ_ONLY)
    rows = []
    for entry in entries:
        params = {**(static_params or {}), key_param: entry["key"], value_param: entry["value"]}
        path = f"{root.rstrip('/')}/{entry_folder(path_template, params)}"
        row = {"key": entry["key"], "value": entry["value"], "output_dir": path, "error": None}
        try:
            stats = extract_to_parquet((read or spark.sql)(replace_names(sql, params)), path, chunk_size)
            row |= {"total_rows": stats["total_rows"], "file_count": stats["file_count"]}
        except Exception as err:  # one entry's failure belongs in its result row
            lines = str(err).strip().splitlines() or [type(err).__name__]
            row |= {"total_rows": 0, "file_count": 0, "error": lines[0]}
        rows.append(row)
    schema = "key string, value string, total_rows long, file_count long, output_dir string, error string"
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
