"""Dictionaries: tables of ``key``, ``value`` and a map of ``extra`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.order import sort_by


def extra_column(name: str) -> Column:
    """An extra column's text, ``''`` when the entry lacks it."""
    return F.coalesce(F.try_element_at("extra", F.lit(name)), F.lit(""))


def entry_filter(
    entries: DataFrame, key: str = "", value: str = "", extras: dict[str, str] | None = None
) -> DataFrame:
    """Entries whose key and value contain the texts and whose extras equal the given values."""
    for name, needle in (("key", key), ("value", value)):
        if needle.strip():
            entries = entries.where(F.lower(name).contains(needle.strip().lower()))
    for name, wanted in (extras or {}).items():
        if wanted.strip():
            entries = entries.where(extra_column(name) == wanted.strip())
    return entries


def iterator_entries(
    entries: DataFrame, selected_keys: list[str] | None = None, entry_filters: list[dict] | None = None
) -> DataFrame:
    """The entries an iterator walks, with their ``iteration`` order.

    Selected keys keep the order in which they were selected, the last entry of a
    key counts; without a selection every entry is walked by ``position``.
    """
    for f in entry_filters or []:
        name, wanted = str(f.get("column") or "").strip(), str(f.get("value") or "").strip()
        if name and wanted:
            entries = entries.where(extra_column(name) == wanted)
    if not selected_keys:
        return entries.withColumn("iteration", F.col("position").cast("long"))
    chosen = entries.where(F.col("key").isin(selected_keys))
    last = chosen.groupBy("key").agg(F.max_by(F.struct(*chosen.columns), "position").alias("e")).select("e.*")
    order = F.array_position(F.array(*[F.lit(k) for k in selected_keys]), F.col("key"))
    return last.withColumn("iteration", order.cast("long"))


def facets(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-empty values of each extra column, as rows ``(column, value)``."""
    pairs = [F.struct(F.lit(c).alias("column"), F.trim(extra_column(c)).alias("value")) for c in columns]
    return entries.select(F.inline(F.array(*pairs))).where("value <> ''").distinct().orderBy("column", "value")


def case_insensitive_keys(by: str = "key", direction: str = "asc") -> list[tuple[Column, str]]:
    """Sort keys for key, value or an extra column, ignoring case."""
    text = F.lower(by) if by in ("key", "value") else F.lower(extra_column(by))
    return [(text, direction)]


def sort_case_insensitive(entries: DataFrame, by: str = "key", direction: str = "asc") -> DataFrame:
    return sort_by(entries, case_insensitive_keys(by, direction))
