"""Helpers shared by the operators: words, written intermediate tables, broadcast of bounded models."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import scratch_path

WHITE = "[ \\t-\\r]+"  # the white space that separates words


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case; bytes.split() and bytes.lower() know exactly ASCII."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared scratch folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(col: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    home = str(Path(__file__).resolve().parents[2])
    there = spark.sparkContext.environment
    if home not in there.get("PYTHONPATH", "").split(os.pathsep):
        there["PYTHONPATH"] = os.pathsep.join(x for x in (home, there.get("PYTHONPATH", "")) if x)


class Memory:
    """What a worker remembers, in two generations: when the younger is full the older is forgotten.

    Whatever was used since the last change of generations stays, so frequent
    entries do, and there are never more than twice ``size``.
    """

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """Those of the different ``keys`` that are not known; the others are young afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys:
            if key not in young:
                got = old.get(key)
                if got is None:
                    out.append(key)
                else:
                    young[key] = got
        return out
