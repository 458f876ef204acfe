"""Units of work whose output and completion survive a broken run.

A unit (one load, date and application) has a record in the journal's folder,
which appears by one rename after its rows are in place. Appended rows go to
files that carry the unit's name, so a unit that is done again replaces what it
wrote before, and no row comes twice.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks.files import counted


def _place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _below(spark: SparkSession, path: str) -> list[str]:
    """All files below a folder; none if it isn't there."""
    fs, at = _place(spark, path)
    if not fs.exists(at):
        return []
    found, walk = [], fs.listFiles(at, True)
    while walk.hasNext():
        found.append(walk.next().getPath().toString())
    return found


def unit_name(*parts: str | None) -> str:
    """A file name for a unit: readable, and told apart by a hash of its parts."""
    text = json.dumps([p or "" for p in parts])
    shown = "-".join(re.sub(r"[^A-Za-z0-9]+", "_", p)[:24] for p in parts if p)
    return f"u-{shown}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


@dataclass(frozen=True)
class Journal:
    """Completion records below a folder that all executors share."""

    root: str

    def _path(self, unit: str) -> str:
        return f"{self.root.rstrip('/')}/{unit}.json"

    def done(self, spark: SparkSession, unit: str) -> dict | None:
        """What the finished unit recorded; nothing if it isn't finished."""
        fs, at = _place(spark, self._path(unit))
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def finish(self, spark: SparkSession, unit: str, record: dict) -> None:
        """Write the record beside its place, then rename: it is there as a whole or not at all."""
        fs, at = _place(spark, self._path(unit))
        _, beside = _place(spark, f"{self.root.rstrip('/')}/_{unit}.{uuid.uuid4().hex[:8]}")
        fs.mkdirs(at.getParent())
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        if not fs.rename(beside, at) and not fs.exists(at):
            raise OSError(f"the record of {unit} could not be put in place")


def append_unit(df: DataFrame, location: str, unit: str, partition_by: list[str] | None = None) -> int:
    """Add the rows to a parquet folder as the unit's files, in place of those of an earlier try. Returns the row count.

    They are written to a folder that readers pass over, then moved one by one;
    a run that breaks in between is made good when the unit is done again.
    """
    spark, root = df.sparkSession, location.rstrip("/")
    staged = f"{root}/_staged-{unit}"
    frame, seen = counted(df)
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).option("partitionOverwriteMode", "static").parquet(staged)
    fs, stage = _place(spark, staged)
    prefix = f"{fs.makeQualified(stage)}/"
    own = [p for p in _below(spark, root) if f"/_staged-{unit}/" not in p and p.rsplit("/", 1)[1].startswith(f"{unit}.")]
    for path in own:
        fs.delete(_place(spark, path)[1], False)
    for k, path in enumerate(sorted(p for p in _below(spark, staged) if p.endswith(".parquet"))):
        folder = path[len(prefix) :].rpartition("/")[0]
        to = _place(spark, f"{root}/{folder}/{unit}.{k:05d}.parquet" if folder else f"{root}/{unit}.{k:05d}.parquet")[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(_place(spark, path)[1], to):
            raise OSError(f"{path} could not be moved to {to}")
    fs.delete(stage, True)
    return seen.get["rows"]


def append_unit_table(df: DataFrame, name: str, unit: str, partition_by: list[str] | None = None) -> int:
    """The same for a parquet table of the catalog, which is made if it isn't there."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        empty = df.limit(0).write.format("parquet").mode("ignore")
        (empty.partitionBy(*partition_by) if partition_by else empty).saveAsTable(name)
    rows = df.select(*[f"`{c}`" for c in spark.table(name).columns])  # the table's order
    detail = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    keys = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    n = append_unit(rows, detail["Location"], unit, keys)
    if keys:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)
    return n
