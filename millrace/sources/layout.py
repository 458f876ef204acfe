"""Dataset folders ``<root>/<date>/<pipeline>/<extract>/<app?>`` : one layout for writer, loader and listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.tokens import path_token, view_name
from millrace.sources.files import below, list_files

DATA_SUFFIX = r"\.(parquet|csv|csv\.gz)$"


@dataclass(frozen=True)
class Layout:
    """Where an extract's files go. A template may use ``{business_date}``, ``{pipeline_name}``,
    ``{extract_label}`` and ``{app_id}``; a fixed folder is put above the default levels."""

    root: str
    output_dir: str | None = None
    path_template: str | None = None

    def dataset(self, date: str, pipeline: str | None, extract: str | None, app_id: str | None = None) -> str:
        names = {
            "business_date": date,
            "pipeline_name": path_token(pipeline, "PIPELINE"),
            "extract_label": path_token(extract, "EXTRACT"),
            "app_id": path_token(app_id, "") if app_id else "",
        }
        if self.path_template and not self.output_dir:
            path = self.path_template
            for name, text in names.items():
                path = path.replace("{" + name + "}", text)
            parts = path.split("/")
        else:
            parts = (self.output_dir or "").split("/") + list(names.values())
        return "/".join([self.root.rstrip("/"), *[p for p in parts if p]])


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Dataset folders at whatever depth: name, format, files, bytes, last change and view name."""
    files = list_files(spark, root).where(F.col("path").rlike(DATA_SUFFIX) & ~F.col("path").rlike(r"/[_.][^/]*$"))
    rel = F.regexp_extract("path", f"{below(root)}(.*)$", 1)
    named = files.select(
        F.regexp_replace(rel, r"/[^/]*$", "").alias("name"),
        F.when(rel.endswith(".parquet"), "parquet").otherwise("csv").alias("format"),
        "length",
        "modificationTime",
    )
    parts = F.split("name", "/")
    return (
        named.groupBy("name")
        .agg(
            F.max("format").alias("format"),  # parquet wins over csv
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("last_modified"),
        )
        .withColumns(
            {
                "business_date": parts[0],
                "pipeline": parts[1],
                "extract_label": parts[2],
                "app_id": F.try_element_at(parts, F.lit(4)),
            }
        )
    )


def register_views(spark: SparkSession, root: str, suppress: set[str] | None = None, known: set[str] | None = None):
    """One temporary view per dataset folder, parquet preferred over CSV.

    Returns the names now registered; views of ``known`` whose folder is gone are dropped.
    """
    names: set[str] = set()
    for row in list_datasets(spark, root).select("name", "format").toLocalIterator():
        parts = row["name"].split("/")
        if len(parts) < 3:
            continue
        view = view_name(parts[0], "/".join(parts[1:3]), "/".join(parts[3:]))
        if view in (suppress or set()):
            continue
        names.add(view)
        if view in (known or set()):
            continue
        path = f"{root.rstrip('/')}/{row['name']}"
        if row["format"] == "parquet":
            df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
        else:
            df = spark.read.options(header=True, inferSchema=True).csv(path)
        df.createOrReplaceTempView(view)
    for gone in (known or set()) - names:
        spark.catalog.dropTempView(gone)
    return names


def preview_dataset(spark: SparkSession, path: str, limit: int = 200, offset: int = 0) -> tuple[DataFrame, dict]:
    """A page of a parquet dataset in file and row order, with total rows, file count and whether more follow.

    Rows are counted per file first, so that only the files that the page touches are read and sorted.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a preview page has at least one row and a non-negative offset")
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    file = F.col("_metadata.file_path")
    counts = df.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    size = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("file").alias("files")).first()
    touched, before, skipped = [], 0, 0
    if offset < size["rows"]:
        for row in counts.orderBy("file").toLocalIterator():
            if before + row["rows"] <= offset:
                skipped += row["rows"]
            else:
                touched.append(row["file"])
            before += row["rows"]
            if before >= offset + limit:
                break
    rows = df.where(file.isin(touched)) if touched else df.limit(0)
    page = rows.orderBy(file, "_metadata.row_index").offset(offset - skipped).limit(limit) if touched else rows
    shown = max(0, min(limit, size["rows"] - offset))
    return page, {
        "row_count": shown,
        "total_rows": size["rows"],
        "truncated": offset + shown < size["rows"],
        "file_count": size["files"],
        "format": "parquet",
    }
