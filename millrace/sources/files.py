"""File scans: CSV, JSON, parquet, ORC, by extension or by pattern."""

from __future__ import annotations

import codecs
import fnmatch
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

# Format by file extension.
EXTENSIONS = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".csv.gz": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".orc": "orc",
}

# Spark's names of charsets that Python calls otherwise.
CHARSETS = {"iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}

Schema = str | T.StructType | None


def _charset(encoding: str) -> str:
    name = codecs.lookup(encoding).name
    return CHARSETS.get(name, name)


def _reader(spark: SparkSession, schema: Schema, options: dict | None) -> DataFrameReader:
    reader = spark.read.options(**(options or {}))
    return reader.schema(schema) if schema else reader


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    schema: Schema = None,
    infer: bool = True,
    **options: str,
) -> DataFrame:
    """CSV files. With a schema the files are read once; inference reads them twice.

    Columns of a file without header are named ``0 .. n-1``.
    """
    base = {"sep": sep, "header": header, "encoding": _charset(encoding), "inferSchema": infer and schema is None}
    df = _reader(spark, schema, {**base, **options}).csv(path)
    if header or schema:
        return df
    return df.toDF(*[str(i) for i in range(len(df.columns))])


def scan_json(
    spark: SparkSession,
    path: str | list[str],
    lines: bool = True,
    schema: Schema = None,
    encoding: str = "utf-8",
    **options: str,
) -> DataFrame:
    """JSON lines, or files with one JSON array each; nested objects stay structs."""
    base = {"multiLine": not lines}
    if (charset := _charset(encoding)) != "utf-8":
        base |= {"encoding": charset, **({"lineSep": "\n"} if lines else {})}
    return _reader(spark, schema, {**base, **options}).json(path)


def scan_parquet(spark: SparkSession, *paths: str, schema: Schema = None, **options: str) -> DataFrame:
    return _reader(spark, schema, options).parquet(*paths)


def scan_orc(spark: SparkSession, *paths: str, schema: Schema = None, **options: str) -> DataFrame:
    return _reader(spark, schema, options).orc(list(paths))


def detect_format(name: str) -> str:
    """Format by extension; parquet when it tells nothing."""
    lowered = name.lower()
    return next((fmt for ext, fmt in EXTENSIONS.items() if lowered.endswith(ext)), "parquet")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as rows ``(path, length, modificationTime)``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def first_file(spark: SparkSession, path: str, accept: Callable[[str], bool] = bool) -> str:
    """Name of the first accepted file. Only Spark's file listing is read; no job runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    name = min(filter(accept, map(unquote, files)), default=None)
    if name is None:
        raise FileNotFoundError(f"no matching file below {path}")
    return name


def scan_files(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    schema: Schema = None,
    csv_header: bool = True,
    csv_sep: str = ",",
    csv_infer: bool = True,
    options: dict | None = None,
) -> DataFrame:
    """All files below a path in one format, found from the first file's extension if need be."""
    fmt = detect_format(first_file(spark, path)) if fmt == "auto" else fmt
    options = {"recursiveFileLookup": "true", **(options or {})}
    if fmt == "csv":
        csv = {"header": csv_header, "sep": csv_sep, "inferSchema": csv_infer and schema is None}
        return _reader(spark, schema, {**csv, **options}).csv(path)
    return _reader(spark, schema, options).format(fmt).load(path)


def below(path: str) -> str:
    """Expression for a file URI up to and with the folder ``path``, whatever its scheme."""
    return f"^.*?{re.escape(re.sub(r'^[a-z0-9]+:/*', '/', path).rstrip('/'))}/"


def decoded(uri: Column) -> Column:
    """A file URI as plain text."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _pattern(glob: str) -> str:
    """Regular expression of a pattern in which ``*`` also crosses folders."""
    body = fnmatch.translate(glob)
    return re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"\1", body).replace("(?>", "(?:")


def _name_glob(glob: str) -> str | None:
    """A pattern every matching file name must satisfy, for the file listing."""
    ending = re.split(r"[*?\]]", glob)[-1].split("/")[-1]
    return f"*{ending}" if ending and "[" not in ending else None


def scan_glob(
    spark: SparkSession,
    root: str,
    prefix: str = "",
    pattern: str = "*",
    fmt: str = "auto",
    schema: Schema = None,
    options: dict | None = None,
    **csv: bool | str,
) -> DataFrame:
    """Files below ``root/prefix`` whose key, relative or from the root, matches a pattern.

    The test is on the scan's file path, so Spark drops other files when it lists
    them. There is no cap on the number of files.
    """
    root, prefix = root.rstrip("/"), prefix.strip("/")
    base = f"{root}/{prefix}" if prefix else root
    ending = _name_glob(pattern)
    expression = _path_expression(root, prefix, pattern)
    if fmt == "auto":
        fmt = detect_format(first_file(spark, base, lambda name: re.search(expression, name) is not None))
    opts = {**({"pathGlobFilter": ending} if ending else {}), **(options or {})}
    df = scan_files(spark, base, fmt, schema, options=opts, **csv)
    return df.where(decoded(F.col("_metadata.file_path")).rlike(expression))


def _path_expression(root: str, prefix: str, pattern: str) -> str:
    """Expression for the files whose key matches, relative to the prefix or whole from the root."""
    body = _pattern(pattern)
    inside = f"{re.escape(prefix)}/" if prefix else ""
    return f"{below(root)}(?:{inside}(?s:{body})|(?={inside})(?s:{body}))$"


def business_date_filter(df: DataFrame, column: str, date: str) -> DataFrame:
    """Rows of one business date, whole days of times too; the test is typed and reaches the scan."""
    from millrace.functions.coerce import on_day
    from millrace.functions.tokens import iso_date

    return df.where(on_day(F.col(column), df.schema[column].dataType, iso_date(date)))


def row_limit(df: DataFrame, n: int | None, order_by: list | None = None) -> DataFrame:
    """The optional row limit of an extract."""
    if not n or n <= 0:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(n)
