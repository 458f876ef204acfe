"""Readers for the source nodes of a graph, bound to named connections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.context import RunContext
from millrace.plans.graph import Reader
from millrace.plans.transforms import read_table, sql_template
from millrace.sources import files
from millrace.sources.jdbc import JdbcConnection, Split, scan_jdbc
from millrace.sources.objectstore import ObjectStore


def _named(table: Mapping, name, kind: str):
    if str(name) not in table:
        raise ValueError(f"{kind} {name} is not there")
    return table[str(name)]


def standard_readers(
    databases: Mapping[str, JdbcConnection] | None = None,
    stores: Mapping[str, ObjectStore] | None = None,
    stored_sql: Mapping[str, str] | None = None,
    sources_dir: str = "",
) -> dict[str, Reader]:
    """One reader per source node type; node configs refer to connections and stored SQL by id."""

    def jdbc(spark: SparkSession, config: dict, ctx: RunContext) -> DataFrame:
        split = config.get("split")
        return scan_jdbc(
            spark,
            _named(databases or {}, config.get("connection_id"), "connection"),
            sql=config.get("sql"),
            stored_sql=_named(stored_sql or {}, config["sql_file_id"], "stored SQL") if config.get("sql_file_id") else None,
            table=config.get("table"),
            business_date=ctx.business_date,
            app_id=ctx.app_id,
            app_name=ctx.app_name,
            date_format=config.get("date_format") or ctx.date_format,
            date_mode=ctx.date_mode,
            date_from=ctx.range_from,
            date_to=ctx.range_to,
            date_column=config.get("date_column"),
            limit=config.get("limit"),
            split=Split(**split) if split else None,
        )

    def store(spark: SparkSession, config: dict, ctx: RunContext) -> DataFrame:
        place = _named(stores or {}, config.get("connection_id"), "object store")
        prefix, pattern = ctx.render(config.get("prefix") or ""), ctx.render(config.get("pattern") or "*")
        csv = {"csv_sep": config.get("csv_sep") or ",", "csv_header": config.get("csv_header", True)}
        df = place.scan(spark, prefix, pattern, config.get("format") or "auto", schema=config.get("schema"), **csv)
        sql = ctx.render(config.get("transform_sql") or "").strip()
        return sql_template(df, sql) if sql else df

    def path(config: dict, ctx: RunContext) -> str:
        return "/".join(p for p in (sources_dir.rstrip("/"), ctx.render(config["file_path"])) if p)

    def csv(spark: SparkSession, config: dict, ctx: RunContext) -> DataFrame:
        return files.scan_csv(
            spark,
            path(config, ctx),
            sep=config.get("csv_delimiter") or ",",
            header=config.get("csv_has_header", True),
            encoding=config.get("file_encoding") or "utf-8",
            schema=config.get("schema"),
        )

    def json(spark: SparkSession, config: dict, ctx: RunContext) -> DataFrame:
        encoding = config.get("file_encoding") or "utf-8"
        return files.scan_json(spark, path(config, ctx), config.get("json_lines", True), config.get("schema"), encoding)

    def table(spark: SparkSession, config: dict, ctx: RunContext) -> DataFrame:
        return read_table(spark, ctx.render(config["table"]), config.get("database") or ctx.namespace)

    return {
        "jdbc_extract": jdbc,
        "impala_extract": jdbc,
        "s3_extract": store,
        "csv_extract": csv,
        "json_extract": json,
        "table_extract": table,
    }
