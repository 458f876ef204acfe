"""Compare a Spark result with DuckDB's answer on the same parquet files."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "HUGEINT": "decimal(38,0)",
}


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def rows_of(records, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(_cell(r[i]) for i in order) for r in records]
    return sorted(found, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Every way in which the two results differ; empty when they agree."""
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    theirs = rows_of(cursor.fetchall(), names)
    ours = rows_of([tuple(r) for r in df.collect()], df.columns)
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, dtype in df.dtypes:
        if TYPES.get(types[name], types[name]) != dtype:
            found.append(f"type of {name}: {dtype} != {types[name]}")
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    elif ours != theirs:
        pairs = [(a, b) for a, b in zip(ours, theirs) if a != b]
        found.append(f"{len(pairs)} rows differ, first {pairs[0]}")
    if not theirs:
        found.append("empty result proves nothing")
    return found
