"""SQL that a database answers for a scan: splits planned from its own data, and filters and limits written into the query.

Nothing here opens a connection: ``ask`` sends a query and returns its few rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import re
import struct
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import types as T

Ask = Callable[[str], list]

SORTED = 100_000  # rows of an interval up to which the source numbers them one by one
PIVOTS = 64  # values, at most, between which the rows are counted in one pass
ROUNDS = 64  # passes after which intervals are numbered whatever their rows: only orders far from the values' own need so many
MOST = sys.float_info.max
BACKTICK = {"mysql", "impala", "spark"}  # dialects that quote names so, and take a backslash in a text as an escape


def name_sql(name: str, dialect: str) -> str:
    """A column name; plain ones stay as they are, since quotes may change what case they match."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        return name
    mark = "`" if dialect in BACKTICK else '"'
    return mark + name.replace(mark, mark * 2) + mark


def literal(value, dialect: str) -> str:
    """A value as SQL text that reads back as the same value."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, decimal.Decimal):
        return format(value, "f")  # an exponent would make it a floating-point number
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if math.isfinite(value):
            return repr(value)
        kind = "DOUBLE" if dialect in BACKTICK else "DOUBLE PRECISION"
        return f"CAST('{'NaN' if value != value else 'Infinity' if value > 0 else '-Infinity'}' AS {kind})"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    text = str(value)
    if dialect in BACKTICK:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + text.replace("'", "''") + "'"


def derived(query: str, condition: str | None = None, limit: int | None = None, dialect: str = "postgresql") -> str:
    """A query over a query, so that the source itself filters and stops."""
    inner = query.strip().rstrip("; \n")
    where = f" WHERE {condition}" if condition else ""
    if not limit or limit <= 0:
        return f"SELECT * FROM ({inner}) src{where}" if condition else inner
    if dialect == "sqlserver":
        return f"SELECT TOP {int(limit)} * FROM ({inner}) src{where}"
    stop = f"FETCH FIRST {int(limit)} ROWS ONLY" if dialect == "oracle" else f"LIMIT {int(limit)}"
    return f"SELECT * FROM ({inner}) src{where} {stop}"


def day_condition(column: str, kind: T.DataType, date: str, dialect: str) -> str | None:
    """Rows of one day, for date and time columns; nothing for others, whose text Spark has to read.

    Comparisons leave the column bare, so an index or partition of the source serves them.
    """
    day, name = dt.date.fromisoformat(date), name_sql(column, dialect)
    if isinstance(kind, T.DateType):
        return f"{name} = {literal(day, dialect)}"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        start = dt.datetime.combine(day, dt.time())
        return f"{name} >= {literal(start, dialect)} AND {name} < {literal(start + dt.timedelta(days=1), dialect)}"
    return None


def _tree(pivots: list[str], leaf: Callable[[int], str] = str, first: int = 0) -> str:
    """SQL that finds the interval between the pivots in which ``k`` lies, with as few comparisons as a search takes.

    A leaf is one interval in the source's own order, and leaves follow each
    other in that order, even if the source orders the pivots in another way.
    """
    if not pivots:
        return leaf(first)
    mid = len(pivots) // 2
    below, above = _tree(pivots[:mid], leaf, first), _tree(pivots[mid + 1 :], leaf, first + mid + 1)
    return f"CASE WHEN k < {pivots[mid]} THEN {below} ELSE {above} END"


def _equal(a, b) -> bool:
    return a == b or (a != a and b != b)  # NaN


def _place(x: float) -> int:
    """Where a number lies among all floating-point numbers, so that any range is halved in 64 steps."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & (1 << 63) - 1)


def _at_place(k: int) -> float:
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(k)))[0], k)


def _pivots(low, high, n: int) -> list:
    """Up to ``n`` different values above ``low``, of which ``high`` is the last; where they lie decides on speed only."""
    steps, found, ends = range(1, n), [], (low, high)
    if isinstance(low, float):
        low, high = (x if math.isfinite(x) else -MOST if x < 0 else MOST for x in ends)
        a, b = map(_place, (low, high))
        found = [low, *(low + (high / n - low / n) * k for k in steps[::2]), *(_at_place(a + (b - a) * k // n) for k in steps[::2]), high]
        return sorted({x for x in found if low <= x <= high})
    if isinstance(low, int) and not isinstance(low, bool):
        found = [low + (high - low) * k // n for k in steps]
    elif isinstance(low, decimal.Decimal):
        unit = decimal.Decimal(1).scaleb(min(low.as_tuple().exponent, high.as_tuple().exponent))
        whole, width = (int((x / unit).to_integral_value()) for x in (low, high - low))
        found = [(whole + width * k // n) * unit for k in steps]
    elif isinstance(low, dt.datetime):
        found = [low + (high - low) * k / n for k in steps]
    elif isinstance(low, dt.date):
        found = [low + (high - low) * k // n for k in steps]
    elif isinstance(low, str):
        same = len(os.path.commonprefix([low, high]))
        ends, base = [x[same : same + 4] for x in ends], 128
        if not all(map(str.isascii, ends)):
            ends, base = [x[:1] for x in ends], 0x110000
        size = max(map(len, ends))
        a, b = (reduce(lambda n, c: n * base + ord(c), x.ljust(size, "\x1f"), 0) for x in ends)
        numbers = [a + (b - a) * k // n for k in steps]
        texts = ["".join(chr(x // base**p % base) for p in reversed(range(size))) for x in numbers]
        texts = [re.match("[^\x00-\x1f\x7f\ud800-\udfff]*", x)[0] for x in texts]
        found = sorted({low[:same] + x for x in (*texts[: n - 2], ends[1][:1])})  # the latter splits by the first character that differs
    return list(dict.fromkeys([*(x for x in found if low < x < high), high]))


@dataclass
class _Interval:
    """Rows of a column from ``low`` to ``high``: how many, how many lie below, and which tiles begin among them."""

    low: object
    high: object
    rows: int
    below: int
    tiles: list[int]
    bare: bool = False  # cut at ``high`` only, which must cut it unless all its values are equal to the source


def starts_of_tiles(ask: Ask, query: str, column: str, n: int, dialect: str) -> list:
    """The lowest value of each of ``n`` tiles, of as many rows each, into which NTILE would cut a column.

    No task sorts the column: counts between pivots tell in which intervals the
    tiles begin, and those are cut further, all in one pass, until they have at
    most ``SORTED`` rows, which the source numbers. A source whose rows change
    meanwhile gives other tiles, but always in order.
    """
    c, inner = name_sql(column, dialect), query.strip().rstrip("; \n")
    whole = ask(f"SELECT MIN({c}) AS lo, MAX({c}) AS hi, COUNT({c}) AS n FROM ({inner}) src")[0]
    rows = int(whole["n"])
    if not rows:
        return []
    ranks = [rows // n * t + min(t, rows % n) for t in range(min(n, rows))]
    found = {0: whole["lo"]}

    def cut(parts: list[_Interval], tree: str) -> str:
        within = " OR ".join(f"({c} >= {literal(p.low, dialect)} AND {c} <= {literal(p.high, dialect)})" for p in parts)
        return f"SELECT k, {tree} AS t FROM (SELECT {c} AS k FROM ({inner}) src WHERE {within}) picked"

    def lows(parts: list[_Interval]) -> list[str]:
        return [literal(p.low, dialect) for p in parts[1:]]

    parts = [_Interval(whole["lo"], whole["hi"], rows, 0, list(range(1, len(ranks))))]
    for turn in range(ROUNDS + 1):
        for p in parts:
            if _equal(p.low, p.high):
                found.update(dict.fromkeys(p.tiles, p.low))
        parts = sorted((p for p in parts if p.tiles and not _equal(p.low, p.high)), key=lambda p: p.below)
        wide = [p for p in parts if p.rows > SORTED]
        if not wide or turn == ROUNDS:
            break
        each = max(4, PIVOTS // len(wide))
        pivots = [[p.high] if p.bare else _pivots(p.low, p.high, each) for p in wide]
        starts = list(accumulate((len(x) + 1 for x in pivots), initial=0))
        tree = _tree(lows(wide), lambda i: _tree([literal(x, dialect) for x in pivots[i]], first=starts[i]))  # noqa: B023
        got = {int(r["t"]): r for r in ask(f"SELECT t, MIN(k) AS lo, MAX(k) AS hi, COUNT(*) AS n FROM ({cut(wide, tree)}) cut GROUP BY t")}
        parts = [p for p in parts if p.rows <= SORTED]
        for k, p in enumerate(wide):
            below = p.below
            for r in (got[t] for t in range(starts[k], starts[k + 1]) if t in got):
                count = int(r["n"])
                tiles = [x for x in p.tiles if below <= ranks[x] < below + count]
                uncut = count == p.rows
                if tiles and uncut and p.bare:
                    found.update(dict.fromkeys(tiles, r["lo"]))
                else:
                    parts.append(_Interval(r["lo"], r["hi"], count, below, tiles, uncut))
                below += count
    if parts:
        numbered = f"SELECT k, t, ROW_NUMBER() OVER (PARTITION BY t ORDER BY k) AS place FROM ({cut(parts, _tree(lows(parts)))}) cut"
        wanted = " OR ".join(f"(t = {k} AND place IN ({', '.join(str(ranks[x] - p.below + 1) for x in p.tiles)}))" for k, p in enumerate(parts))
        got = {(int(r["t"]), int(r["place"])): r["k"] for r in ask(f"SELECT t, place, k FROM ({numbered}) numbered WHERE {wanted}")}
        found.update({x: got[at] for k, p in enumerate(parts) for x in p.tiles if (at := (k, ranks[x] - p.below + 1)) in got})
    out = []
    for x in range(len(ranks)):
        out.append(found[x] if x in found else out[-1])
    return out


def plan_splits(ask: Ask, query: str, column: str, n: int, dialect: str = "postgresql", tie: str | None = None) -> list[str]:
    """Conditions, one per task, of which every row meets exactly one.

    Borders are the source's own quantiles, so tasks get as many rows each
    however uneven the values are. A value that begins several tiles is split
    by the quantiles of ``tie`` within it; without ``tie`` it is one split.
    Rows without a value are a split of their own.
    """
    c = name_sql(column, dialect)
    starts = starts_of_tiles(ask, query, column, n, dialect)
    if not starts:
        return ["1 = 1"]
    borders = list(dict.fromkeys(starts))
    out = []
    for k, low in enumerate(borders):
        above = [f"{c} >= {literal(low, dialect)}"] if k else []
        below = [f"{c} < {literal(borders[k + 1], dialect)}"] if k + 1 < len(borders) else []
        full = sum(x == low for x in starts)
        if tie and full > 1:
            same = f"{c} = {literal(low, dialect)}"
            inner = plan_splits(ask, derived(query, same, dialect=dialect), tie, full + 1, dialect)
            out += [f"{same} AND ({x})" for x in inner]
            # Nothing is below the first border: the tiles hold the lowest value.
            above = [f"{c} > {literal(low, dialect)}"]
        out.append(" AND ".join(above + below) or f"{c} IS NOT NULL")
    return [*out, f"{c} IS NULL"]
