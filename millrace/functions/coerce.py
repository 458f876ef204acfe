"""Text and number forms of cells.

Pipeline conditions are written as text and compared with the text of a cell, as
Python's ``str`` would print it. The helpers here give that text, and compare a
typed column with a text value *without* casting the column wherever the type
allows it, so that the comparison still reaches the parquet or JDBC scan.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)

# Text that Python's float() accepts. Testing it first is also faster than a failing cast.
NUMBER_TEXT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"

NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

_CANONICAL_INT = re.compile(r"-?[1-9][0-9]*|0")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def never() -> Column:
    return F.lit(False)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def _float_text(col: Column) -> Column:
    """Python's ``repr`` of a float: positional from 1e-4 up to 1e16, else ``1e+16``."""
    raw = col.cast("string")  # of a FLOAT the shortest text of its own width, as in numpy
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(raw, r"^-?([0-9]+\.[0-9]+)E", 1)
    power = F.regexp_extract(raw, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    size = F.length(digits)
    whole = F.when(size <= power + 1, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(
        F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, size))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"),
    )
    return (
        F.when(F.isnan(col), "nan")
        .when(raw == "Infinity", "inf")
        .when(raw == "-Infinity", "-inf")
        .when(~raw.contains("E"), raw)
        .when((power >= 0) & (power < 16), F.concat(sign, whole))
        .when((power < 0) & (power >= -4), F.concat(sign, small))
        .otherwise(F.concat(sign, scientific))
    )


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """The text of a cell as Python prints it; null stays null."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, FRACTIONAL):
        return F.when(col.isNotNull(), _float_text(col))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(col, "SSSSSS")
        seconds = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    if isinstance(dtype, NESTED):
        return F.to_json(col)
    return col.cast("string")


def text_or_empty(col: Column, dtype: T.DataType) -> Column:
    """Text of a cell with null as ``''``: the rule of condition filters."""
    return F.coalesce(cell_text(col, dtype), F.lit(""))


def text_or_none(col: Column, dtype: T.DataType) -> Column:
    """Text of a cell with null as ``'None'``: the rule of plain filters and lookup keys."""
    return F.coalesce(cell_text(col, dtype), F.lit("None"))


def _python_float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _single(value: float) -> float:
    """The nearest value of single precision."""
    try:
        return struct.unpack("f", struct.pack("f", value))[0]
    except OverflowError:
        return math.copysign(math.inf, value)


def _single_text(value: float) -> str:
    """The shortest text that single precision reads back as ``value``."""
    short = (float(f"{value:.{n}g}") for n in range(1, 10))
    return repr(next((x for x in short if _single(x) == value), value))


def _decimal_value(dtype: T.DecimalType, text: str) -> tuple[bool, Decimal | None]:
    """The decimal that prints as ``text``; small numbers of more than six places print with an exponent."""
    if dtype.scale > 6:
        return False, None
    places = rf"\.[0-9]{{{dtype.scale}}}" if dtype.scale else ""
    if not re.fullmatch(rf"-?(0|[1-9][0-9]*){places}", text):
        return True, None
    value = Decimal(text)
    whole = len(text.lstrip("-").split(".")[0].lstrip("0"))
    fits = whole <= dtype.precision - dtype.scale and not (text.startswith("-") and not value)
    return True, value if fits else None


def text_literal(dtype: T.DataType, text: str):
    """The typed value whose text is exactly ``text``.

    ``(True, value)`` when one exists, ``(True, None)`` when no cell of the type
    can print as ``text``, ``(False, None)`` when only the text form can decide.
    """
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return True, text
    if is_integral(dtype):
        if not _CANONICAL_INT.fullmatch(text):
            return True, None
        value, bits = int(text), _BITS[type(dtype)]
        return True, value if -(2 ** (bits - 1)) <= value < 2 ** (bits - 1) else None
    if isinstance(dtype, T.BooleanType):
        return True, {"True": True, "False": False}.get(text)
    if isinstance(dtype, T.DoubleType):
        value = _python_float(text)
        if value is None or repr(value) != text:
            return True, None
        # 0.0 equals -0.0 and NaN has its own rule: leave both to the text form
        return (False, None) if value == 0 or math.isnan(value) else (True, value)
    if isinstance(dtype, T.FloatType):
        value = _python_float(text)
        if value is None or math.isnan(value) or value == 0:
            return value is None, None
        value = _single(value)
        return True, value if _single_text(value) == text else None
    if isinstance(dtype, T.DecimalType):
        return _decimal_value(dtype, text)
    if isinstance(dtype, T.DateType):
        try:
            value = dt.date.fromisoformat(text)
        except ValueError:
            return True, None
        return True, value if value.isoformat() == text else None
    if isinstance(dtype, T.TimestampNTZType):
        try:
            value = dt.datetime.fromisoformat(text)
        except ValueError:
            return True, None
        return True, value if str(value) == text and value.tzinfo is None else None
    return False, None


def _typed(dtype: T.DataType, value) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(str(value)).cast("timestamp_ntz")
    if isinstance(dtype, (T.FloatType, T.DecimalType)):
        return F.lit(value).cast(dtype)
    return F.lit(value)


def text_equals(col: Column, dtype: T.DataType, text: str) -> Column:
    """``str(cell) == text`` for the non-null cells; null cells give null or false."""
    if isinstance(dtype, T.TimestampType):
        # A local time may be there twice, so the text decides; bounds a day around it reach the scan.
        if text_literal(T.TimestampNTZType(), text)[1] is None:
            return never()
        here, day = F.lit(text).cast("timestamp"), F.expr("INTERVAL 1 DAY")
        return (col >= here - day) & (col <= here + day) & (cell_text(col, dtype) == text)
    decided, value = text_literal(dtype, text)
    if not decided:
        return cell_text(col, dtype) == text
    return never() if value is None else col == _typed(dtype, value)


def text_in(col: Column, dtype: T.DataType, options: list[str]) -> Column:
    """``str(cell) in options`` for the non-null cells."""
    found = [text_literal(dtype, o) for o in options]
    if not all(decided for decided, _ in found):
        return cell_text(col, dtype).isin(options)
    values = [v for _, v in found if v is not None]
    return col.isin([_typed(dtype, v) for v in values]) if values else never()


def number(col: Column, dtype: T.DataType) -> Column:
    """A cell as a double, or null where it is not a number.

    Text such as ``' 12 '`` or ``'1e3'`` counts; Java's ``'1d'`` and ``'1f'`` do not.
    """
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return col.cast("double")
    if not isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return F.lit(None).cast("double")
    return F.when(col.rlike(NUMBER_TEXT), col.try_cast("double"))


def on_day(col: Column, dtype: T.DataType, day: str) -> Column:
    """Whether a date, time or text cell lies on an ISO day. Times are tested by bounds, which reach the scan."""
    start = F.lit(day).cast("date")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return (col >= start.cast(dtype)) & (col < F.date_add(start, 1).cast(dtype))
    return col == F.lit(day).cast(dtype)


def compare_number(col: Column, dtype: T.DataType, op: str, text: str) -> Column:
    """``float(cell) op float(text)``; anything that is no number gives false."""
    bound = _python_float(text)
    if bound is None or math.isnan(bound):
        return never()
    if is_integral(dtype):
        if math.isinf(bound):
            holds = (bound < 0) == (op in (">", ">="))
            return col.isNotNull() if holds else never()
        # Compare integers with integers: casting the column would hide it from the scan.
        edge = {">": math.floor, ">=": math.ceil, "<": math.ceil, "<=": math.floor}[op](bound)
        if not -(2**63) <= edge < 2**63:
            return col.isNotNull() if (edge < 0) == (op in (">", ">=")) else never()
        return _compare(col, op, F.lit(edge))
    if isinstance(dtype, FRACTIONAL):
        test = _compare(col, op, F.lit(bound))
        return test & ~F.isnan(col) if op in (">", ">=") else test
    if isinstance(dtype, T.DecimalType):
        return _beside(col, dtype, op, bound) & _compare(col.cast("double"), op, F.lit(bound))
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        value = number(F.regexp_replace(col, r"(?<=[0-9])_(?=[0-9])", ""), T.StringType())
        return F.coalesce(_compare(value, op, F.lit(bound)) & ~F.isnan(value), never())
    return never()


def _beside(col: Column, dtype: T.DecimalType, op: str, bound: float) -> Column:
    """A decimal bound that all cells within the double ``bound`` keep; unlike a cast of the column it reaches the scan."""
    up = op in (">", ">=")
    near = math.nextafter(bound, -math.inf if up else math.inf)  # a cell may round to the bound
    if math.isinf(near):
        return F.lit(True)
    with localcontext(prec=400, rounding=ROUND_FLOOR if up else ROUND_CEILING):
        value = Decimal(near).quantize(Decimal(1).scaleb(-dtype.scale))
    if value.adjusted() >= dtype.precision - dtype.scale:
        return F.lit(True)
    return _compare(col, ">=" if up else "<=", F.lit(value).cast(dtype))


def _compare(left: Column, op: str, right: Column) -> Column:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
