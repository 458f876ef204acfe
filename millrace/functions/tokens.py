"""Names: path tokens, view names and namespaces, as text and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DEFAULT_NAMESPACE_PREFIX = "data_"


def compact_date(text: str) -> str:
    """``2026-04-16`` or ``2026/04/16`` to ``20260416``."""
    return re.sub(r"[-/]", "", text)


def iso_date(text: str) -> str:
    """Eight digits, with or without separators, to ISO; other text stays."""
    digits = compact_date(text)
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:]}" if len(digits) == 8 else text


#: Naming rules (fixed values): a token keeps the words of ASCII letters and digits, joined by underscores, in upper
#: case; a view's name is its folder in lower case, with an underscore for all that is no ASCII letter, digit or underscore.
TOKEN_WORD = "([A-Za-z0-9]+)"
VIEW_BREAK = r"\W"


def path_token(text: str | None, fallback: str) -> str:
    """Upper-case token of letters and digits, safe as a folder name."""
    return "_".join(re.findall(TOKEN_WORD, text or "")).upper() or fallback


def view_name(date: str, job: str, app_id: str = "") -> str:
    """Name of the view of one dataset folder."""
    folder = "/".join((f"{date}__{job}", app_id))
    return re.sub(VIEW_BREAK, "_", folder, flags=re.ASCII).lower()


def folder_name(text: str) -> str:
    """One step of a path: ASCII letters, digits, dashes and underscores."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "_" for c in text)


def namespace_name(business_date: str | None, prefix: str | None = None, db_name: str | None = None) -> str | None:
    """Database of a business date: a fixed name, or prefix and date. No prefix means ``data_``; an empty one stays."""
    if db_name:
        return db_name
    if not business_date:
        return None
    return f"{DEFAULT_NAMESPACE_PREFIX if prefix is None else prefix}{compact_date(business_date)}"


def compact_date_col(col: Column) -> Column:
    return F.regexp_replace(col, "[-/]", "")


def iso_date_col(col: Column) -> Column:
    digits = compact_date_col(col)
    iso = F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2))
    return F.when(F.length(digits) == 8, iso).otherwise(col)


def path_token_col(col: Column, fallback: str) -> Column:
    token = F.upper(F.array_join(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN_WORD), F.lit(1)), "_"))
    return F.when(token == "", F.lit(fallback)).otherwise(token)


def view_name_col(date: Column, job: Column, app_id: Column) -> Column:
    folder = F.concat(date, F.lit("__"), job, F.lit("/"), F.coalesce(app_id, F.lit("")))
    return F.lower(F.regexp_replace(folder, VIEW_BREAK, "_"))


def namespace_col(date: Column, prefix: str | None = None) -> Column:
    text = F.date_format(date, "yyyyMMdd")
    return F.concat(F.lit(DEFAULT_NAMESPACE_PREFIX if prefix is None else prefix), text)


def random_id(seed: int | None = None, upper: int = 1_000_000_000) -> Column:
    """A random integer from 0 up to ``upper``."""
    return (F.rand(seed) * upper).cast("long")
