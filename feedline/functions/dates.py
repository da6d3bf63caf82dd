"""Sortable file dates: 14-digit strings compared as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the publishers write dates into file and page names.
FIRST = r"([0-9]{8}-[0-9]{6})"
ANCHORED = r"([0-9]{8})-([0-9]{6})\.gz$"
TOLERANT = r"(?<![0-9])(20[0-9]{6})(?:[-_]?([0-9]{6}|[0-9]{4}))?(?![0-9])"
DAY = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"


def file_date(col: Column, mode: str = "first") -> Column:
    """``YYYYMMDDHHMMSS`` found in a name or link, null when there is none.

    * ``first``: the first ``YYYYMMDD-HHMMSS``;
    * ``anchored``: only right before a final ``.gz``, so a chain id is never
      read as a date;
    * ``tolerant``: the last day starting ``20`` not adjacent to a digit, with
      an optional 4- or 6-digit time; missing time digits are zeros.
    """
    if mode == "first":
        return F.nullif(F.replace(F.regexp_extract(col, FIRST, 1), F.lit("-"), F.lit("")), F.lit(""))
    if mode == "anchored":
        found = F.concat(F.regexp_extract(col, ANCHORED, 1), F.regexp_extract(col, ANCHORED, 2))
        return F.nullif(found, F.lit(""))
    if mode == "tolerant":
        pattern = F.lit(TOLERANT)
        days = F.regexp_extract_all(col, pattern, F.lit(1))
        times = F.regexp_extract_all(col, pattern, F.lit(2))
        last = F.size(days) - 1
        return F.rpad(F.concat(F.get(days, last), F.get(times, last)), 14, "0")
    raise ValueError(f"unknown date mode {mode!r}")


def day_date(name: Column) -> Column:
    """``YYYYMMDD`` of a day page named ``YYYY-MM-DD``."""
    return F.nullif(F.replace(F.regexp_extract(name, DAY, 0), F.lit("-"), F.lit("")), F.lit(""))


def normalize_mark(col: Column) -> Column:
    """Bring a mark of 8, 12 or 14 digits to 14 digits.

    Null and empty become null; any other length raises at run time.
    """
    digits = F.regexp_replace(col, r"[^0-9]", "")
    return (
        F.when(col.isNull() | (col == ""), F.lit(None).cast("string"))
        .when(F.length(digits).isin(8, 12, 14), F.rpad(digits, 14, "0"))
        .otherwise(F.raise_error(F.concat(F.lit("mark needs 8, 12 or 14 digits: "), col)).cast("string"))
    )
