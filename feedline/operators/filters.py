"""Which listed files are wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedline.functions.urls import url_host

# The full-snapshot report types and categories.
WANTED_PREFIXES = ("PriceFull", "PromoFull")
WANTED_FILE_TYPES = ("pricefull", "promofull")
WANTED_CATEGORIES = (2, 4)


def has_prefix(fname: Column, prefixes: tuple[str, ...] = WANTED_PREFIXES) -> Column:
    """The name starts with a report type, case-sensitively; null does not."""
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | fname.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def wanted_entry(
    fname: Column,
    file_type: Column,
    prefixes: tuple[str, ...] = WANTED_PREFIXES,
    file_types: tuple[str, ...] = WANTED_FILE_TYPES,
) -> Column:
    """Report type by name or by stated type; a blank name is never wanted."""
    name = F.coalesce(fname, F.lit(""))
    stated = F.lower(F.coalesce(file_type, F.lit("")))
    return (has_prefix(name, prefixes) | stated.isin(*file_types)) & (F.trim(name) != "")


def full_snapshot(category: Column, categories: tuple[int, ...] = WANTED_CATEGORIES) -> Column:
    """The category holds full snapshots."""
    return category.isin(*categories)


def is_file(row_type: Column) -> Column:
    """The listing row is a file; a row without a type is not."""
    return F.coalesce(row_type == "file", F.lit(False))


def on_host(url: Column, host: str) -> Column:
    """The link points to exactly this host."""
    return url_host(url) == host
