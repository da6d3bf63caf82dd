"""Keep one row per key.

These are aggregations, not windows: the partial step before the shuffle
already reduces the copies of a hot key to one row per task, so a key that
holds a large part of all rows never reaches a single task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranked = F.struct(*order, *rest)
    kept = df.groupBy(*keys).agg(pick(ranked).alias("_row"))
    return kept.select(
        *[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    )


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row lowest in ``order`` per key; the other columns break ties."""
    return _pick(df, keys, order, F.min)


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row highest in ``order`` per key (null orders lose); ties by the other columns."""
    return _pick(df, keys, order, F.max)


def dedup_pages(listing: DataFrame, key: str = "href") -> DataFrame:
    """Per source and link keep the rows of its first page.

    Copies within that page all stay, so this is a semi join against the
    first page of each link.
    """
    first = listing.groupBy("source", key).agg(F.min("page").alias("page"))
    return listing.join(first, ["source", key, "page"], "left_semi")
