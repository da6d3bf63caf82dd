"""Record sinks: JSON lines and message envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WITH_NULLS = {"ignoreNullFields": "false"}


def record_json(*cols: str | Column) -> Column:
    """One record as JSON text: nulls kept, nothing escaped beyond JSON's need."""
    return F.to_json(F.struct(*cols), _WITH_NULLS)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, one record a line, null fields written out."""
    df.write.mode(mode).options(**_WITH_NULLS, encoding="UTF-8").json(path)


def to_messages(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """``key, value`` rows for a queue: hash of the natural key, record as JSON.

    The key text is a JSON array, so ``("a", "bc")`` and ``("ab", "c")``
    differ.
    """
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in key_cols]))
    return df.select(F.sha2(key, 256).alias("key"), record_json(*df.columns).alias("value"))
