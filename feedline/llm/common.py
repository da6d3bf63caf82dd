"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.session import new_scratch

# Bytes of text a Python task looks at in one go; longer texts make a slice of their own.
SLICE_BYTES = 4 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of ``column``, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def keyed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id``, ``text_key`` and, if asked for, ``text`` with null as empty.

    Rows are told apart by id and text hash: rows equal in both are one
    document and get the same result, rows that only share an id do not mix.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [body.alias("text")] if keep else []
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_key"), *kept)


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def uri(folder: str) -> str:
    """The folder as a URI: a plain path is a local one."""
    return folder if ":" in folder.split("/")[0] else f"file://{folder}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends there."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
