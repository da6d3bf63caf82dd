"""Repeated HTML blocks into rows.

A page is read where it stands, in one pass with a stack of open elements, by an
Arrow-batched function: the markup goes to no other task, and neither does a page's
key.  A page must fit in a task.

A block spec is a plain dict::

    {"block": {"tag": "div", "class": "job-box"},
     "fields": {
         "title": {"within": {"tag": "div", "class_prefix": "head"}, "tag": "h2"},
         "company": {"class": "T14"},
         "location": {"class_any": ["loc-a", "loc-b"]},
         "tags": {"tag": "a", "class": "tag", "all": True}}}

Selectors combine ``tag``, ``class``, ``class_any`` and ``class_prefix``.  A
field is the text of the first matching element inside the block; with
``all`` the texts of all of them, as an array; with ``{"self": True}`` the
text of the block itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from feedline.functions.page_blocks import page_blocks


def extract_blocks(pages: DataFrame, key: str, html: str, spec: dict) -> DataFrame:
    """One row per block in document order; a block inside a block is its own row.

    Result: ``key, block`` (number of the block in its page, from 1) and one
    column per field; null where no element matches, empty where it has no
    text.  A page without blocks, or without markup, gives no row.
    """
    fields = spec["fields"]
    kind = {n: ArrayType(StringType()) if f.get("all") else StringType() for n, f in fields.items()}
    result = ArrayType(StructType([StructField(n, t) for n, t in kind.items()]))
    shape = to_arrow_type(result)

    @F.arrow_udf(result)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([page_blocks(t.as_py(), spec) for t in texts], shape)

    listed = pages.select(key, F.posexplode(found(F.col(html))).alias("_at", "_block"))
    return listed.select(key, (F.col("_at") + 1).cast("bigint").alias("block"), "_block.*")


def merge_detail(summary: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Detail fields added to the summary row of the same key.

    Summary rows without detail stay; a field both have comes from the
    summary where it is not null.
    """
    shared = [c for c in detail.columns if c in summary.columns and c != key]
    added = [c for c in detail.columns if c not in summary.columns]
    renamed = detail.select(key, *[F.col(c).alias(f"_d_{c}") for c in shared], *added)
    joined = summary.join(renamed, key, "left")
    kept = [F.coalesce(c, f"_d_{c}").alias(c) if c in shared else F.col(c) for c in summary.columns]
    return joined.select(*kept, *added)


def first_pages(rows: DataFrame, last: int, page: str = "page") -> DataFrame:
    """Only the first pages of a paged listing."""
    return rows.where(F.col(page) <= last)
