"""Validation, lookup tables and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedline.functions.enrich import text_hash
from feedline.operators.dedup import dedup_first, dedup_last

PRICE_KEY = ["superProvider", "storeId", "itemCode"]
PRICE_ORDER = ["updateTime", "file", "pos"]

PRODUCT_COLUMNS = ("itemName", "itemDescription", "manufactureName", "manufactureCountry")


def message_outcomes(messages: DataFrame, schema: str, keys: list[str], col: str = "value") -> DataFrame:
    """Messages as typed rows with a ``reason``, from one parse.

    A message is rejected when it is no JSON object or lacks part of its natural
    key: its typed columns are null, ``reason`` says why, and the column ``message``
    has the raw text.  Both are null, but for the typed columns, where it is loaded.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = messages.withColumn("_m", F.from_json(col, f"{schema}, _corrupt STRING", options))
    reason = F.when(F.col("_m").isNull() | F.col("_m._corrupt").isNotNull(), "no JSON object")
    for key in keys:
        blank = F.coalesce(F.col(f"_m.{key}").cast("string"), F.lit("")) == ""
        reason = reason.when(blank, f"no {key}")
    told = parsed.withColumn("reason", reason)
    read = F.when(F.col("reason").isNull(), F.col("_m"))
    raw = F.when(F.col("reason").isNotNull(), F.col(col))
    return told.select(read.alias("_m"), "reason", raw.alias("message")).select("_m.*", "reason", "message").drop("_corrupt")


def decode_messages(
    messages: DataFrame, schema: str, keys: list[str], col: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Messages as typed rows, and the raw messages that cannot be loaded.

    A message is rejected when it is no JSON object or lacks part of its
    natural key.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = messages.withColumn("_m", F.from_json(col, f"{schema}, _corrupt STRING", options))
    good = F.col("_m").isNotNull() & F.col("_m._corrupt").isNull()
    for key in keys:
        good = good & F.coalesce(F.col(f"_m.{key}").cast("string") != "", F.lit(False))
    marked = parsed.withColumn("_good", good)
    valid = marked.where("_good").select("_m.*").drop("_corrupt")
    return valid, marked.where(~F.col("_good")).drop("_m", "_good")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One current row per key, the newest by ``order`` wins.

    Applying the same batch again changes nothing.
    """
    return dedup_last(current.unionByName(batch, allowMissingColumns=True), keys, order)


def insert_new(
    current: DataFrame, batch: DataFrame, key: str = "quote_hash", order: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of ``batch`` to add: first of each key, keys already stored ignored.

    Rows without a key are rejected.
    """
    first = dedup_first(batch.where(F.col(key).isNotNull()), [key], list(order))
    return first.join(current.select(key), key, "left_anti").select(*batch.columns)


def rescrape(
    current: DataFrame,
    batch: DataFrame,
    policy: str = "insert",
    identity: tuple[str, ...] = ("source_url", "author", "pos"),
    order: tuple[str, ...] = ("scraped",),
) -> DataFrame:
    """The table after a re-scrape in which texts may have changed.

    ``insert``: a changed text is a new row next to the old one, unchanged
    texts stay as stored.  ``update``: the row of the same place on the same
    page takes the newest text.
    """
    if policy == "update":
        return upsert(current, batch, list(identity), list(order))
    if policy == "insert":
        hashed = batch if "quote_hash" in batch.columns else batch.withColumn("quote_hash", text_hash(F.col("text")))
        return current.unionByName(insert_new(current, hashed, order=order))
    raise ValueError(f"unknown policy {policy!r}")


def stores(prices: DataFrame) -> DataFrame:
    """Lookup table of stores."""
    return prices.select("superProvider", "storeId").distinct()


def products(prices: DataFrame, order: tuple[str, ...] = ("updateTime",)) -> DataFrame:
    """Lookup table of products, attributes from each item's newest record."""
    return dedup_last(
        prices.where(F.col("itemCode").isNotNull()).select(*order, "itemCode", *PRODUCT_COLUMNS),
        ["itemCode"],
        list(order),
    ).select("itemCode", *PRODUCT_COLUMNS)
