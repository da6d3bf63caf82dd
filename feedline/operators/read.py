"""The read queries over the loaded tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.functions.enrich import tokens
from feedline.operators.buckets import BUCKETS, merge, read_keys


def _page(df: DataFrame, order: list[str], limit: int | None, offset: int) -> DataFrame:
    """A sorted page; with a limit Spark keeps only limit + offset rows per task."""
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def list_quotes(
    quotes: DataFrame,
    author: str | None = None,
    tag: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    after: int | None = None,
) -> DataFrame:
    """Quotes by author and/or tag, paginated by id.

    ``after`` (last id of the page before) seeks by key, at the same cost for
    every page; ``offset`` has to sort past all rows skipped.
    """
    wanted = quotes
    if author is not None:
        wanted = wanted.where(F.col("author") == author)
    if tag is not None:
        wanted = wanted.where(F.array_contains("tags", tag))
    if after is not None:
        wanted = wanted.where(F.col("id") > after)
    return _page(wanted, ["id"], limit, offset)


def get_quote(quotes: DataFrame, quote_id: int) -> DataFrame:
    """The quote with this id, if any."""
    return quotes.where(F.col("id") == quote_id)


def quote_stats(quotes: DataFrame) -> DataFrame:
    """Average word count and number of quotes."""
    return quotes.agg(F.avg("word_count").alias("avg_word_count"), F.count(F.lit(1)).alias("n_quotes"))


def top_authors(quotes: DataFrame, n: int = 3) -> DataFrame:
    """Authors with the most quotes, by name where equal."""
    counted = quotes.groupBy("author").agg(F.count(F.lit(1)).alias("n_quotes"))
    return counted.orderBy(F.desc("n_quotes"), "author").limit(n)


def _query_tokens(query: str) -> list[str]:
    bare = (re.sub(r"^[\W_]+|[\W_]+$", "", word).lower() for word in query.split())
    return sorted({word for word in bare if word})


def search(quotes: DataFrame, query: str, limit: int | None = None, text: str = "text") -> DataFrame:
    """Quotes that hold every query word, most hits first, then by id."""
    wanted = _query_tokens(query)
    if not wanted:
        return quotes.where(F.lit(False)).withColumn("hits", F.lit(0).cast("bigint"))
    # A cheap look for the raw letters first; only what passes is matched by word.
    lowered = F.lower(F.col(text))
    near = reduce(lambda a, b: a & b, [lowered.contains(word) for word in wanted])
    listed = quotes.where(near).withColumn("_tokens", tokens(F.col(text)))
    each = [F.array_contains("_tokens", word) for word in wanted]
    hits = F.size(F.filter("_tokens", lambda t: t.isin(*wanted))).cast("bigint")
    # As a generated column, so that the filter does not list the words again.
    ranked = listed.withColumn(
        "hits", F.explode_outer(F.array(F.when(reduce(lambda a, b: a & b, each), hits)))
    )
    found = ranked.where(F.col("hits").isNotNull()).drop("_tokens")
    ordered = found.orderBy(F.desc("hits"), "id")
    return ordered if limit is None else ordered.limit(limit)


def inverted_index(quotes: DataFrame, text: str = "text") -> DataFrame:
    """``token, id, hits``: which quote holds a word how often.

    Written partitioned or bucketed by ``token`` it serves repeated searches
    without reading the texts.
    """
    occurrences = quotes.select("id", F.explode(tokens(F.col(text))).alias("token"))
    return occurrences.groupBy("token", "id").agg(F.count(F.lit(1)).alias("hits"))


def search_index(index: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """:func:`search` over a stored index: ``id, hits``."""
    wanted = _query_tokens(query)
    found = (
        index.where(F.col("token").isin(*wanted))
        .groupBy("id")
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("_n"))
    )
    ordered = found.where(F.col("_n") == len(wanted)).drop("_n").orderBy(F.desc("hits"), "id")
    return ordered if limit is None else ordered.limit(limit)


def update_index(quotes: DataFrame, path: str, text: str = "text", buckets: int = BUCKETS) -> int:
    """Add a batch of quotes to the stored index at ``path``, made where there is none; returns its version.

    A quote's text never changes under its id, so a batch that comes again changes
    nothing.  Only the buckets of the batch's tokens are rewritten.
    """
    return merge(inverted_index(quotes, text), path, ["token", "id"], [], buckets=buckets, within=["token"])


def search_stored(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """:func:`search_index` over the stored index; reads the buckets of the query's tokens only."""
    return search_index(read_keys(spark, path, _query_tokens(query)), query, limit)


def sentiment_by_lexicon(texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, sentiment_score`` by a lexicon table ``word, weight`` of any size.

    Spark broadcasts the lexicon where its size allows, so only the hits and
    one zero per text are shuffled.
    """
    words = texts.select(key, F.explode(tokens(F.col(text))).alias("word"))
    hits = words.join(lexicon, "word").select(key, F.col("weight").cast("bigint").alias("weight"))
    zeros = texts.select(key, F.lit(0).cast("bigint").alias("weight"))
    return hits.union(zeros).groupBy(key).agg(F.sum("weight").alias("sentiment_score"))


def list_stores(stores: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Stores sorted by chain and store."""
    return _page(stores, ["superProvider", "storeId"], limit, offset)


def get_product(products: DataFrame, code: str) -> DataFrame:
    """The product with this item code; the filter reaches below the aggregation."""
    return products.where(F.col("itemCode") == code)


def list_prices(
    prices: DataFrame,
    chain: str | None = None,
    store: str | None = None,
    item: str | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Current prices filtered by any part of their key, sorted by it."""
    wanted = prices
    for column, value in (("superProvider", chain), ("storeId", store), ("itemCode", item)):
        if value is not None:
            wanted = wanted.where(F.col(column) == value)
    return _page(wanted, ["superProvider", "storeId", "itemCode"], limit, offset)
