"""Queries of the load step, the enrichment and the read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedline.functions import enrich
from feedline.functions.text import iso_ts
from feedline.operators import buckets, load, prices, read
from feedline.operators.dedup import dedup_last
from feedline.plans import expected as E
from feedline.plans import rendering as R
from feedline.plans.feeds import price_feed
from feedline.plans.registry import query
from feedline.session import new_scratch


def price_rows(spark, sf_dir):
    """Every line item as a price record, many per key."""
    lines = R.table(spark, sf_dir, "lineitem")
    part = R.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("c"), R.text(F.col("l_suppkey") % 5)).alias("superProvider"),
        R.text("l_suppkey").alias("storeId"),
        R.item_code("l_partkey").alias("itemCode"),
        F.col("p_name").alias("itemName"),
        F.col("p_type").alias("itemDescription"),
        F.col("p_brand").alias("manufactureName"),
        F.concat(F.lit("N"), R.text(F.col("l_quantity").cast("int"))).alias("manufactureCountry"),
        F.col("l_extendedprice").alias("price"),
        iso_ts(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("updateTime"),
        R.text("l_orderkey").alias("file"),
        F.col("l_linenumber").alias("pos"),
    )


PRICES = """
price_rows AS (
  SELECT 'c' || (l_suppkey % 5) AS "superProvider", CAST(l_suppkey AS VARCHAR) AS "storeId",
         lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS "itemCode", p_name AS "itemName", p_type AS "itemDescription",
         p_brand AS "manufactureName", 'N' || CAST(l_quantity AS INTEGER) AS "manufactureCountry",
         l_extendedprice AS price, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "updateTime",
         CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey),
prices AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY "superProvider", "storeId", "itemCode"
      ORDER BY "updateTime" DESC, file DESC, pos DESC, "itemName" DESC, "itemDescription" DESC,
               "manufactureName" DESC, "manufactureCountry" DESC, price DESC) AS rn
    FROM price_rows)
  WHERE rn = 1)"""


def current_prices(spark, sf_dir):
    """The prices table after every batch, as the loader keeps it."""
    rows = price_rows(spark, sf_dir)
    even = F.col("file").cast("bigint") % 2 == 0
    return load.upsert(rows.where(even), rows.where(~even), load.PRICE_KEY, load.PRICE_ORDER)


@query(
    "lod_01_decode_messages",
    """
    SELECT event_id, user_id, event_type, value AS amount, false AS rejected FROM events
    WHERE event_id % 50 <> 49 AND event_type <> 'error'
    UNION ALL
    SELECT event_id, NULL, NULL, NULL, true FROM events WHERE event_id % 50 = 49 OR event_type = 'error'""",
)
def decode_messages(spark, sf_dir):
    # Errors come without their type, which is part of the key here.
    messages = R.event_messages(spark, sf_dir).withColumn(
        "value", F.regexp_replace("value", '"event_type":"error",', "")
    )
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING, amount DOUBLE"
    valid, rejected = load.decode_messages(messages, schema, ["event_id", "event_type"])
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("user_id", "bigint"), ("event_type", "string"), ("amount", "double"))]
    return valid.select("event_id", "user_id", "event_type", "amount", F.lit(False).alias("rejected")).union(
        rejected.select("event_id", *empty, F.lit(True).alias("rejected"))
    )


@query("lod_02_upsert_prices", f"WITH {PRICES} SELECT * FROM prices")
def upsert_prices(spark, sf_dir):
    return current_prices(spark, sf_dir)


@query("lod_02_bucketed_upsert", f"WITH {PRICES} SELECT * FROM prices")
def bucketed_upsert(spark, sf_dir):
    path = new_scratch(spark, "prices")
    rows = price_rows(spark, sf_dir)
    # The last batch comes a second time.
    for part in (0, 1, 2, 2):
        batch = rows.where(F.col("file").cast("bigint") % 3 == part)
        buckets.merge(batch, path, load.PRICE_KEY, load.PRICE_ORDER, buckets=8)
        # Nobody else reads this table, so the version before is not needed any more.
        buckets.sweep(spark, path, grace=0)
    return buckets.read_table(spark, path)


@query("lod_03_stores", """SELECT DISTINCT 'c' || (l_suppkey % 5) AS "superProvider", CAST(l_suppkey AS VARCHAR) AS "storeId" FROM lineitem""")
def stores(spark, sf_dir):
    return load.stores(price_rows(spark, sf_dir))


PRODUCTS = f"""
{PRICES},
products AS (
  SELECT "itemCode", "itemName", "itemDescription", "manufactureName", "manufactureCountry" FROM (
    SELECT *, row_number() OVER (PARTITION BY "itemCode" ORDER BY "updateTime" DESC, "itemName" DESC,
      "itemDescription" DESC, "manufactureName" DESC, "manufactureCountry" DESC) AS rn FROM price_rows)
  WHERE rn = 1)"""


@query("lod_04_products", f"WITH {PRODUCTS} SELECT * FROM products")
def products(spark, sf_dir):
    return load.products(price_rows(spark, sf_dir))


def quotes(spark, sf_dir):
    """Documents as quotes: author, tags and the derived columns."""
    text = F.col("text")
    return R.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("author"), F.array("lang").alias("tags"), *enrich.enriched(text)
    )


_HASH = f"sha256({E.trimmed('text')})"


@query(
    "lod_05_insert_quotes",
    f"""
    WITH q AS (SELECT doc_id AS id, {_HASH} AS quote_hash FROM documents),
    stored AS (SELECT * FROM q WHERE id % 3 = 0)
    SELECT min(id) AS id, quote_hash FROM q WHERE quote_hash NOT IN (SELECT quote_hash FROM stored) GROUP BY quote_hash""",
)
def insert_quotes(spark, sf_dir):
    rows = quotes(spark, sf_dir).select("id", "quote_hash")
    return load.insert_new(rows.where(F.col("id") % 3 == 0), rows, order=("id",))


@query("lod_06_text_hash", f"SELECT doc_id, {_HASH} AS quote_hash FROM documents")
def text_hash(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", enrich.text_hash(F.col("text")).alias("quote_hash"))


def _scrapes(spark, sf_dir):
    rows = R.table(spark, sf_dir, "conversations").select(
        R.text("conv_id").alias("source_url"),
        F.col("role").alias("author"),
        (F.col("turn") % 2).alias("pos"),
        F.col("turn").alias("scraped"),
        "text",
        enrich.text_hash(F.col("text")).alias("quote_hash"),
    )
    return rows.where(F.col("scraped") < 2), rows.where(F.col("scraped") >= 2)


@query(
    "lod_07_rescrape_update",
    f"""
    SELECT source_url, author, scraped, {_HASH} AS quote_hash FROM (
      SELECT CAST(conv_id AS VARCHAR) AS source_url, role AS author, turn AS scraped, text,
             row_number() OVER (PARTITION BY conv_id, role, turn % 2 ORDER BY turn DESC) AS rn FROM conversations)
    WHERE rn = 1""",
)
def rescrape_update(spark, sf_dir):
    stored, batch = _scrapes(spark, sf_dir)
    return load.rescrape(stored, batch, policy="update").select("source_url", "author", "scraped", "quote_hash")


@query(
    "lod_07_rescrape_insert",
    f"""
    WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS source_url, turn AS scraped, {_HASH} AS quote_hash FROM conversations)
    SELECT quote_hash, count(*) AS n, min(scraped) AS first_scraped FROM (
      SELECT quote_hash, scraped FROM c WHERE scraped < 2
      UNION ALL
      SELECT quote_hash, min(scraped) FROM c
      WHERE scraped >= 2 AND quote_hash NOT IN (SELECT quote_hash FROM c WHERE scraped < 2) GROUP BY quote_hash)
    GROUP BY quote_hash""",
)
def rescrape_insert(spark, sf_dir):
    stored, batch = _scrapes(spark, sf_dir)
    table = load.rescrape(stored, batch, policy="insert")
    return table.groupBy("quote_hash").agg(F.count(F.lit(1)).alias("n"), F.min("scraped").alias("first_scraped"))


@query("qry_01_word_count", f"SELECT doc_id, len({E.words('text')}) AS word_count FROM documents")
def word_count(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", enrich.word_count(F.col("text")).alias("word_count"))


@query(
    "qry_02_longest_word",
    f"""
    WITH w AS (SELECT doc_id, {E.words('text')} AS ws FROM documents),
    n AS (SELECT doc_id, ws, list_transform(ws, lambda y: length(y)) AS ls FROM w)
    SELECT doc_id, ws[list_position(ls, list_max(ls))] AS longest_word FROM n""",
)
def longest_word(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", enrich.longest_word(F.col("text")).alias("longest_word"))


# Words frequent in the documents, to give the lexicon hits.
_GOOD, _BAD = ("the", "of", "und", "les"), ("this", "was", "der", "para")


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SCORE = f"""
    WITH t AS (SELECT doc_id, {E.tokens('text')} AS ts FROM documents)
    SELECT doc_id, CAST(len(list_filter(ts, lambda x: x IN {_in(_GOOD)})) - len(list_filter(ts, lambda x: x IN {_in(_BAD)})) AS BIGINT)
           AS sentiment_score FROM t"""


@query("qry_03_sentiment", _SCORE)
def sentiment(spark, sf_dir):
    score = enrich.sentiment_score(F.col("text"), _GOOD, _BAD)
    return R.table(spark, sf_dir, "documents").select("doc_id", score.alias("sentiment_score"))


@query("qry_03_sentiment_by_lexicon", _SCORE)
def sentiment_by_lexicon(spark, sf_dir):
    rows = [(w, 1) for w in _GOOD] + [(w, -1) for w in _BAD]
    lexicon = spark.createDataFrame(rows, "word STRING, weight INT")
    return read.sentiment_by_lexicon(R.table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon, "doc_id")


@query(
    "qry_04_list_quotes",
    """
    SELECT doc_id AS id, source AS author, sha256(text) AS digest FROM documents
    WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 5""",
)
def list_quotes(spark, sf_dir):
    page = read.list_quotes(quotes(spark, sf_dir), author="src3", tag="en", limit=20, offset=5)
    return page.select("id", "author", F.sha2("text", 256).alias("digest"))


@query("qry_05_get_quote", "SELECT doc_id AS id, source AS author, n_chars FROM documents WHERE doc_id = 42")
def get_quote(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("author"), "n_chars")
    return read.get_quote(docs, 42)


@query(
    "qry_06_quote_stats",
    f"SELECT avg(len({E.words('text')})) AS avg_word_count, count(*) AS n_quotes FROM documents",
)
def quote_stats(spark, sf_dir):
    return read.quote_stats(quotes(spark, sf_dir))


@query(
    "qry_07_top_authors",
    """
    SELECT source AS author, count(*) AS n_quotes FROM documents
    GROUP BY source ORDER BY n_quotes DESC, author LIMIT 3""",
)
def top_authors(spark, sf_dir):
    return read.top_authors(quotes(spark, sf_dir))


_FOUND = f"""
    WITH t AS (SELECT doc_id AS id, {E.tokens('text')} AS ts FROM documents)
    SELECT id, CAST(len(list_filter(ts, lambda x: x IN ('with', 'this', 'from'))) AS BIGINT) AS hits FROM t
    WHERE list_contains(ts, 'with') AND list_contains(ts, 'this') AND list_contains(ts, 'from')"""

_SEARCH = "From, with  THIS"


@query("qry_08_search", _FOUND)
def search(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return read.search(docs, _SEARCH, limit=None).select("id", "hits")


@query("qry_08_search_index", _FOUND)
def search_index(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return read.search_index(read.inverted_index(docs), _SEARCH)


@query("qry_08_stored_index", _FOUND)
def stored_index(spark, sf_dir):
    path = new_scratch(spark, "index")
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    for part in (0, 1, 1):
        read.update_index(docs.where(F.col("id") % 2 == part), path, buckets=16)
    return read.search_stored(spark, path, _SEARCH)


@query(
    "qry_09_list_stores",
    """SELECT DISTINCT 'c' || (l_suppkey % 5) AS "superProvider", CAST(l_suppkey AS VARCHAR) AS "storeId"
       FROM lineitem ORDER BY 1, 2""",
)
def list_stores(spark, sf_dir):
    return read.list_stores(load.stores(price_rows(spark, sf_dir)))


@query("qry_10_get_product", f"""WITH {PRODUCTS} SELECT * FROM products WHERE "itemCode" = '0000077'""")
def get_product(spark, sf_dir):
    return read.get_product(load.products(price_rows(spark, sf_dir)), "0000077")


@query(
    "qry_11_list_prices",
    f"""
    WITH {PRICES} SELECT "superProvider", "storeId", "itemCode", price, "updateTime" FROM prices
    WHERE "superProvider" = 'c2' AND "storeId" = '7' ORDER BY "itemCode\"""",
)
def list_prices(spark, sf_dir):
    page = read.list_prices(current_prices(spark, sf_dir), chain="c2", store="7", limit=None)
    return page.select("superProvider", "storeId", "itemCode", "price", "updateTime")


@query(
    "qry_11_store_prices_from_feed",
    f"""
    WITH {E.OFFERS}
    SELECT '72900' || s_nationkey AS "superProvider", '00007' AS "storeId",
           lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS "itemCode", p_name AS "itemName", l_extendedprice AS price,
           strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "updateTime"
    FROM offers WHERE l_suppkey = 7 ORDER BY "itemCode\"""",
)
def store_prices_from_feed(spark, sf_dir):
    """From stored feed files over the prices table to one store's list."""
    records = prices.parse_prices(price_feed(spark, sf_dir), keep=("file",))
    table = dedup_last(records, load.PRICE_KEY, load.PRICE_ORDER)
    page = read.list_prices(table, store="00007", limit=None)
    return page.select("superProvider", "storeId", "itemCode", "itemName", "price", "updateTime")
