"""Queries of the sources and sinks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from feedline.plans import rendering as R
from feedline.plans.registry import query
from feedline.session import new_scratch
from feedline.sources import listings, marks, raw, records
from feedline.streaming.feeds import once


@query(
    "src_01_raw_scan",
    f"""
    SELECT CAST(p_partkey // {R.PARTS_PER_FILE} AS VARCHAR) AS file,
           (p_partkey // {R.PARTS_PER_FILE}) % 2 = 0 AS zipped, count(*) AS n_items
    FROM part GROUP BY ALL""",
)
def raw_scan(spark, sf_dir):
    path = new_scratch(spark, "raw")
    R.write_part_files(spark, sf_dir, path)
    files = raw.read_raw(spark, path)
    zipped = files.withColumn("zipped", F.hex(F.substring("content", 1, 2)) == "1F8B")
    return raw.documents(zipped, ("path", "zipped")).select(
        F.regexp_extract("path", r"file=([0-9]+)/", 1).alias("file"),
        "zipped",
        F.size(F.regexp_extract_all("doc", F.lit("<Item>"), F.lit(0))).cast("bigint").alias("n_items"),
    )


@query("src_02_sniffed_decompression", "SELECT page_id, page_id % 2 = 0 AS zipped, sha256(html) AS digest FROM pages")
def sniffed(spark, sf_dir):
    pages = R.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("doc"))
    files = R.as_files(pages, F.col("page_id") % 2 == 0, keep=("page_id",))
    zipped = files.withColumn("zipped", F.hex(F.substring("content", 1, 2)) == "1F8B")
    return raw.documents(zipped, ("page_id", "zipped")).select("page_id", "zipped", F.sha2("doc", 256).alias("digest"))


def responses(spark, sf_dir):
    """Offset-paged listing responses over the events."""
    entry = F.struct(
        "event_id", F.struct(F.col("event_type").alias("type"), F.concat(F.lit("PriceFull"), R.text("event_id")).alias("fname")).alias("e")
    )
    grouped = (
        R.table(spark, sf_dir, "events")
        .groupBy(F.floor(F.col("event_id") / R.ROWS_PER_RESPONSE).alias("response"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    )
    total = F.when(F.col("response") % 4 == 3, R.ROWS_PER_RESPONSE + 1).otherwise(R.ROWS_PER_RESPONSE)
    return grouped.select(
        "response",
        F.to_json(
            F.struct(F.transform("rows", lambda r: r["e"]).alias("aaData"), total.alias("iTotalRecords"))
        ).alias("body"),
    )


@query(
    "src_03_json_listing",
    f"""
    SELECT event_id // {R.ROWS_PER_RESPONSE} AS response, event_type AS row_type,
           'PriceFull' || event_id AS fname,
           CAST(row_number() OVER (PARTITION BY event_id // {R.ROWS_PER_RESPONSE} ORDER BY event_id) - 1 AS INTEGER) AS pos
    FROM events""",
)
def json_listing(spark, sf_dir):
    return listings.read_json_listing(responses(spark, sf_dir), "body", keep=("response",))


@query(
    "src_03_mixed_members",
    f"""
    WITH m AS (SELECT event_id // {R.ROWS_PER_RESPONSE} AS response, event_id, event_type, event_id % 7 AS kind FROM events)
    SELECT response, CAST(row_number() OVER (PARTITION BY response ORDER BY event_id) - 1 AS INTEGER) AS pos,
           CASE WHEN kind > 3 THEN 'PriceFull' || event_id END AS fname, CASE WHEN kind = 3 THEN '5' WHEN kind > 3 THEN event_type END AS row_type,
           CASE kind WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'text ' || event_id WHEN 2 THEN '[' || event_id || ']' END AS odd
    FROM m""",
)
def mixed_members(spark, sf_dir):
    key, kind = R.text("event_id"), F.col("event_id") % 7
    entry = F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.lit("PriceFull"), key).alias("fname")))
    # Numbers, texts, lists and objects of other types stand between the entries.
    member = F.when(kind == 0, key).when(kind == 1, F.concat(F.lit('"text '), key, F.lit('"')))
    member = member.when(kind == 2, F.concat(F.lit("["), key, F.lit("]"))).when(kind == 3, F.lit('{"type": 5, "fname": null}')).otherwise(entry)
    rows = R.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / R.ROWS_PER_RESPONSE).alias("response"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("event_id", member.alias("m")))).alias("rows"))
    body = F.concat(F.lit('{"aaData": ['), F.array_join(F.transform("rows", lambda r: r["m"]), ", "), F.lit("]}"))
    found = listed.select("response", body.alias("body"))
    read = listings.read_json_listing(found, "body", ("response",)).withColumn("odd", F.lit(None).cast("string"))
    odd = listings.odd_members(found, "body", ("response",)).withColumnRenamed("member", "odd")
    return read.unionByName(odd, allowMissingColumns=True)


@query(
    "src_04_catalog_entries",
    f"""
    SELECT event_id // {R.ROWS_PER_RESPONSE} AS response, 'f' || event_id || '.gz' AS fname,
           CASE WHEN event_type <> 'error' THEN event_type END AS file_type
    FROM events""",
)
def catalog_entries(spark, sf_dir):
    entry = F.struct(
        F.concat(F.lit("f"), R.text("event_id"), F.lit(".gz")).alias("fileName"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("fileType"),
    )
    grouped = (
        R.table(spark, sf_dir, "events")
        .groupBy(F.floor(F.col("event_id") / R.ROWS_PER_RESPONSE).alias("response"))
        .agg(F.collect_list(F.to_json(entry)).alias("rows"))
    )
    # A member that is no object stands between the entries.
    listed = F.concat(F.lit("["), F.array_join(F.concat("rows", F.array(F.lit("17"))), ","), F.lit("]"))
    wrapper = F.get(
        F.array(*[F.lit(w) for w in listings.WRAPPERS]), (F.col("response") % 5).cast("int") - 1
    )
    body = F.when(F.col("response") % 5 == 0, listed).otherwise(
        F.concat(F.lit('{"count": 3, "'), wrapper, F.lit('": '), listed, F.lit("}"))
    )
    found = listings.read_catalog_entries(grouped.select("response", body.alias("body")), "body", ("response",))
    return found.select("response", "fname", "file_type")


@query(
    "src_05_page_capture",
    f"""
    SELECT CAST(page_id // {R.PAGES_PER_CAPTURE} AS VARCHAR) AS capture,
           CAST(sum(len(regexp_extract_all(html, '<a href='))) AS BIGINT) AS n_links,
           CAST(sum(length(html) + 1) AS BIGINT) AS n_chars
    FROM pages GROUP BY ALL""",
)
def page_capture(spark, sf_dir):
    path = new_scratch(spark, "pages")
    captures = R.table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / R.PAGES_PER_CAPTURE).alias("capture"), "html"
    )
    captures.repartition("capture").write.partitionBy("capture").text(path)
    return raw.read_pages(spark, path).select(
        F.regexp_extract("path", r"capture=([0-9]+)/", 1).alias("capture"),
        F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("bigint").alias("n_links"),
        F.length("html").cast("bigint").alias("n_chars"),
    )


@query(
    "src_06_json_records",
    "SELECT doc_id, sha256(text) AS digest, CASE WHEN lang <> 'en' THEN lang END AS lang, true AS lang_kept FROM documents",
)
def json_records(spark, sf_dir):
    path = new_scratch(spark, "records")
    docs = R.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang")
    )
    records.write_records(docs, path)
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", "doc_id BIGINT, text STRING, lang STRING").alias("r"))
    return parsed.select(
        "r.doc_id",
        F.sha2("r.text", 256).alias("digest"),
        "r.lang",
        F.col("value").rlike(r'"lang":(null|"..")\}$').alias("lang_kept"),
    )


@query(
    "src_07_messages",
    """
    SELECT sha256('["' || p_partkey || '"]') AS key,
           '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":'
             || CASE WHEN p_size % 7 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}' AS value
    FROM part""",
)
def messages(spark, sf_dir):
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("p_size")
    return records.to_messages(R.table(spark, sf_dir, "part").select("p_partkey", "p_name", size), ["p_partkey"])


@query(
    "src_08_price_csv",
    """
    SELECT '7290' AS "superProvider", '001' AS "storeId", lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS "itemCode",
           p_name AS "itemName", p_brand AS "manufactureName", p_retailprice AS price, p_size % 2 = 1 AS weighted,
           CAST(NULL AS VARCHAR) AS "itemStatus", '2024-01-01T10:00:00' AS "updateTime"
    FROM part""",
)
def price_csv(spark, sf_dir):
    path = new_scratch(spark, "csv")
    R.table(spark, sf_dir, "part").select(
        F.lit("7290").alias("ChainID"),
        F.lit(" 001").alias("STOREID"),
        R.item_code("p_partkey").alias("ItemCode"),
        F.col("p_name").alias("ItemNm"),
        F.col("p_brand").alias("ManufacturerName"),
        R.text("p_retailprice").alias("ItemPrice"),
        R.text(F.col("p_size") % 2).alias("blsWeighted"),
        F.lit("2024-01-01 10:00:00").alias("PriceUpdateDate"),
    ).write.option("header", "true").csv(path)
    return listings.read_prices_csv(spark, path).select(
        "superProvider", "storeId", "itemCode", "itemName", "manufactureName", "price", "weighted", "itemStatus", "updateTime"
    )


_STORED = """
    CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN NULL
         ELSE '2024010100000' || (s_suppkey % 10) END"""


def _stored_marks(spark, sf_dir):
    key = F.col("s_suppkey")
    stored = R.table(spark, sf_dir, "supplier").where(key % 4 != 0)
    return stored.select(
        F.col("s_name").alias("source"),
        F.when(key % 4 == 1, " \n").otherwise(F.concat(F.lit(" 2024010100000"), R.text(key % 10), F.lit("\n"))).alias("mark"),
    )


@query("src_09_load_checkpoint", f"SELECT s_name AS source, {_STORED} AS mark FROM supplier")
def load_checkpoint(spark, sf_dir):
    path = new_scratch(spark, "marks")
    marks.save_checkpoint(_stored_marks(spark, sf_dir).withColumn("mark", F.lit("0")), path)
    marks.save_checkpoint(_stored_marks(spark, sf_dir), path)
    sources = R.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"))
    return marks.load_checkpoint(spark, path, sources)


@query(
    "src_10_advance_checkpoint",
    f"""
    WITH m AS (
      SELECT s_name AS source, {_STORED} AS old, s_suppkey % 4 AS kind,
             CASE s_suppkey % 3 WHEN 0 THEN '20250101000000' WHEN 1 THEN '' END AS new, s_suppkey % 3 AS k3
      FROM supplier)
    SELECT source, CASE WHEN k3 = 0 THEN new ELSE old END AS mark FROM m WHERE kind <> 0 OR k3 IN (0, 1)""",
)
def advance_checkpoint(spark, sf_dir):
    key = F.col("s_suppkey")
    new = (
        R.table(spark, sf_dir, "supplier")
        .where(key % 3 != 2)
        .select(F.col("s_name").alias("source"), F.when(key % 3 == 0, "20250101000000").otherwise("").alias("mark"))
    )
    return marks.advance_checkpoint(marks.clean_marks(_stored_marks(spark, sf_dir)), new)


@query(
    "src_10_commit_checkpoint",
    f"""
    WITH m AS (
      SELECT s_name AS source, {_STORED} AS old, s_suppkey % 4 AS kind, s_suppkey % 3 AS k3 FROM supplier)
    SELECT source, CASE k3 WHEN 0 THEN '20250101000000' WHEN 1 THEN '20250202000000' ELSE old END AS mark
    FROM m WHERE kind <> 0 OR k3 < 2""",
)
def commit_checkpoint(spark, sf_dir):
    path = new_scratch(spark, "marks")
    marks.save_checkpoint(_stored_marks(spark, sf_dir), path)
    key = F.col("s_suppkey") % 3
    cycles = [
        R.table(spark, sf_dir, "supplier").where(key == n).select(F.col("s_name").alias("source"), F.lit(mark).alias("mark"))
        for n, mark in ((0, "20250101000000"), (1, "20250202000000"))
    ]
    # Both cycles start from the same version; the later one goes on from the earlier one's.
    with ThreadPoolExecutor(2) as side_by_side:
        list(side_by_side.map(lambda new: marks.commit_checkpoint(new, path), cycles))
    return marks.load_checkpoint(spark, path)


@query(
    "src_11_raw_layout",
    """
    SELECT 's' || (o_custkey % 7) || '/f' || o_orderkey || '.gz' AS key,
           CASE WHEN o_orderstatus = 'F' THEN '2' ELSE '1' END AS batch_id, o_totalprice AS size
    FROM orders""",
)
def raw_layout(spark, sf_dir):
    path = new_scratch(spark, "zone")
    orders = R.table(spark, sf_dir, "orders")
    source = F.concat(F.lit("s"), R.text(F.col("o_custkey") % 7))
    name = F.concat(F.lit("f"), R.text("o_orderkey"), F.lit(".gz"))
    objects = orders.select(
        source.alias("source"),
        raw.object_key(source, name).alias("key"),
        F.col("o_totalprice").alias("size"),
        "o_orderstatus",
    )
    again = objects.where(F.col("o_orderstatus") == "F")
    raw.write_raw(objects.drop("o_orderstatus"), path, "1")
    raw.write_raw(again.drop("o_orderstatus"), path, "2")
    raw.write_raw(again.drop("o_orderstatus"), path, "2")
    zone = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("string"))
    return raw.current_objects(zone.select("key", "batch_id", "size"))


@query(
    "src_12_file_stream",
    f"""
    SELECT CAST(p_partkey // {R.PARTS_PER_FILE} AS VARCHAR) AS file, count(*) AS n_items
    FROM part GROUP BY ALL""",
)
def file_stream(spark, sf_dir):
    inbox, out, state = (new_scratch(spark, name) for name in ("inbox", "picked", "state"))
    R.write_part_files(spark, sf_dir, inbox)
    stream = raw.stream_raw(spark, inbox, text=True).select(
        F.regexp_extract("path", r"file=([0-9]+)/", 1).alias("file"),
        F.size(F.regexp_extract_all("doc", F.lit("<Item>"), F.lit(0))).cast("bigint").alias("n_items"),
    )
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    # The second run finds every file picked up already.
    for _ in range(2):
        once(writer).awaitTermination()
    return spark.read.parquet(out)
