"""Feeds, listings and messages rendered from the warehouse tables.

The queries have no feed files to read, so their inputs are derived here from
the tables.  Every document is bounded: items go to a document by key range,
never by a key alone.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedline.functions.batches import slices
from feedline.operators.dedup import dedup_last

ITEMS_PER_DOCUMENT = 500
PROMOTIONS_PER_DOCUMENT = 50
# Offers are written into documents, packed and read in tasks of about so many: 60 MB of text. With a
# quarter of it, starting the tasks in each Python worker took a fifth more CPU time.
OFFERS_PER_TASK = 100_000
# Documents are written, packed and read in tasks of about so many promotions: 100 documents, which an
# aggregation groups without a sort, and which are one batch of some MB for each Python worker.
PROMOTIONS_PER_TASK = 5_000
PARTS_PER_FILE = 100
ROWS_PER_RESPONSE = 1000
PAGES_PER_CAPTURE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def escape(col: Column) -> Column:
    """Text made safe between XML tags."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(ref))
    return col


def element(tag: str, value: str | Column) -> Column:
    inner = F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit(""))
    return F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))


def joined(rows: Column) -> Column:
    """The ``xml`` of collected ``(order, xml)`` rows, in order."""
    return F.array_join(F.sort_array(rows)["xml"], "")


# --- price feeds -----------------------------------------------------------

OFFER_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier currently sells: the newest line per supplier and part."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", *OFFER_ORDER)
    # The part first: it has more values, so fewer rows are told apart by a second look when sorted.
    newest = dedup_last(lines, ["l_partkey", "l_suppkey"], OFFER_ORDER)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return newest.join(part, newest["l_partkey"] == part["p_partkey"]).join(
        supplier, newest["l_suppkey"] == supplier["s_suppkey"]
    )


def item_code(key: str) -> Column:
    return F.lpad(text(key), 7, "0")


def _offer_fields() -> dict[str, Column]:
    weighted = F.when(F.col("p_size") % 4 == 0, "1").when(F.col("p_size") % 4 == 1, "true")
    weighted = weighted.when(F.col("p_size") % 4 == 2, "0").otherwise("")
    allow = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "True").otherwise("TRUE")
    in_package = F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(text(F.col("p_size")))
    unit = F.when(F.col("p_size") % 2 == 0, " kg ").otherwise("unit")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return {
        "ItemCode": item_code("l_partkey"),
        "ItemType": text(F.col("p_size") % 2),
        "ItemName": escape(F.col("p_name")),
        "ManufactureItemDescription": escape(F.col("p_type")),
        "ManufactureName": escape(F.col("p_brand")),
        "ManufactureCountry": F.concat(F.lit("N"), text("s_nationkey")),
        "UnitQty": F.lit("Unit"),
        "Quantity": text("l_quantity"),
        "UnitOfMeasure": unit,
        "bIsWeighted": weighted,
        "QtyInPackage": in_package,
        "ItemPrice": text("l_extendedprice"),
        "AllowDiscount": allow,
        "ItemStatus": F.col("l_linestatus"),
        "PriceUpdateTime": stamp,
        "LastSaleDateTime": F.date_format("l_shipdate", "yyyy-MM-dd"),
    }


# How each kind of chain drifts: tag replacements, tags left out, letter case,
# item tag.  The kind of a supplier is its key modulo 4.
_DRIFT = (
    ({}, (), str, "Item"),
    (
        {
            "ItemName": "ItemNm",
            "ManufactureItemDescription": "ManufacturerItemDescription",
            "ManufactureName": "ManufacturerName",
            "PriceUpdateTime": "PriceUpdateDate",
            "LastSaleDateTime": "LastSaleDate",
        },
        (),
        str.upper,
        "Item",
    ),
    ({"bIsWeighted": "blsWeighted", "ManufactureItemDescription": "ItemDescription"}, (), str.lower, "item"),
    ({}, ("LastSaleDateTime",), str, "Product"),
)


def _by_kind(make) -> Column:
    kind = F.col("l_suppkey") % 4
    picked = F.when(kind == 0, make(0))
    for k in (1, 2):
        picked = picked.when(kind == k, make(k))
    return picked.otherwise(make(3))


def _item_pieces(kind: int) -> list[str]:
    """What stands before, between and after the fields of an item, with the names of those written."""
    renamed, dropped, case, item = _DRIFT[kind]
    pieces = [f"<{item}>"]
    for tag in _offer_fields():
        if tag in dropped:
            continue
        name = case(renamed.get(tag, tag))
        blank = f"<{name}> </{name}>" if kind == 3 and tag == "ItemName" else ""
        pieces[-1] += f"{blank}<{name}>"
        pieces += [tag, f"</{name}>"]
    pieces[-1] += f"</{item}>"
    return pieces


_DOCUMENT = ["l_suppkey", "s_nationkey", "bucket"]


def _starts(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in one of the columns; the first does."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in columns:
        column = rows.column(name)
        held, null = pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_null(column).to_numpy(zero_copy_only=False)
        new[1:] |= (held[1:] != held[:-1]) | (null[1:] != null[:-1])
    return new


def _written_items(pieces: list[list[str]]):
    """A function of batches of offers, those of a document in a row by part: one row for each document, with its items."""

    def written(rows: pa.RecordBatch) -> pa.RecordBatch:
        key = np.fmod(rows.column("l_suppkey").to_numpy(zero_copy_only=False), 4)
        kind = np.where((key >= 0) & (key < 3), key, 3)
        xml, places = [], []
        for k in np.unique(kind):
            place = np.flatnonzero(kind == k)
            some = rows.take(pa.array(place))
            parts = [pc.fill_null(some.column(p), "") if n % 2 else p for n, p in enumerate(pieces[k])]
            xml.append(pc.binary_join_element_wise(*parts, ""))
            places.append(place)
        order = np.argsort(np.concatenate(places), kind="stable")
        new, part = _starts(rows, _DOCUMENT), _starts(rows, [*_DOCUMENT, "l_partkey"])
        if not part.all():
            # Rows of one part come in the order of their text.
            found = pa.concat_arrays(xml)
            edges = np.append(np.flatnonzero(part), rows.num_rows)
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if last - first > 1:
                    order[first:last] = sorted(order[first:last], key=lambda n: found[n].as_py())
        items = pa.concat_arrays(xml).take(pa.array(order))
        begun = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begun, rows.num_rows), pa.int32()), items)
        held = rows.select(_DOCUMENT).take(pa.array(begun)).columns
        return pa.RecordBatch.from_arrays([*held, pc.binary_join(lists, "")], [*_DOCUMENT, "items"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                edge = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            last = int(np.flatnonzero(_starts(batch, _DOCUMENT))[-1])
            # The last document may go on in the next batch.
            if last or (held and _starts(edge, _DOCUMENT)[1]):
                yield written(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield written(pa.concat_batches(held))

    return documents


def price_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, l_suppkey, doc``: one price document per supplier and part range.

    Offers go as they are to the task that writes the documents of their supplier and
    part range, so that no text is shuffled, and are sorted there before they are text.
    """
    tasks = table(spark, sf_dir, "lineitem").count() // OFFERS_PER_TASK + spark.sparkContext.defaultParallelism
    placed = offers(spark, sf_dir).withColumn("bucket", F.floor(F.col("l_partkey") / ITEMS_PER_DOCUMENT))
    dealt = placed.repartition(tasks, "l_suppkey", "bucket").sortWithinPartitions(F.xxhash64(*_DOCUMENT), *_DOCUMENT, "l_partkey")
    rows = dealt.select(*_DOCUMENT, "l_partkey", *[value.alias(tag) for tag, value in _offer_fields().items()])
    schema = T.StructType([*[rows.schema[c] for c in _DOCUMENT], T.StructField("items", T.StringType())])
    grouped = rows.mapInArrow(_written_items([_item_pieces(kind) for kind in range(len(_DRIFT))]), schema)

    def document(kind: int) -> Column:
        case = _DRIFT[kind][2]
        head = F.concat(
            element(case("ChainId"), F.concat(F.lit("72900"), text("s_nationkey"))),
            element(case("StoreId"), F.lpad(text("l_suppkey"), 5, "0")),
        )
        return element("Root", F.concat(head, element(case("Items"), F.col("items"))))

    return grouped.select(
        F.concat(F.lit("PriceFull-"), text("l_suppkey"), F.lit("-"), text("bucket"), F.lit(".gz")).alias("file"),
        "l_suppkey",
        _by_kind(document).alias("doc"),
    )


def as_files(documents: DataFrame, zipped: Column, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """``content`` bytes of documents, gzipped where the flag says so."""
    rows = documents.select(*keep, F.col("doc").cast("binary").alias("content"), zipped.alias("_zipped"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                flags = part.column("_zipped").to_pylist()
                stored = [
                    gzip.compress(raw, 1, mtime=0) if raw is not None and flag else raw
                    for raw, flag in zip(part.column("content").to_pylist(), flags, strict=True)
                ]
                held = part.select(list(keep)).columns
                yield pa.RecordBatch.from_arrays([*held, pa.array(stored, pa.binary())], [*keep, "content"])

    return rows.mapInArrow(packed, T.StructType([*[rows.schema[c] for c in keep], T.StructField("content", T.BinaryType())]))


# --- promotion feeds -------------------------------------------------------

LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order and line number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER)
    return dedup_last(lines, ["l_orderkey", "l_linenumber"], LINE_ORDER)


def promotion_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, doc``: promotions of a range of orders; even orders grouped, odd flat.

    Lines and orders go once, as they are, to the task that writes and packs the documents
    of their range, so that no text is shuffled and a task holds no more than its range.
    """
    key = F.col("o_orderkey")
    grouped = key % 2 == 0
    item_tag = F.when(grouped, "PromotionItem").otherwise("Item")

    def item(line: Column) -> Column:
        n = line["l_linenumber"]
        inner = F.concat(
            element("ItemCode", text(line["l_partkey"])),
            element("ItemType", F.when(n % 3 == 2, "x").otherwise(text(n % 3))),
            F.when(n % 3 == 0, element("MinQty", text(line["l_quantity"]))).otherwise(""),
            element("MaxQty", F.when(n % 2 == 0, "").otherwise(text(line["l_quantity"]))),
            F.when(n % 2 == 0, element("DiscountedPrice", text(line["l_extendedprice"]))).otherwise(""),
        )
        xml = F.concat(F.lit("<"), item_tag, F.lit(">"), inner, F.lit("</"), item_tag, F.lit(">"))
        g = F.when(grouped, line["l_suppkey"] % 2).otherwise(0)
        return F.struct(n.alias("n"), xml.alias("xml"), g.alias("g"))

    def group(g: Column) -> Column:
        container = element("PromotionItems", joined(F.filter("items", lambda i: i["g"].eqNullSafe(g))))
        group_min = F.when(key % 5 == 0, "n/a").when(key % 5 == 1, " ").otherwise(text(g + 3))
        stated = F.concat(element("MinQty", group_min), element("DiscountedPricePerMida", text(g + F.lit(0.5))), container)
        return F.struct(g.alias("g"), F.when(grouped, element("Group", stated)).otherwise(container).alias("xml"))

    lines = order_lines(spark, sf_dir).where("l_orderkey IS NOT NULL")
    orders = table(spark, sf_dir, "orders")
    stated = F.struct("o_orderdate", "o_orderpriority", "o_totalprice")
    both = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", *LINE_ORDER).alias("line")).unionByName(
        orders.select("o_orderkey", stated.alias("stated")), allowMissingColumns=True
    )
    tasks = orders.count() // PROMOTIONS_PER_TASK + spark.sparkContext.defaultParallelism
    dealt = both.withColumn("bucket", F.floor(key / PROMOTIONS_PER_DOCUMENT)).repartition(tasks, "bucket")
    held = dealt.groupBy("bucket", "o_orderkey").agg(F.collect_list("line").alias("lines"), F.collect_list("stated").alias("stated"))
    # A line without an order is in no document.
    found = held.select("bucket", "o_orderkey", "lines", F.explode("stated").alias("stated")).select(
        "bucket", "o_orderkey", F.transform("lines", item).alias("items"), "stated.*"
    )
    groups = F.transform(F.array_distinct(F.transform("items", lambda i: i["g"])), group)
    orders = found.withColumn("body", F.when(F.size("items") > 0, joined(groups)))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stray = element("PromotionItems", element("Item", element("ItemCode", "stray")))
    body = F.coalesce("body", F.lit(""))
    shaped = F.when(
        key % 2 == 0,
        F.concat(element("Groups", body), F.when(F.col("body").isNotNull(), stray).otherwise("")),
    ).otherwise(body)
    times = F.when(
        key % 2 == 0,
        F.concat(
            element("PromotionStartDateTime", F.concat(day, F.lit(" 08:30:00"))),
            element("PromotionStartHour", "11:11:11"),
            element("PromotionEndDateTime", F.concat(day, F.lit("T20:00:00"))),
            element("PromotionUpdateTime", F.concat(day, F.lit(" 01:02:03"))),
        ),
    ).otherwise(
        F.concat(
            element("PromotionStartDate", day),
            F.when(key % 7 == 0, "").otherwise(element("PromotionStartHour", "09:15:00")),
            element("PromotionEndDate", F.when(key % 11 == 0, "").otherwise(day)),
            element("PromotionEndHour", " "),
            element("PromotionUpdateDate", day),
        )
    )
    promotion = element(
        "Promotion",
        F.concat(
            element("PromotionID", text(key)),
            element("PromotionDescription", escape(F.col("o_orderpriority"))),
            times,
            element("DiscountType", text(key % 4)),
            F.when(key % 3 == 0, element("MinQty", "2")).when(key % 3 == 1, element("minqty", "")).otherwise(""),
            F.when(key % 2 == 1, element("DiscountedPrice", text("o_totalprice"))).otherwise(""),
            shaped,
        ),
    )
    rows = orders.select("bucket", F.struct("o_orderkey", promotion.alias("xml")).alias("row"))
    docs = rows.groupBy("bucket").agg(joined(F.collect_list("row")).alias("xml"))
    root = F.concat(
        element("ChainID", F.concat(F.lit("C"), text(F.col("bucket") % 7))),
        element("StoreID", F.concat(F.lit("S"), text(F.col("bucket") % 11))),
        # Every third file hangs its promotions directly below the root.
        F.when(F.col("bucket") % 3 == 0, F.col("xml")).otherwise(element("Promotions", F.col("xml"))),
    )
    return docs.select(
        F.concat(F.lit("PromoFull-"), text("bucket"), F.lit(".gz")).alias("file"), "bucket", element("root", root).alias("doc")
    )


def mixed_promotion_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bucket, doc``: promotions at the root, in wrappers and inside each other, items under three tags."""
    tag = F.element_at(F.array(*[F.lit(t) for t in ("Line", "PromotionItem", "Item")]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    item = F.concat(F.lit("<"), tag, F.lit(">"), element("ItemCode", text("l_partkey")), F.lit("</"), tag, F.lit(">"))
    rows = order_lines(spark, sf_dir).select("l_orderkey", F.struct("l_linenumber", item.alias("xml")).alias("row"))
    items = rows.groupBy("l_orderkey").agg(element("PromotionItems", joined(F.collect_list("row"))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    inner = element(
        "promotion",
        F.concat(
            element("PromotionID", F.concat(text(key), F.lit("-inner"))),
            element("PromotionItems", element("Row", element("ItemCode", "inner"))),
        ),
    )
    promotion = element(
        "Promotion",
        F.concat(
            # The later alias comes first in the document and counts.
            element("PromotionStartDate", day),
            element("PromotionStartDateTime", F.lit("1990-01-01 10:00:00")),
            F.when(key % 4 == 2, inner).otherwise(""),
            element("PromotionID", text(key)),
            F.coalesce("items", F.lit("")),
        ),
    )
    placed = F.when(key % 4 == 1, element("Envelope", element("Deals", promotion)))
    placed = placed.when(key % 4 == 3, element("Promotions", promotion)).otherwise(promotion)
    rows = orders.select(
        F.floor(key / PROMOTIONS_PER_DOCUMENT).alias("bucket"), F.struct("o_orderkey", placed.alias("xml")).alias("row")
    )
    return rows.groupBy("bucket").agg(element("root", joined(F.collect_list("row"))).alias("doc"))


# --- stored files ----------------------------------------------------------


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, doc``: small price documents of one chain, from ``part`` alone."""
    xml = element(
        "Item",
        F.concat(
            element("ItemCode", item_code("p_partkey")),
            element("ItemName", escape(F.col("p_name"))),
            element("ItemPrice", text("p_retailprice")),
            element("PriceUpdateTime", F.concat(F.lit("2024-01-01 00:00:0"), text(F.col("p_size") % 10))),
        ),
    )
    rows = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / PARTS_PER_FILE).alias("file"),
        F.struct("p_partkey", xml.alias("xml")).alias("row"),
    )
    docs = rows.groupBy("file").agg(joined(F.collect_list("row")).alias("items"))
    return docs.select(
        "file",
        element(
            "Root",
            F.concat(element("ChainId", "C1"), element("StoreId", text("file")), element("Items", F.col("items"))),
        ).alias("doc"),
    )


def write_part_files(spark: SparkSession, sf_dir: str, path: str, doc: Column | None = None) -> None:
    """The part documents, or another text of them, as files, one each, every other one gzipped."""
    docs = part_documents(spark, sf_dir).repartition("file")
    if doc is not None:
        docs = docs.withColumn("doc", doc)
    for codec, rest in (("gzip", 0), ("none", 1)):
        (
            docs.where(F.col("file") % 2 == rest)
            .write.mode("append")
            .partitionBy("file")
            .option("compression", codec)
            .text(path)
        )


# --- listings --------------------------------------------------------------

LINK_ROOT = "https://files.example.net"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-source listing of dated files, one row per line item."""
    lines = table(spark, sf_dir, "lineitem")
    second = F.make_dt_interval(secs=(F.col("l_orderkey") % 86400).cast("decimal(18,6)"))
    stamp = F.date_format(F.col("l_shipdate") + second, "yyyyMMdd-HHmmss")
    kind = F.when(F.col("l_partkey") % 3 == 0, "PriceFull").when(F.col("l_partkey") % 3 == 1, "PromoFull")
    named = lines.select(
        F.concat(F.lit("s"), text(F.col("l_suppkey") % 25)).alias("source"),
        (F.col("l_partkey") % 5 + 1).cast("int").alias("category"),
        F.col("l_linenumber").alias("page"),
        F.col("l_orderkey").alias("pos"),
        F.concat(
            kind.otherwise("Stores"),
            text("l_suppkey"),
            F.lit("-"),
            text("l_partkey"),
            F.lit("-"),
            F.when(F.col("l_partkey") % 50 == 0, "undated").otherwise(stamp),
            F.lit(".gz"),
        ).alias("fname"),
        F.year("l_shipdate").alias("year"),
    )
    return named.withColumn("href", F.concat_ws("/", F.lit(LINK_ROOT), "source", "fname"))


def captured(rows: DataFrame, by: list[str], body: Column, before: str, after: str, between: str = "") -> DataFrame:
    """``by`` and ``body``: the rows of a listing as captures of at most some hundred, in order."""
    chunk = F.floor(F.col("pos") / 2000).alias("chunk")
    held = rows.select(*by, chunk, F.struct("pos", "fname", body.alias("xml")).alias("row"))
    grouped = held.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    inner = F.array_join(F.col("rows")["xml"], between)
    return grouped.select(*by, "chunk", F.concat(F.lit(before), inner, F.lit(after)).alias("body"))


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored marks of the listing's sources; some null, some blank."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("s"), text(key)).alias("source"),
        F.when(key % 5 == 1, "  ")
        .when(key % 5 != 0, F.concat(text(F.lit(1995) + key % 5), F.lit("0615120000")))
        .alias("mark"),
    )


# --- messages --------------------------------------------------------------


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, value``: events as JSON messages, every fiftieth cut short."""
    body = F.to_json(
        F.struct(
            "event_id",
            "user_id",
            "event_type",
            F.col("value").alias("amount"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        )
    )
    broken = F.col("event_id") % 50 == 49
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(broken, F.substring(body, 1, 20)).otherwise(body).alias("value")
    )
