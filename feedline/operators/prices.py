"""Price feeds: one document per file into one flat record per item."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedline.functions.batches import slices
from feedline.functions.plain_prices import PlainPrices
from feedline.functions.text import WHITE_SPACE, bool_of, first_text, iso_ts, number_of, typed_ts
from feedline.functions.unify import unified_prices

# Output name, accepted tags, kind of value.
PRICE_FIELDS: dict[str, tuple[tuple[str, ...], str]] = {
    "itemCode": (("ItemCode",), "text"),
    "itemType": (("ItemType",), "number"),
    "itemName": (("ItemName", "ItemNm"), "text"),
    "itemDescription": (
        ("ManufactureItemDescription", "ManufacturerItemDescription", "ItemDescription"),
        "text",
    ),
    "manufactureName": (("ManufactureName", "ManufacturerName"), "text"),
    "manufactureCountry": (("ManufactureCountry",), "text"),
    "unitQuantity": (("UnitQty",), "text"),
    "quantity": (("Quantity",), "number"),
    "unitOfMeasure": (("UnitOfMeasure",), "text"),
    "weighted": (("bIsWeighted", "blsWeighted"), "bool"),
    "inPackage": (("QtyInPackage",), "number"),
    "price": (("ItemPrice",), "number"),
    "allowDiscount": (("AllowDiscount",), "bool"),
    "itemStatus": (("ItemStatus",), "text"),
    "updateTime": (("PriceUpdateTime", "PriceUpdateDate"), "time"),
    "lastSaleDateTime": (("LastSaleDateTime", "LastSaleDate"), "time"),
}

PRICE_COLUMNS = ("superProvider", "storeId", *PRICE_FIELDS)

# The usual tags of the container's children; any other child is an item too.
ITEM_TAGS = ("Item", "Product")

# Children under tags that a schema does not name, as texts.
ANY = "xs_any"

_KINDS = {"text": lambda c: c, "number": number_of, "bool": bool_of, "time": iso_ts}

_CORRUPT = "_corrupt"

# Bytes of plain documents whose tags are in memory at once.
PLAIN_BYTES = 1 << 20
# Items of a plain document in one row: the rows of a batch wait for Python together.
PLAIN_ITEMS = 16


def price_columns() -> list[Column]:
    """The item columns of a price record, from text columns of the same names."""
    return [_KINDS[kind](F.col(name)).alias(name) for name, (_, kind) in PRICE_FIELDS.items()]


def join_arrays(*arrays: Column) -> Column:
    """Concatenation that takes a null array for an empty one."""
    return F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))


def price_schema(item_tags: tuple[str, ...] = ITEM_TAGS) -> str:
    """Schema of a price document.

    Every leaf is an array, since a scalar leaf would keep the last of
    several occurrences; nothing is typed, since codes such as ``007`` are
    text.
    """
    tags = [tag for accepted, _ in PRICE_FIELDS.values() for tag in accepted]
    item = "STRUCT<" + ", ".join(f"{tag}: ARRAY<STRING>" for tag in tags) + ">"
    container = "STRUCT<" + ", ".join(f"{tag}: ARRAY<{item}>" for tag in item_tags) + f", {ANY}: ARRAY<STRING>>"
    return f"ChainId ARRAY<STRING>, StoreId ARRAY<STRING>, Items ARRAY<{container}>, {_CORRUPT} STRING"


def parse_xml(doc: Column, schema: str, mode: str = "PERMISSIVE") -> Column:
    """The document as a struct; tags match in any case."""
    return F.from_xml(doc, schema, {"mode": mode, "columnNameOfCorruptRecord": _CORRUPT})


def _one_root(doc: Column, root: Column) -> Column:
    """The root's tag closes for good only once, at its last occurrence; comments and CDATA do not count."""
    hidden = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
    plain = F.when(doc.contains("<!"), F.regexp_replace(doc, hidden, "")).otherwise(doc)
    tag = F.concat(F.lit(r"</?\Q"), root, F.lit(r"""\E(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*+>"""))

    def step(state: Column, found: Column) -> Column:
        change = F.when(found.startswith("</"), -1).when(found.endswith("/>"), 0).otherwise(1)
        outside = state["seen"] & (state["depth"] <= 0)
        return F.struct(
            (state["depth"] + change).alias("depth"), F.lit(True).alias("seen"), (state["bad"] | outside).alias("bad")
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("seen"), F.lit(False).alias("bad"))
    return F.aggregate(F.regexp_extract_all(plain, tag, F.lit(0)), start, step, lambda s: ~s["bad"] & (s["depth"] == 0))


def well_formed(doc: Column, parsed: Column) -> Column:
    """The whole text is one document: it parsed, and its root element ends once, at the end."""
    root = F.regexp_extract(doc, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*+<([^\s/>!?]+)", 1)
    # The closing tag is nearly always the very end; only else search for it.
    at_end = F.regexp_extract(F.right(doc, F.lit(200)), r"</([^\s<>]+)\s*>\s*$", 1)
    before_comments = F.regexp_extract(doc, r"(?s)</([^\s>]+)\s*>(?:\s|<!--.*?-->)*+$", 1)
    empty_root = doc.rlike(r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->)*+<[^<>]*/>\s*$")
    closed = F.when(root == "", False).when(root == at_end, True).when(root == before_comments, True)
    # Nearly always the root's name is closed once, at the very end; only else follow its tags.
    closings = F.regexp_count(doc, F.concat(F.lit(r"</\Q"), root, F.lit(r"\E")))
    opened = ~doc.rlike(r"""(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*+<(?:[^<>"']|"[^"]*"|'[^']*')*+(?<=/)>""")
    plain = (root == at_end) & opened & (closings == 1)
    whole = F.when(root == "", F.lit(False)).when(plain, F.lit(True)).otherwise(_one_root(doc, root))
    return doc.isNotNull() & parsed[_CORRUPT].isNull() & closed.otherwise(empty_root) & whole


def filled(*arrays: Column) -> Column:
    """How many of the arrays hold something."""
    return sum((F.when(F.size(a) > 0, 1).otherwise(0) for a in arrays), F.lit(0))


def read_items(
    raw: DataFrame,
    schema: str,
    head: dict[str, Callable[[Column], Column]],
    items: Callable[[Column], Column],
    odd: Callable[[Column, Column], Column],
    unify: Callable[[Column], Column],
    doc: str = "doc",
    keep: tuple[str, ...] = (),
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """``keep`` and ``head`` columns, ``reason``, ``pos`` and ``item``: a row for each item of a document that was read.

    A document without items, and one that is rejected, has one row without ``pos``;
    ``reason`` is null for all but the rejected ones.  ``head`` and ``items`` are
    functions of the parsed document.

    A document for which ``odd(parsed, text)`` holds is written anew by ``unify`` and
    parsed once more, no other is.  Only its text goes to Python, never a parsed
    document: what goes there waits in memory for its batch.
    """
    # Generated from a one-element array: a filter on what was parsed then stays
    # above the parser instead of parsing once more below it.
    parsed = raw.select(
        *keep, F.col(doc).alias("_doc"), F.explode_outer(F.array(parse_xml(F.col(doc), schema, mode))).alias("x")
    )
    judged = parsed.select(*keep, "x", "_doc", well_formed(F.col("_doc"), F.col("x")).alias("_ok"))
    again = F.when(F.col("_ok") & F.coalesce(odd(F.col("x"), F.col("_doc")), F.lit(False)), F.col("_doc"))
    refused = F.when(F.col("_doc").isNull(), "no text").when(~F.col("_ok"), "not well-formed")
    told = judged.select(*keep, "x", refused.alias("_refused"), again.alias("_again"))
    plain = F.when(F.col("_refused").isNull() & F.col("_again").isNull(), items(F.col("x")))
    stated = [make(F.col("x")).alias(f"_h_{name}") for name, make in head.items()]
    listed = told.select(*keep, *stated, "_refused", "_again", plain.alias("_items"))
    held = (*keep, *[f"_h_{name}" for name in head], "_refused")
    # An odd document has one row here, with its text; of the others only items go on.
    first = listed.select(*held, "_again", F.posexplode_outer("_items").alias("_pos", "_item"))
    written = first.select(*held, "_pos", "_item", unify(F.col("_again")).alias("_new"))
    reread = F.explode_outer(F.array(parse_xml(F.col("_new.doc"), schema, mode))).alias("_y")
    both = written.select(
        *held, "_pos", "_item", F.col("_new.error").alias("_error"), F.col("_new.doc").isNotNull().alias("_odd"), reread
    )
    failed = F.when(F.col("_error").isNotNull(), F.concat(F.lit("second reading: "), F.col("_error")))
    failed = failed.when(F.col("_odd") & F.col(f"_y.{_CORRUPT}").isNotNull(), "second reading: not parsed")
    final = both.select(*held, "_pos", "_item", "_odd", "_y", F.coalesce("_refused", failed).alias("reason"))
    anew = F.transform(items(F.col("_y")), lambda item, n: F.struct(n.alias("pos"), item.alias("item")))
    own = F.array(F.struct(F.col("_pos").alias("pos"), F.col("_item").alias("item")))
    found = F.when(F.col("_odd"), F.when(F.col("reason").isNull(), anew)).otherwise(own)
    titled = {n: F.when(F.col("_odd"), make(F.col("_y"))).otherwise(F.col(f"_h_{n}")) for n, make in head.items()}
    named = [F.when(F.col("reason").isNull(), text).alias(n) for n, text in titled.items()]
    rows = final.select(*keep, *named, "reason", found.alias("_found"))
    rows = rows.select(*keep, *head, "reason", F.explode_outer("_found").alias("_found"))
    return rows.select(*keep, *head, "reason", "_found.pos", "_found.item")


def exploded(df: DataFrame, array: str, item: str, pos: str = "pos") -> DataFrame:
    """One row per element of an array column, with its position.

    Outer and filtered afterwards: a plain explode lets the optimizer infer a
    size check, which would compute the array a second time.
    """
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def read_plain(
    raw: DataFrame, doc: str = "doc", keep: tuple[str, ...] = (), item_tags: tuple[str, ...] = ITEM_TAGS
) -> DataFrame:
    """``keep``, ``_doc`` and ``_plain``: the plain documents in rows of a few items, the others as they are.

    ``_plain`` has the header texts of a document and ``items``, each with its position
    and field texts; a plain document without items has one row of none.  ``_doc`` has
    the text of a document that only the XML parser reads.
    """
    names = ("superProvider", "storeId")
    fields = [tags for tags, _ in PRICE_FIELDS.values()]
    item = T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in PRICE_FIELDS]])
    told = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("items", T.ArrayType(item))])
    rows = raw.select(*keep, F.col(doc).alias("_doc"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("_doc", T.StringType()), T.StructField("_plain", told)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PlainPrices(fields, item_tags, ("ChainId", "StoreId"), WHITE_SPACE)
        for batch in batches:
            for part in slices(batch, "_doc", PLAIN_BYTES):
                docs = part.column("_doc").cast(pa.string())
                plain, of, texts, head = reader.read(docs)
                counts = np.bincount(of, minlength=len(docs))
                first = np.cumsum(counts) - counts
                pos = np.arange(len(of)) - np.repeat(first, counts)
                items = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), *texts], ["pos", *PRICE_FIELDS])
                each = np.maximum(-(-counts // PLAIN_ITEMS), 1)
                row = np.repeat(np.arange(len(docs)), each)
                start = first[row] + PLAIN_ITEMS * (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(of)), pa.int32()), items)
                at = pa.array(row)
                found = pa.StructArray.from_arrays([*[h.take(at) for h in head], lists], [*names, "items"], mask=pa.array(~plain[row]))
                left = docs.take(pa.array(row, mask=plain[row]))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in keep], left, found], [*keep, "_doc", "_plain"])

    return rows.mapInArrow(read, schema)


def price_items(
    raw: DataFrame,
    doc: str = "doc",
    keep: tuple[str, ...] = (),
    item_tags: tuple[str, ...] = ITEM_TAGS,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """One row per item: ``keep``, ``reason``, ``superProvider``, ``storeId``, ``pos`` and the text of each field.

    ``reason`` says why a document is rejected whole, in a row without ``pos``, and is
    null for the others.  The items are all children of the first ``Items`` child of
    the root, whatever their tag, in document order.  Plain documents are read as
    columns (:func:`read_plain`), the others by the XML parser; where that takes a
    second parse (several item tags, tags beyond ``item_tags``, two aliases of a field
    in one item), and only there, the document is parsed again with one name for each.
    """
    aliases = [tags for tags, _ in PRICE_FIELDS.values() if len(tags) > 1]

    def doubled(item: Column) -> Column:
        found = [filled(*[item[tag] for tag in tags]) > 1 for tags in aliases]
        return reduce(lambda a, b: a | b, found)

    def children(x: Column) -> list[Column]:
        container = F.get(x["Items"], F.lit(0))
        return [container[tag] for tag in item_tags]

    def odd(x: Column, _: Column) -> Column:
        mixed = (filled(F.get(x["Items"], F.lit(0))[ANY]) > 0) | (filled(*children(x)) > 1)
        return mixed | F.coalesce(F.exists(join_arrays(*children(x)), doubled), F.lit(False))

    head = {"superProvider": lambda x: first_text(x["ChainId"]), "storeId": lambda x: first_text(x["StoreId"])}
    unify = unified_prices(item_tags[0], aliases)
    found = read_plain(raw, doc, keep, item_tags)
    rows = read_items(
        found, price_schema(item_tags), head, lambda x: join_arrays(*children(x)), odd, unify, "_doc", (*keep, "_plain"), mode
    )
    plain = F.col("_plain").isNotNull()
    texts = [first_text(*[F.col(f"item.{tag}") for tag in tags]).alias(name) for name, (tags, _) in PRICE_FIELDS.items()]
    listed = F.when(plain, F.col("_plain.items")).otherwise(F.array(F.struct("pos", *texts)))
    told = [F.when(plain, F.col(f"_plain.{name}")).otherwise(F.col(name)).alias(name) for name in head]
    reason = F.when(~plain, F.col("reason")).alias("reason")
    return rows.select(*keep, reason, *told, F.explode_outer(listed).alias("_found")).select(*keep, "reason", *head, "_found.*")


def _price_rows(items: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The record columns of exploded items."""
    # Texts first, values second: the values look at their text several times.
    return items.select(*keep, "pos", "superProvider", "storeId", *price_columns())


def parse_prices(
    raw: DataFrame,
    doc: str = "doc",
    keep: tuple[str, ...] = (),
    item_tags: tuple[str, ...] = ITEM_TAGS,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """One row per item: ``keep`` columns, ``pos``, then the 18 record columns.

    A rejected document gives no rows (see :func:`price_outcomes` for both from one
    parse, :func:`quarantine` for the rejected ones alone); with ``mode="FAILFAST"``
    it fails the query.
    """
    # Only the header texts travel with each item, never the whole document.
    return _price_rows(price_items(raw, doc, keep, item_tags, mode).where("pos IS NOT NULL"), keep)


def price_outcomes(
    raw: DataFrame, doc: str = "doc", keep: tuple[str, ...] = (), item_tags: tuple[str, ...] = ITEM_TAGS
) -> DataFrame:
    """The rows of :func:`parse_prices` and one row for each rejected document, from one parse.

    ``reason`` tells them apart: null for an item, else why the document was rejected
    (its record columns are null).
    """
    rows = price_items(raw, doc, keep, item_tags)
    return _price_rows(rows.where("pos IS NOT NULL OR reason IS NOT NULL"), (*keep, "reason"))


def quarantine(raw: DataFrame, schema: str | None = None, doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``reason`` of the documents that are rejected whole, none of whose records are emitted.

    Price documents, unless the schema is that of promotions.
    """
    if schema is not None and schema != price_schema():
        from feedline.operators.promotions import promotion_list

        return promotion_list(raw, doc, keep).where("reason IS NOT NULL").select(*keep, "reason")
    return price_items(raw, doc, keep).where("reason IS NOT NULL").select(*keep, "reason")


def with_typed_times(prices: DataFrame) -> DataFrame:
    """Add TIMESTAMP twins of the two time texts."""
    return prices.withColumns(
        {
            "updateTs": typed_ts(F.col("updateTime")),
            "lastSaleTs": typed_ts(F.col("lastSaleDateTime")),
        }
    )
