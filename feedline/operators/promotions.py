"""Promotion feeds: grouped or flat documents into one record shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedline.functions.text import first_text, iso_ts_hour, number_of
from feedline.functions.unify import unified_promotions
from feedline.operators.prices import ANY, exploded, filled, join_arrays, read_items

# Fields a promotion or group states for its items.
INHERITED = {
    "discountType": "DiscountType",
    "minQty": "MinQty",
    "maxQty": "MaxQty",
    "discountPrice": "DiscountedPrice",
    "discountedPricePerMida": "DiscountedPricePerMida",
}

# The usual tags of the container's children; any other child is an item too.
PROMOTION_ITEM_TAGS = ("PromotionItem", "Item")

_PROMOTION_TAGS = (
    "PromotionID", "PromotionDescription",
    "PromotionStartDateTime", "PromotionStartDate", "PromotionStartHour",
    "PromotionEndDateTime", "PromotionEndDate", "PromotionEndHour",
    "PromotionUpdateTime", "PromotionUpdateDate",
)


# Tags of one field; the first in the document counts.
_ALIASES = (
    ("PromotionStartDateTime", "PromotionStartDate"),
    ("PromotionEndDateTime", "PromotionEndDate"),
    ("PromotionUpdateTime", "PromotionUpdateDate"),
)


def _leaves(*tags: str) -> str:
    return ", ".join(f"{tag}: ARRAY<STRING>" for tag in tags)


def promotion_schema() -> str:
    """Schema of a promotion document; promotions under the root or ``Promotions``."""
    levels = _leaves(*INHERITED.values())
    item = f"STRUCT<{_leaves('ItemCode', 'ItemType')}, {levels}>"
    container = "STRUCT<" + ", ".join(f"{t}: ARRAY<{item}>" for t in PROMOTION_ITEM_TAGS)
    container += f", {ANY}: ARRAY<STRING>>"
    group = f"STRUCT<{levels}, PromotionItems: ARRAY<{container}>>"
    promotion = (
        f"STRUCT<{_leaves(*_PROMOTION_TAGS)}, {levels}, "
        f"Groups: ARRAY<STRUCT<Group: ARRAY<{group}>>>, PromotionItems: ARRAY<{container}>>"
    )
    return (
        "ChainID ARRAY<STRING>, StoreID ARRAY<STRING>, "
        f"Promotions ARRAY<STRUCT<Promotion: ARRAY<{promotion}>>>, Promotion ARRAY<{promotion}>, "
        "_corrupt STRING"
    )


def _odd_items(promotion: Column) -> Column:
    """Whether a container of the promotion holds foreign or several item tags."""
    groups = join_arrays(F.flatten(F.filter(F.transform(promotion["Groups"], lambda g: g["Group"]), lambda g: g.isNotNull())))
    held = F.flatten(F.filter(F.transform(groups, lambda g: g["PromotionItems"]), lambda c: c.isNotNull()))
    containers = join_arrays(held, promotion["PromotionItems"])
    return F.exists(
        containers, lambda c: (filled(c[ANY]) > 0) | (filled(*[c[t] for t in PROMOTION_ITEM_TAGS]) > 1)
    )


def _doubled(promotion: Column) -> Column:
    """Whether the promotion states a field under two aliases."""
    found = [filled(*[promotion[tag] for tag in tags]) > 1 for tags in _ALIASES]
    return reduce(lambda a, b: a | b, found)


def inherit(*levels: Column) -> Column:
    """Text stated at the nearest of several levels, nearest first.

    The text is chosen before it is read as a number, so a non-numeric text
    at a near level hides a number further up.
    """
    return F.coalesce(*levels)


def _group_texts(group: Column) -> Column:
    """One group with its stated texts over the promotion's (columns ``_p_…``)."""
    container = F.get(group["PromotionItems"], F.lit(0))
    return F.struct(
        *[inherit(first_text(group[tag]), F.col(f"_p_{name}")).alias(name) for name, tag in INHERITED.items()],
        join_arrays(*[container[tag] for tag in PROMOTION_ITEM_TAGS]).alias("items"),
    )


def _item_texts(group: Column) -> Column:
    """Texts of one group's items, what the levels above state pushed down."""
    return F.transform(
        group["items"],
        lambda item: F.struct(
            first_text(item["ItemCode"]).alias("itemCode"),
            first_text(item["ItemType"]).alias("itemType"),
            *[inherit(first_text(item[tag]), group[name]).alias(name) for name, tag in INHERITED.items()],
        ),
    )


def _item_record(texts: Column) -> Column:
    return F.struct(
        texts["itemCode"].alias("itemCode"),
        *[number_of(texts[name]).alias(name) for name in ("itemType", *INHERITED)],
    )


def promotion_list(
    raw: DataFrame, doc: str = "doc", keep: tuple[str, ...] = (), mode: str = "PERMISSIVE"
) -> DataFrame:
    """One row per promotion: ``keep``, ``providerId``, ``storeId``, ``reason``, ``pos`` and ``p``.

    ``reason`` says why a document is rejected whole, in a row without ``pos``, and is
    null for the others.
    Promotions are read at any depth, also inside each other, in the order they
    begin, and their items are all children of the first ``PromotionItems``.  The
    schema knows promotions below the root and its ``Promotions`` and two item tags;
    documents with others, with several that lose their order, or with two aliases of
    a field, and only those, are parsed once more.
    """

    def near(x: Column) -> tuple[Column, Column]:
        # An element without promotions has a null list; it must not empty the others.
        held = F.transform(x["Promotions"], lambda p: p["Promotion"])
        below = F.flatten(F.filter(held, lambda p: p.isNotNull()))
        return below, join_arrays(below, x["Promotion"])

    def odd(x: Column, text: Column) -> Column:
        below, listed = near(x)
        opened = F.regexp_count(text, F.lit(r"(?i)<(?:[^\s<>/:]+:)?promotion(?=[\s/>])"))
        mixed = (opened != F.size(listed)) | (filled(below, x["Promotion"]) > 1)
        return mixed | F.coalesce(F.exists(listed, lambda p: _odd_items(p) | _doubled(p)), F.lit(False))

    head = {"providerId": lambda x: first_text(x["ChainID"]), "storeId": lambda x: first_text(x["StoreID"])}
    unify = unified_promotions(PROMOTION_ITEM_TAGS[0], list(_ALIASES))
    rows = read_items(raw, promotion_schema(), head, lambda x: near(x)[1], odd, unify, doc, keep, mode)
    return rows.withColumnRenamed("item", "p")


def parse_promotions(
    raw: DataFrame, doc: str = "doc", keep: tuple[str, ...] = (), mode: str = "PERMISSIVE"
) -> DataFrame:
    """One row per promotion: ``keep`` columns, ``pos``, then the 8 record columns.

    A promotion with groups ignores items hung directly on it; one without is
    its own single group.  ``items`` is never null.  A rejected document gives no
    rows (see :func:`promotion_outcomes`).
    """
    # Only the header texts travel with each promotion, never the whole document.
    return _promotion_rows(promotion_list(raw, doc, keep, mode).where("pos IS NOT NULL"), keep)


def promotion_outcomes(raw: DataFrame, doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of :func:`parse_promotions` and one row for each rejected document, from one parse.

    ``reason`` is null for a promotion, else why the document was rejected.
    """
    rows = promotion_list(raw, doc, keep)
    return _promotion_rows(rows.where("pos IS NOT NULL OR reason IS NOT NULL"), (*keep, "reason"))


def _promotion_rows(promotions: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The record columns of exploded promotions."""
    p = F.col("p")
    own = F.struct(
        *[p[tag].alias(tag) for tag in INHERITED.values()], p["PromotionItems"].alias("PromotionItems")
    )
    stated = F.flatten(
        F.filter(F.transform(p["Groups"], lambda g: g["Group"]), lambda g: g.isNotNull())
    )
    groups = F.when(F.size(stated) > 0, stated).otherwise(F.array(own))

    def text(*tags: str) -> Column:
        return first_text(*[p[tag] for tag in tags])

    levelled = promotions.select(
        "*", *[text(tag).alias(f"_p_{name}") for name, tag in INHERITED.items()], groups.alias("_groups")
    )
    # Texts first, values second: the values look at their text several times.
    texts = levelled.select(
        *keep,
        "pos",
        text("PromotionID").alias("promotionId"),
        "providerId",
        "storeId",
        text("PromotionDescription").alias("description"),
        text("PromotionStartDateTime", "PromotionStartDate").alias("_start"),
        text("PromotionStartHour").alias("_start_hour"),
        text("PromotionEndDateTime", "PromotionEndDate").alias("_end"),
        text("PromotionEndHour").alias("_end_hour"),
        text("PromotionUpdateTime", "PromotionUpdateDate").alias("_update"),
        F.flatten(F.transform(F.transform("_groups", _group_texts), _item_texts)).alias("_items"),
    )
    return texts.select(
        *keep,
        "pos",
        "promotionId",
        "providerId",
        "storeId",
        "description",
        iso_ts_hour(F.col("_start"), F.col("_start_hour")).alias("startTime"),
        iso_ts_hour(F.col("_end"), F.col("_end_hour")).alias("endTime"),
        iso_ts_hour(F.col("_update")).alias("updateTime"),
        F.transform("_items", _item_record).alias("items"),
    )


def promotion_items(promotions: DataFrame) -> DataFrame:
    """One row per promotion item with the promotion's columns; none for an empty promotion."""
    rest = [c for c in promotions.columns if c != "items"]
    return exploded(promotions.select(*rest, "items"), "items", "_item", "_at").select(*rest, "_item.*")
