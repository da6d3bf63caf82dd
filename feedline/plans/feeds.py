"""Queries of the price and promotion feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedline.functions import text as T
from feedline.operators import prices, promotions
from feedline.plans import expected as E
from feedline.plans import rendering as R
from feedline.plans.registry import query
from feedline.sources.raw import documents


def price_feed(spark, sf_dir):
    """Price documents as stored files, every other supplier's gzipped."""
    docs = R.price_documents(spark, sf_dir)
    files = R.as_files(docs, F.col("l_suppkey") % 2 == 0)
    return documents(files, ("file",)).drop("error")


_KEY = """'72900' || s_nationkey AS "superProvider", lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS "storeId",
          lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS "itemCode\""""

_RECORD = f"""
    {_KEY}, CAST(p_size % 2 AS DOUBLE) AS "itemType", p_name AS "itemName", p_type AS "itemDescription",
    p_brand AS "manufactureName", 'N' || s_nationkey AS "manufactureCountry", 'Unit' AS "unitQuantity",
    l_quantity AS quantity, CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'unit' END AS "unitOfMeasure",
    CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS weighted,
    CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS "inPackage", l_extendedprice AS price,
    l_returnflag IN ('A', 'N') AS "allowDiscount", l_linestatus AS "itemStatus",
    strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "updateTime",
    CASE WHEN l_suppkey % 4 <> 3 THEN strftime(l_shipdate, '%Y-%m-%d') END AS "lastSaleDateTime\""""


@query(
    "prc_01_price_feed",
    f"""
    WITH {E.OFFERS}
    SELECT 'PriceFull-' || l_suppkey || '-' || (l_partkey // {R.ITEMS_PER_DOCUMENT}) || '.gz' AS file,
           CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey // {R.ITEMS_PER_DOCUMENT} ORDER BY l_partkey) - 1 AS INTEGER) AS pos,
           {_KEY} FROM offers""",
)
def price_rows(spark, sf_dir):
    found = prices.parse_prices(price_feed(spark, sf_dir), keep=("file",))
    return found.select("file", "pos", "superProvider", "storeId", "itemCode")


@query(
    "prc_02_tag_lookup",
    """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_name WHEN 3 THEN p_type END AS name
    FROM part""",
)
def tag_lookup(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    name, brand, other = (R.escape(F.col(c)) for c in ("p_name", "p_brand", "p_type"))
    leaves = (
        F.when(kind == 0, F.concat(R.element("itemname", F.concat(F.lit("\n "), name, F.lit("\t"))), R.element("ItemName", "later")))
        .when(kind == 1, F.concat(R.element("ItemName", " "), R.element("ITEMNM", brand)))
        .when(kind == 2, F.concat(R.element("ITEMNAME", " "), F.lit("<ItemName/>"), R.element("ItemName", name)))
        .when(kind == 3, F.concat(F.lit("<ItemNm><![CDATA["), other, F.lit("]]></ItemNm>")))
        .otherwise(F.concat(R.element("ItemNames", "no"), R.element("Sub", R.element("ItemName", "deeper"))))
    )
    docs = R.table(spark, sf_dir, "part").select(
        "p_partkey", R.element("Root", R.element("Items", R.element("Item", leaves))).alias("doc")
    )
    found = prices.parse_prices(docs, keep=("p_partkey",))
    return found.select("p_partkey", F.col("itemName").alias("name"))


_NUMBERS = (
    (lambda v: R.text(v), "l_quantity"),
    (lambda v: F.concat(F.lit("\t+"), R.text(v), F.lit(" ")), "l_quantity"),
    (lambda v: F.concat(R.text(v), F.lit("d")), "NULL"),
    (lambda v: F.concat(F.lit("1_"), R.text(v.cast("int"))), "CAST('1' || CAST(l_quantity AS INTEGER) AS DOUBLE)"),
    (lambda v: F.lit("0x1p3"), "NULL"),
    (lambda v: F.concat(F.lit("-."), R.text(v.cast("int")), F.lit("e1")), "-CAST('.' || CAST(l_quantity AS INTEGER) || 'e1' AS DOUBLE)"),
    (lambda v: F.lit(""), "NULL"),
    (lambda v: F.lit("1__0"), "NULL"),
    (lambda v: F.concat(R.text(v.cast("int")), F.lit(".")), "l_quantity"),
)


@query(
    "prc_03_number",
    "SELECT l_orderkey, l_linenumber, CASE l_partkey % 9 "
    + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(_NUMBERS))
    + " END AS number FROM lineitem",
)
def number(spark, sf_dir):
    written = [make(F.col("l_quantity")) for make, _ in _NUMBERS]
    picked = F.get(F.array(*written), (F.col("l_partkey") % len(written)).cast("int"))
    return R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.to_number(picked).alias("number"))


@query(
    "prc_04_boolean",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 < 3 THEN true WHEN l_partkey % 7 < 6 THEN false END AS flag FROM lineitem",
)
def boolean(spark, sf_dir):
    written = F.array(*[F.lit(v) for v in ("1", " true ", "True", "TRUE", "2", "y", None)])
    picked = F.get(written, (F.col("l_partkey") % 7).cast("int"))
    return R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.to_bool(picked).alias("flag"))


@query(
    "prc_05_timestamp_text",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
        WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d/%mT') || o_orderkey END AS iso,
      CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS typed
    FROM orders""",
)
def timestamp_text(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    written = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 2, F.concat(F.date_format("o_orderdate", "dd/MM"), F.lit(" "), R.text("o_orderkey")))
        .otherwise("")
    )
    iso = T.iso_ts(written)
    return R.table(spark, sf_dir, "orders").select(
        "o_orderkey", iso.alias("iso"), F.date_format(T.typed_ts(iso), "yyyy-MM-dd HH:mm:ss").alias("typed")
    )


@query(
    "prc_06_items_container",
    """
    SELECT p_partkey, unnest(CASE p_partkey % 4
        WHEN 0 THEN [CAST(p_partkey AS VARCHAR), 'b']
        WHEN 1 THEN [CAST(p_partkey AS VARCHAR)]
        WHEN 2 THEN [CAST(p_partkey AS VARCHAR), 'b', NULL]
        ELSE [] END) AS "itemCode"
    FROM part""",
)
def items_container(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    code = R.element("ItemCode", R.text("p_partkey"))
    item, second = R.element("Item", code), R.element("item", R.element("ITEMCODE", "b"))
    body = (
        F.when(kind == 0, F.concat(R.element("Other", R.element("Items", item)), R.element("ITEMS", F.concat(item, second))))
        .when(kind == 1, F.concat(R.element("items", item), R.element("Items", second)))
        .when(kind == 2, R.element("Items", F.concat(item, R.element("Product", R.element("ItemCode", "b")), F.lit("<Product/>"))))
        .otherwise(R.element("Nothing", item))
    )
    docs = R.table(spark, sf_dir, "part").select("p_partkey", R.element("Root", body).alias("doc"))
    return prices.parse_prices(docs, keep=("p_partkey",)).select("p_partkey", "itemCode")


@query(
    "prc_06_items_any_tag",
    """
    SELECT p_partkey, CAST(n - 1 AS INTEGER) AS pos, codes[n] AS "itemCode", CASE WHEN n = 1 THEN p_name END AS "itemName"
    FROM (SELECT p_partkey, p_name, codes, unnest(range(1, len(codes) + 1)) AS n
          FROM (SELECT p_partkey, p_name, CASE p_partkey % 3
                  WHEN 0 THEN [CAST(p_partkey AS VARCHAR), 'b', 'c', 'd'] WHEN 1 THEN [CAST(p_partkey AS VARCHAR), 'd', 'b']
                  ELSE [CAST(p_partkey AS VARCHAR), 'c'] END AS codes FROM part))""",
)
def items_any_tag(spark, sf_dir):
    """Children of three tags mixed, and two names in one item in both orders."""
    kind = F.col("p_partkey") % 3
    right, wrong = R.escape(F.col("p_name")), F.lit("later")
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat(R.element("ItemNm", right), R.element("ItemName", wrong)))
    named = named.otherwise(F.concat(R.element("ItemName", right), R.element("ITEMNM", wrong)))
    first = F.concat(R.element("ItemCode", R.text("p_partkey")), named)
    b, c, d = (R.element("ItemCode", code) for code in "bcd")
    body = (
        F.when(kind == 0, F.concat(R.element("Line", first), R.element("Item", b), R.element("LINE", c), R.element("Product", d)))
        .when(kind == 1, F.concat(R.element("Product", first), R.element("Item", d), R.element("Product", b)))
        .otherwise(F.concat(R.element("Row-2.a", first), F.lit("<!-- <Row> -->"), R.element("Row", c)))
    )
    docs = R.table(spark, sf_dir, "part").select("p_partkey", R.element("Root", R.element("Items", body)).alias("doc"))
    return prices.parse_prices(docs, keep=("p_partkey",)).select("p_partkey", "pos", "itemCode", "itemName")


@query("prc_07_price_records", f"WITH {E.OFFERS} SELECT {_RECORD} FROM offers")
def price_records(spark, sf_dir):
    return prices.parse_prices(price_feed(spark, sf_dir)).select(*prices.PRICE_COLUMNS)


@query(
    "prc_08_malformed",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 10 IN (3, 7) THEN 'rejected' ELSE 'read' END AS outcome,
           CASE WHEN p_partkey % 10 IN (3, 7) THEN 0 ELSE 2 END AS n_items
    FROM part""",
)
def malformed(spark, sf_dir):
    code = R.element("Item", R.element("ItemCode", R.text("p_partkey")))
    whole = R.element("Root", R.element("Items", F.concat(code, code)))
    doc = (
        F.when(F.col("p_partkey") % 10 == 3, F.substring(whole, F.lit(1), F.length(whole) - 12))
        .when(F.col("p_partkey") % 10 == 7, F.concat(whole, F.lit("<more>")))
        .otherwise(F.concat(F.lit("<?xml version='1.0'?>\n"), whole, F.lit("\n<!-- end -->\n")))
    )
    docs = R.table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))
    read = prices.parse_prices(docs, keep=("p_partkey",)).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_items"))
    bad = prices.quarantine(docs, prices.price_schema(), keep=("p_partkey",))
    return read.select("p_partkey", F.lit("read").alias("outcome"), "n_items").unionByName(
        bad.select("p_partkey", F.lit("rejected").alias("outcome"), F.lit(0).cast("bigint").alias("n_items"))
    )


@query(
    "prc_06_items_under_field_names",
    """
    SELECT p_partkey // 100 AS bucket, CAST(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS INTEGER) AS pos,
           CAST(p_partkey AS VARCHAR) AS "itemCode", p_name AS "itemName"
    FROM part""",
)
def items_under_field_names(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    tag = F.when(kind == 0, "Quantity").when(kind == 1, "itemname").when(kind == 2, "Item").otherwise("Row")
    name = R.escape(F.col("p_name"))
    # The name under either alias; where under both, the first in the document counts.
    fields = F.concat(
        R.element("ItemCode", R.text("p_partkey")), R.element("ItemNm", name), F.when(kind == 3, R.element("ItemName", "later")).otherwise("")
    )
    xml = F.concat(F.lit("<"), tag, F.lit(">"), fields, F.lit("</"), tag, F.lit(">"))
    rows = R.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("bucket"), F.struct("p_partkey", xml.alias("xml")).alias("row"))
    docs = rows.groupBy("bucket").agg(R.element("Root", R.element("Items", R.joined(F.collect_list("row")))).alias("doc"))
    return prices.parse_prices(docs, keep=("bucket",)).select("bucket", "pos", "itemCode", "itemName")


@query(
    "prc_08_outcomes",
    """
    SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN 'not well-formed' WHEN 5 THEN 'no text' END AS reason,
           CASE WHEN p_partkey % 10 NOT IN (3, 5) THEN CAST(p_partkey AS VARCHAR) END AS "itemCode"
    FROM part""",
)
def outcomes(spark, sf_dir):
    kind = F.col("p_partkey") % 10
    code = R.element("ItemCode", R.text("p_partkey"))
    whole = R.element("Root", R.element("Items", R.element("Item", code)))
    # These need a second reading.
    other = R.element("Root", R.element("Items", R.element("Line", code)))
    doc = F.when(kind == 3, F.concat(whole, F.lit("<more>"))).when(kind == 7, other).when(kind != 5, whole)
    docs = R.table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))
    return prices.price_outcomes(docs, keep=("p_partkey",)).select("p_partkey", "reason", "itemCode")


def promotion_feed(spark, sf_dir):
    """Promotion documents as stored files, every other one gzipped."""
    files = R.as_files(R.promotion_documents(spark, sf_dir), F.col("bucket") % 2 == 0)
    return documents(files, ("file",)).drop("error")


_N = R.PROMOTIONS_PER_DOCUMENT

_ITEM_VALUES = """
    l_orderkey % 4 AS dt,
    CASE WHEN l_linenumber % 3 = 0 THEN l_quantity
         WHEN l_orderkey % 2 = 0 AND l_orderkey % 5 = 0 THEN NULL
         WHEN l_orderkey % 2 = 0 AND l_orderkey % 5 <> 1 THEN l_suppkey % 2 + 3
         WHEN l_orderkey % 3 = 0 THEN 2 END AS mn,
    CASE WHEN l_linenumber % 2 <> 0 THEN l_quantity END AS mx,
    CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice WHEN l_orderkey % 2 = 1 THEN o_totalprice END AS dp,
    CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 2 + 0.5 END AS pm"""


@query(
    "prm_01_promotion_feed",
    f"""
    SELECT 'PromoFull-' || (o_orderkey // {_N}) || '.gz' AS file, CAST(o_orderkey AS VARCHAR) AS "promotionId",
           'C' || ((o_orderkey // {_N}) % 7) AS "providerId", 'S' || ((o_orderkey // {_N}) % 11) AS "storeId",
           o_orderpriority AS description
    FROM orders""",
)
def promotion_rows(spark, sf_dir):
    found = promotions.parse_promotions(promotion_feed(spark, sf_dir), keep=("file",))
    return found.select("file", "promotionId", "providerId", "storeId", "description")


@query(
    "prm_01_mixed_promotions",
    f"""
    WITH {E.LINES}, items AS (
      SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber) AS codes FROM lines GROUP BY l_orderkey),
    found AS (
      SELECT o_orderkey, 0 AS inner_one, CAST(o_orderkey AS VARCHAR) AS id, coalesce(codes, '') AS codes, o_orderdate
      FROM orders LEFT JOIN items ON o_orderkey = l_orderkey
      UNION ALL SELECT o_orderkey, 1, o_orderkey || '-inner', 'inner', o_orderdate FROM orders WHERE o_orderkey % 4 = 2)
    SELECT o_orderkey // {_N} AS bucket,
           CAST(row_number() OVER (PARTITION BY o_orderkey // {_N} ORDER BY o_orderkey, inner_one) - 1 AS INTEGER) AS pos,
           id AS "promotionId", codes,
           CASE WHEN inner_one = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS "startTime"
    FROM found""",
)
def mixed_promotions(spark, sf_dir):
    docs = R.mixed_promotion_documents(spark, sf_dir)
    found = promotions.parse_promotions(docs, keep=("bucket",))
    codes = F.array_join(F.transform("items", lambda i: i["itemCode"]), ",")
    return found.select("bucket", "pos", "promotionId", codes.alias("codes"), "startTime")


@query(
    "prm_02_group_shapes",
    f"""
    WITH {E.LINES}
    SELECT CAST(o_orderkey AS VARCHAR) AS "promotionId",
           count(l_orderkey) AS n_items,
           coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY
             CASE WHEN o_orderkey % 2 = 0 THEN l_suppkey % 2 ELSE 0 END, l_linenumber), '') AS codes
    FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def group_shapes(spark, sf_dir):
    found = promotions.parse_promotions(promotion_feed(spark, sf_dir))
    codes = F.transform("items", lambda i: i["itemCode"])
    return found.select(
        "promotionId", F.size("items").cast("bigint").alias("n_items"), F.array_join(codes, ",").alias("codes")
    )


@query(
    "prm_03_inheritance",
    f"""
    WITH {E.LINES}, v AS (SELECT l_orderkey, l_linenumber, {_ITEM_VALUES} FROM lines JOIN orders ON l_orderkey = o_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS "promotionId", CAST(dt AS DOUBLE) AS "discountType", CAST(mn AS DOUBLE) AS "minQty",
           CAST(mx AS DOUBLE) AS "maxQty", CAST(dp AS DOUBLE) AS "discountPrice", CAST(pm AS DOUBLE) AS "discountedPricePerMida"
    FROM v""",
)
def inheritance(spark, sf_dir):
    rows = promotions.promotion_items(promotions.parse_promotions(promotion_feed(spark, sf_dir)))
    return rows.select("promotionId", *promotions.INHERITED)


@query(
    "prm_04_item_container",
    f"""
    WITH {E.LINES}
    SELECT 'PromoFull-' || (l_orderkey // {_N}) || '.gz' AS file, count(*) AS n_items,
           count(*) FILTER (l_linenumber % 3 <> 2) AS n_typed
    FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def item_container(spark, sf_dir):
    rows = promotions.promotion_items(promotions.parse_promotions(promotion_feed(spark, sf_dir), keep=("file",)))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_items"), F.count("itemType").alias("n_typed"))


@query(
    "prm_05_split_hours",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS "promotionId",
      strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T08:30:00'
        WHEN o_orderkey % 7 = 0 THEN 'T00:00:00' ELSE 'T09:15:00' END AS "startTime",
      CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T20:00:00'
        WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' END AS "endTime",
      strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T01:02:03' ELSE 'T00:00:00' END AS "updateTime"
    FROM orders""",
)
def split_hours(spark, sf_dir):
    found = promotions.parse_promotions(promotion_feed(spark, sf_dir))
    return found.select("promotionId", "startTime", "endTime", "updateTime")


@query(
    "prm_06_nested_records",
    f"""
    WITH {E.LINES}, v AS (
      SELECT *, l_suppkey % 2 AS g, {_ITEM_VALUES} FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)
    SELECT CAST(o_orderkey AS VARCHAR) AS "promotionId", 'C' || ((o_orderkey // {_N}) % 7) AS "providerId",
           coalesce(string_agg(l_partkey || ':' || coalesce(CAST(CAST(mn AS INTEGER) AS VARCHAR), '-') || ':'
             || coalesce(CAST(CAST(mx AS INTEGER) AS VARCHAR), '-'), ' '
             ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN g ELSE 0 END, l_linenumber) FILTER (l_partkey IS NOT NULL), '') AS items
    FROM v GROUP BY o_orderkey""",
)
def nested_records(spark, sf_dir):
    found = promotions.parse_promotions(promotion_feed(spark, sf_dir))

    def shown(col):
        return F.coalesce(col.cast("int").cast("string"), F.lit("-"))

    items = F.transform("items", lambda i: F.concat_ws(":", i["itemCode"], shown(i["minQty"]), shown(i["maxQty"])))
    return found.select("promotionId", "providerId", F.array_join(items, " ").alias("items"))


@query(
    "prm_07_item_records",
    f"""
    WITH {E.LINES}
    SELECT CAST(l_orderkey AS VARCHAR) AS "promotionId", CAST(l_partkey AS VARCHAR) AS "itemCode",
           CASE WHEN l_linenumber % 3 <> 2 THEN CAST(l_linenumber % 3 AS DOUBLE) END AS "itemType",
           CASE WHEN l_linenumber % 2 <> 0 THEN l_quantity END AS "maxQty"
    FROM lines JOIN orders ON l_orderkey = o_orderkey""",
)
def item_records(spark, sf_dir):
    rows = promotions.promotion_items(promotions.parse_promotions(promotion_feed(spark, sf_dir)))
    return rows.select("promotionId", "itemCode", "itemType", "maxQty")


@query(
    "prm_08_promotion_items",
    f"""
    WITH {E.LINES}, v AS (SELECT l_orderkey, l_partkey, o_orderpriority, {_ITEM_VALUES} FROM lines JOIN orders ON l_orderkey = o_orderkey)
    SELECT o_orderpriority AS description, CAST(dt AS DOUBLE) AS "discountType", count(*) AS n_items,
           count(DISTINCT l_partkey) AS n_codes, CAST(sum(mn) AS DOUBLE) AS min_qty
    FROM v GROUP BY ALL""",
)
def promotion_item_table(spark, sf_dir):
    rows = promotions.promotion_items(promotions.parse_promotions(promotion_feed(spark, sf_dir)))
    return rows.groupBy("description", "discountType").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.countDistinct("itemCode").alias("n_codes"),
        F.sum("minQty").alias("min_qty"),
    )
