"""Price and promotion documents, file handling and CSV."""

import datetime
import gzip
import re

import pytest
from pyspark.sql import functions as F

from feedline.operators import prices, promotions
from feedline.sources import listings, marks, raw, records


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path STRING, doc STRING")


DRIFTED = """<?xml version="1.0" encoding="utf-8"?>
<root><CHAINID a="1"> 7290 </CHAINID><storeid>001</storeid><Other><Items><Item><ItemCode>no</ItemCode></Item></Items></Other>
<ITEMS Count="2"><Item><itemcode>007</itemcode><ItemName> </ItemName><ITEMNAME>Milk &amp; co</ITEMNAME>
<ManufactureName>m</ManufactureName><blsWeighted>TRUE</blsWeighted><ItemPrice>x</ItemPrice><Quantity>1.50</Quantity>
<PriceUpdateDate>2024-01-02 03:04:05</PriceUpdateDate></Item><Product><ItemCode>8</ItemCode><bIsWeighted>1</bIsWeighted></Product>
<Item/></ITEMS><Items><Item><ItemCode>second</ItemCode></Item></Items></root>"""


def test_price_document(spark):
    rows = prices.parse_prices(docs(spark, DRIFTED)).orderBy("pos").collect()
    assert [r.itemCode for r in rows] == ["007", "8", None]
    first = rows[0]
    assert (first.superProvider, first.storeId, first.itemName) == ("7290", "001", "Milk & co")
    assert (first.weighted, first.price, first.quantity) == (False, None, 1.5)
    assert (first.updateTime, first.lastSaleDateTime) == ("2024-01-02T03:04:05", None)
    assert rows[1].weighted is True
    assert tuple(rows[0].asDict())[1:] == prices.PRICE_COLUMNS


def test_rejected_documents(spark):
    whole = "<Root><Items><Item><ItemCode>1</ItemCode></Item></Items></Root>"
    bad = [whole[:-5], whole + "<x>", "", "no xml", None, whole.replace("</Item>", "", 1), whole + "<more></Root>", whole + whole]
    good = [whole, "\n" + whole + "\n<!-- a --> ", "<Root/>", "<Root><Items/></Root>"]
    good += ["<Root a='>'><!-- </Root> --><Root2/><Root><Root/></Root></Root>"]
    df = docs(spark, *good, *bad)
    assert prices.parse_prices(df, keep=("path",)).count() == 2
    rejected = {r.path for r in prices.quarantine(df, prices.price_schema(), keep=("path",)).collect()}
    assert rejected == {str(i) for i in range(len(good), len(good) + len(bad))}
    with pytest.raises(Exception):
        prices.parse_prices(docs(spark, bad[0]), mode="FAILFAST").collect()


def test_items_under_any_tag_in_document_order(spark):
    mixed = """<Root><ChainId>c</ChainId><Items><Line a='>'><ItemCode>1</ItemCode><ItemNm>A &amp; b</ItemNm><ItemName>z</ItemName></Line>
    <!-- <Line> --><Product><ItemCode>2</ItemCode><ItemName><![CDATA[<Line>x]]></ItemName></Product><Item><ItemCode>3</ItemCode></Item>
    <ROW/><line><ItemCode>4</ItemCode></line></Items><Items><Other/></Items></Root>"""
    twice = "<Root><Items><Item><ItemCode>5</ItemCode><ItemNm>p</ItemNm><ItemName>q</ItemName></Item></Items></Root>"
    rows = prices.parse_prices(docs(spark, mixed, twice), keep=("path",)).orderBy("path", "pos").collect()
    assert [(r.itemCode, r.itemName) for r in rows] == [
        ("1", "A & b"), ("2", "<Line>x"), ("3", None), (None, None), ("4", None), ("5", "p"),
    ]
    assert {r.superProvider for r in rows if r.path == "0"} == {"c"}


def test_items_named_like_a_field(spark):
    odd = "<Root><Items><Quantity><ItemCode>3</ItemCode></Quantity><Item><ItemCode>4</ItemCode><Quantity>2</Quantity></Item><ItemName/></Items></Root>"
    rows = prices.parse_prices(docs(spark, odd)).orderBy("pos").collect()
    assert [(r.itemCode, r.quantity) for r in rows] == [("3", None), ("4", 2.0), (None, None)]


def test_rows_and_rejects_from_one_parse(spark, plan):
    other = "<Root><Items><Line><ItemCode>3</ItemCode></Line></Items></Root>"
    df = docs(spark, "<Root><Items><Item><ItemCode>1</ItemCode></Item></Items></Root>", "<Root><Items>", None, "<Root/>", other)
    found = prices.price_outcomes(df, keep=("path",))
    rows = {r.path: (r.itemCode, (r.reason or "").split(":")[0]) for r in found.collect()}
    assert rows == {"0": ("1", ""), "1": (None, "not well-formed"), "2": (None, "no text"), "4": ("3", "")}
    optimized = plan(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("from_xml(") == 2
    assert {r.path for r in prices.quarantine(df, keep=("path",)).collect()} == {"1", "2"}


def test_what_cannot_be_written_anew_has_a_reason(spark):
    from feedline.functions.unify import unified_promotions

    found = docs(spark, "<a><b></a>", None, "<a/>").select("path", unified_promotions("Item", [])(F.col("doc")).alias("u"))
    rows = {r.path: (r.u.doc, bool(r.u.error)) for r in found.collect()}
    assert rows == {"0": (None, True), "1": (None, False), "2": ("<Root></Root>", False)}


def test_promotions_inside_promotions(spark):
    nested = """<Root><StoreID>9</StoreID><Promotion><PromotionID>1</PromotionID><PromotionStartDate>2024-01-02</PromotionStartDate>
    <PromotionStartDateTime>2020-01-01 01:00:00</PromotionStartDateTime>
    <Promotion><PromotionID>2</PromotionID><PromotionItems><Item><ItemCode>b</ItemCode></Item></PromotionItems></Promotion>
    <PromotionItems><Line><ItemCode>a</ItemCode></Line><Promotion><ItemCode>c</ItemCode><PromotionID>3</PromotionID></Promotion></PromotionItems>
    <PromotionItems><Item><ItemCode>second list</ItemCode></Item></PromotionItems></Promotion>
    <Deep><Deeper><Promotion><PromotionID>4</PromotionID></Promotion></Deeper></Deep></Root>"""
    rows = promotions.parse_promotions(docs(spark, nested)).orderBy("pos").collect()
    assert [(r.promotionId, r.storeId, [i.itemCode for i in r["items"]]) for r in rows] == [
        ("1", "9", ["a", "c"]), ("2", "9", ["b"]), ("3", "9", []), ("4", "9", []),
    ]
    # The alias that comes first in the document counts.
    assert rows[0].startTime == "2024-01-02T00:00:00"
    assert promotions.promotion_outcomes(docs(spark, nested, "<a>"), keep=("path",)).where("reason IS NOT NULL").count() == 1


def test_a_promotion_as_root_and_long_documents(spark):
    root = "<Promotion><ChainID>7</ChainID><PromotionID>1</PromotionID></Promotion>"
    many = "<Root>" + "<W><Promotion><PromotionID>x</PromotionID></Promotion></W>" * 5000 + "</Root>"
    rows = promotions.parse_promotions(docs(spark, root, many), keep=("path",))
    assert [(r.promotionId, r.providerId) for r in rows.where("path = '0'").collect()] == [("1", "7")]
    assert rows.where("path = '1'").count() == 5000


GROUPED = """<Root><ChainID>C</ChainID><StoreID>S</StoreID><Promotions><Promotion><PromotionID>1</PromotionID>
<PromotionStartDateTime>2024-01-01 08:00:00</PromotionStartDateTime><PromotionStartHour>09:00:00</PromotionStartHour>
<MinQty>2</MinQty><DiscountType>1</DiscountType><Groups>
<Group><MinQty>none</MinQty><PromotionItems><PromotionItem><ItemCode>a</ItemCode></PromotionItem>
<PromotionItem><ItemCode>b</ItemCode><MinQty>9</MinQty><MaxQty></MaxQty></PromotionItem></PromotionItems></Group>
<Group><MinQty> </MinQty><PromotionItems><PromotionItem><ItemCode>c</ItemCode></PromotionItem></PromotionItems></Group></Groups>
<PromotionItems><Item><ItemCode>ignored</ItemCode></Item></PromotionItems></Promotion></Promotions></Root>"""

FLAT = """<root><ChainID>C</ChainID><promotion><PromotionID>2</PromotionID><PromotionStartDate>2024-01-01</PromotionStartDate>
<PromotionStartHour>09:00:00</PromotionStartHour><PromotionEndDate>2024-02-01</PromotionEndDate><DiscountedPrice>4.9</DiscountedPrice>
<PromotionItems><Item><ItemCode>d</ItemCode></Item></PromotionItems></promotion>
<promotion><PromotionID>3</PromotionID><Groups></Groups></promotion></root>"""


def test_promotions(spark):
    found = {r.promotionId: r for r in promotions.parse_promotions(docs(spark, GROUPED, FLAT)).collect()}
    items = [(i.itemCode, i.discountType, i.minQty, i.maxQty) for i in found["1"]["items"]]
    # "none" at group level hides the promotion's 2; a blank does not.
    assert items == [("a", 1.0, None, None), ("b", 1.0, 9.0, None), ("c", 1.0, 2.0, None)]
    assert (found["1"].startTime, found["1"].endTime, found["1"].storeId) == ("2024-01-01T08:00:00", None, "S")
    assert (found["2"].startTime, found["2"].endTime) == ("2024-01-01T09:00:00", "2024-02-01T00:00:00")
    assert [(i.itemCode, i.discountPrice) for i in found["2"]["items"]] == [("d", 4.9)]
    assert found["3"]["items"] == [] and found["3"].storeId is None
    exploded = promotions.promotion_items(promotions.parse_promotions(docs(spark, GROUPED, FLAT)))
    assert sorted(r.itemCode for r in exploded.collect()) == ["a", "b", "c", "d"]


def test_one_parse_per_document(spark, plan):
    # The second one only has what a document of mixed tags was written anew to.
    rows = prices.parse_prices(docs(spark, DRIFTED))
    items = promotions.promotion_items(promotions.parse_promotions(docs(spark, FLAT)))
    wide = rows.where("storeId = '1' and price > 2")
    for df, parses in ((rows, 2), (wide, 2), (items, 2), (items.where("storeId = '1'"), 2)):
        optimized = plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert optimized.count("from_xml(") == parses
        # The parsed document does not travel with the exploded rows.
        generate = next(line for line in plan(df, "formatted").splitlines() if line.startswith("Arguments: posexplode"))
        assert "x#" not in generate


def test_no_parsed_document_waits_for_python(spark, plan):
    """What goes through Python is held in memory by the thousand rows: texts that need it and single items only."""
    for df in (prices.parse_prices(docs(spark, DRIFTED)), promotions.parse_promotions(docs(spark, FLAT))):
        nodes = plan(df, "formatted").split("\n\n")
        inputs = [line for node in nodes if "ArrowEvalPython" in node for line in node.splitlines() if line.startswith("Input")]
        assert inputs and not any(name in line for line in inputs for name in (" x#", "[x#", "_items#"))


def test_packed_files_leave_python_in_slices(spark, plan, tmp_path):
    texts = ["a" * (raw.SLICE + 1), "é", None, "b" * (raw.SLICE // 2), "c" * raw.SLICE, "d"]
    rows = [(i, None if t is None else gzip.compress(t.encode())) for i, t in enumerate(texts)] + [(6, b"\x1f\x8bno"), (7, b"plain")]
    found = raw.documents(spark.createDataFrame(rows, "id INT, content BINARY").coalesce(1), ("id",))
    assert {r.id: (r.doc, bool(r.error)) for r in found.collect()} == {
        **{i: (t, t is None) for i, t in enumerate(texts)}, 6: (None, True), 7: ("plain", False)
    }
    assert "ArrowEvalPython" not in plan(raw.read_raw(spark, str(tmp_path), text=True), "formatted")


def test_misnamed_files(spark, tmp_path):
    text = "<Root><Items><Item><ItemCode>é</ItemCode></Item></Items></Root>"
    (tmp_path / "plain.gz").write_bytes(text.encode())
    (tmp_path / "marked.zip").write_bytes(b"\xef\xbb\xbf" + text.encode())
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "packed.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "other.txt").write_text("skip")
    files = raw.read_raw(spark, str(tmp_path), glob="*.{gz,zip}", text=True)
    assert [r.itemCode for r in prices.parse_prices(files, keep=("path",)).collect()] == ["é"] * 3
    assert raw.read_raw(spark, str(tmp_path)).count() == 4


def test_price_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('chainid,StoreId,ItemCode,ItemNm,ItemPrice,Unknown\n7,01,007,"a, b",1_0,z\n7,01,, ,bad,z\n')
    rows = listings.read_prices_csv(spark, str(tmp_path)).orderBy("price").collect()
    assert [(r.itemCode, r.itemName, r.price, r.quantity) for r in rows] == [(None, None, None, None), ("007", "a, b", 10.0, None)]
    assert tuple(rows[0].asDict()) == prices.PRICE_COLUMNS


def test_record_sink_keeps_nulls_and_letters(spark, tmp_path):
    out = str(tmp_path / "records")
    records.write_records(spark.createDataFrame([("שלום \"x\"", None)], "a STRING, b STRING"), out)
    assert spark.read.text(out).first().value == '{"a":"שלום \\"x\\"","b":null}'


def test_catalog_wrappers(spark):
    bodies = ['[{"fileName":"a"},5,null,"s"]', '{"data":[{"fileName":"b","fileType":"T"}],"items":[{"fileName":"c"}]}', '{"files":7,"result":[]}']
    df = spark.createDataFrame([(b,) for b in bodies], "body STRING")
    found = listings.read_catalog_entries(df, "body")
    assert [(r.fname, r.file_type) for r in found.collect()] == [("a", None), ("b", "T")]
    for bad in ('{"other":[]}', '"text"', "nonsense"):
        with pytest.raises(Exception):
            listings.read_catalog_entries(spark.createDataFrame([(bad,)], "body STRING"), "body", strict=True).collect()


def test_checkpoint_store(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert marks.load_checkpoint(spark, path).collect() == []
    first = spark.createDataFrame([("a", "1"), ("b", " ")], marks.MARK_SCHEMA)
    assert marks.save_checkpoint(first, path) == 1
    old = marks.load_checkpoint(spark, path)
    new = spark.createDataFrame([("a", ""), ("b", "5"), ("c", None)], marks.MARK_SCHEMA)
    assert marks.save_checkpoint(marks.advance_checkpoint(old, new), path) == 2
    assert dict(marks.load_checkpoint(spark, path).collect()) == {"a": "1", "b": "5", "c": None}


def test_raw_object_keys(spark):
    df = spark.createDataFrame([("s", "f"), ("", "f"), (None, "f")], "s STRING, f STRING")
    assert [r[0] for r in df.select(raw.object_key(F.col("s"), F.col("f"))).collect()] == ["s/f", "f", "f"]


def test_damaged_and_foreign_files_do_not_end_the_job(spark):
    import gzip

    from feedline.sources.raw import decoded

    text = '<?xml version="1.0" encoding="{0}"?><Root><StoreId>שלום</StoreId></Root>'
    rows = [
        (1, gzip.compress(b"<Root/>" * 50)[:20]),
        (2, text.format("windows-1255").encode("windows-1255")),
        (3, text.format("ISO-8859-8").encode("iso-8859-8")),
        (4, text.format("utf-16").encode("utf-16")),
        (5, gzip.compress(b"\xef\xbb\xbf" + text.format("utf-8").encode())),
        (6, b"\xff\xfa\xff"),
        (7, None),
        (8, text.format("no-such-charset").encode()),
    ]
    found = spark.createDataFrame(rows, "id INT, content BINARY").select("id", decoded("content").alias("d")).collect()
    docs = {r["id"]: r["d"]["doc"] for r in found}
    assert all("שלום" in docs[n] and docs[n].startswith("<?xml") for n in (2, 3, 4, 5))
    errors = {r["id"]: r["d"]["error"].split(":")[0] for r in found if r["d"]["doc"] is None}
    assert errors == {1: "gzip", 6: "charset", 7: "no content", 8: "charset"}


def test_odd_catalogs_and_totals(spark):
    rows = [("a", '[{"fileName": " x.gz "}]'), ("b", '{"other": 1}'), ("c", "oops")]
    df = spark.createDataFrame(rows, "source STRING, body STRING")
    assert [r["fname"] for r in listings.read_catalog_entries(df, "body", keep=("source",)).collect()] == ["x.gz"]
    assert {r["source"] for r in listings.odd_catalogs(df, "body", keep=("source",)).collect()} == {"b", "c"}
    pages = [("a", '{"aaData": [{"fname": "x"}], "iTotalRecords": "2000"}'), ("b", '{"aaData": []}')]
    pages += [("c", '{"aaData": [], "iTotalRecords": "many"}'), ("d", '{"aaData": [{"fname": "x"}], "iTotalRecords": 1}')]
    totals = listings.listing_totals(spark.createDataFrame(pages, "source STRING, body STRING"), "body", keep=("source",))
    from feedline.operators.selection import completeness

    assert {r["source"]: r["complete"] for r in completeness(totals).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_character_references_that_are_none(spark):
    from feedline.functions.markup import unescape

    rows = spark.createDataFrame([("&#9999999;|&#xD800;|&#0;|&#128;|&#xe9;|&#129;",)], "t STRING")
    assert rows.select(unescape(rows.t)).first()[0] == "\ufffd|\ufffd|\ufffd|€|é|\x81"


def test_csv_files_of_other_header_orders(spark, tmp_path):
    from feedline.sources.listings import read_prices_csv

    (tmp_path / "a.csv").write_text("ItemCode,ItemPrice,StoreId\n007,5.5,1\n")
    (tmp_path / "b.csv").write_text("itemprice,ITEMCODE\n6.5,008\n7.5,009\n")
    (tmp_path / "c.csv").write_text("ItemCode,ItemPrice,StoreId\n010,8.5,2\n")
    (tmp_path / "empty.csv").write_text("")
    rows = read_prices_csv(spark, str(tmp_path)).collect()
    assert sorted((r.itemCode, r.price, r.storeId) for r in rows) == [
        ("007", 5.5, "1"), ("008", 6.5, None), ("009", 7.5, None), ("010", 8.5, "2")
    ]


def test_promotions_at_any_depth_and_items_under_any_tag(spark):
    wrapped = """<Root><ChainID>C</ChainID><Envelope><Promotions a='>'><Promotion><PromotionID>1</PromotionID>
    <PromotionDescription><![CDATA[<b> & </Promotion>]]></PromotionDescription><Groups><Group><PromotionItems>
    <Line><ItemCode>a</ItemCode></Line><!-- <Line/> --><PromotionItem><ItemCode>b</ItemCode></PromotionItem><Item><ItemCode>c</ItemCode></Item>
    </PromotionItems></Group></Groups></Promotion><PROMOTION/></Promotions></Envelope>
    <Promotion><PromotionID>2</PromotionID><PromotionItems><Row><ItemCode>d</ItemCode><MinQty>3</MinQty></Row></PromotionItems></Promotion></Root>"""
    plain = "<Root><Promotion><PromotionID>3</PromotionID><PromotionItems><Line><ItemCode>e</ItemCode></Line></PromotionItems></Promotion></Root>"
    rows = promotions.parse_promotions(docs(spark, wrapped, plain), keep=("path",)).orderBy("path", "pos").collect()
    assert [(r.promotionId, r.providerId, [i.itemCode for i in r["items"]]) for r in rows] == [
        ("1", "C", ["a", "b", "c"]), (None, "C", []), ("2", "C", ["d"]), ("3", None, ["e"]),
    ]
    assert rows[0].description == "<b> & </Promotion>" and rows[2]["items"][0].minQty == 3


def test_odd_members_of_a_listing(spark):
    body = '{"aaData": [{"type": "a", "fname": "x"}, 17, null, "text", [1], {"fname": 5}, {"type": {"deep": 1}}], "iTotalRecords": 7}'
    df = spark.createDataFrame([(1, body), (2, '{"aaData": "none"}'), (3, "oops"), (4, None)], "id INT, body STRING")
    rows = listings.read_json_listing(df, "body", keep=("id",)).orderBy("pos").collect()
    assert [(r.id, r.pos, r.row_type, r.fname) for r in rows] == [(1, 0, "a", "x"), (1, 5, None, "5"), (1, 6, '{"deep":1}', None)]
    odd = listings.odd_members(df, "body", keep=("id",)).orderBy("pos").collect()
    assert [(r.id, r.pos, r.member) for r in odd] == [(1, 1, "17"), (1, 2, None), (1, 3, "text"), (1, 4, "[1]")]
    assert [r.n_rows for r in listings.listing_totals(df, "body", keep=("id",)).orderBy("id").collect()] == [7, 0, 0, 0]


def test_promotion_documents_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Packing and reading hold a task's documents in memory, so a task has a bounded number of them."""
    from feedline.plans import rendering as R

    n = F.col("id")
    spark.range(2000).select(
        n.alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), n.cast("double").alias("o_totalprice"),
        F.lit("1998-01-01").cast("timestamp").alias("o_orderdate"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2000).select(
        n.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), n.alias("l_partkey"), n.alias("l_suppkey"),
        F.lit(1.0).alias("l_quantity"), F.lit(2.0).alias("l_extendedprice"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(R, "PROMOTIONS_PER_TASK", 50, raising=False)
    docs = R.promotion_documents(spark, str(tmp_path))
    held = docs.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert held.sum() == 40
    assert held.max() <= 8


def test_promotion_documents_shuffle_no_text(spark, plan, tmp_path):
    """Rows go once, as they are, to the task of their documents; repeated, missing and odd rows are written as ever."""
    from feedline.plans import rendering as R

    columns = "o_orderkey long, o_orderdate date, o_orderpriority string, o_totalprice double"
    day = datetime.date(1996, 1, 2)
    orders = [(2, day, "1-<A>", 9.5), (2, day, "1-<A>", 9.5), (3, day, None, 7.0), (60, None, "x", 1.0)]
    spark.createDataFrame(orders, columns).write.parquet(f"{tmp_path}/orders.parquet")
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int, l_extendedprice double"
    lines = [(2, 2, 11, 5, 4, 1.5), (2, 1, 12, 4, 6, 2.5), (2, 1, 12, 3, 6, 2.5), (2, 3, 13, None, 1, 2.0)]
    lines += [(3, 1, 14, 1, 2, 3.5), (None, 1, 15, 1, 1, 1.0), (7, 1, 16, 1, 1, 1.0)]
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = R.promotion_documents(spark, str(tmp_path))
    text = plan(made).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")
    assert "Join" not in text[0] and text[1].count("Exchange") <= 2
    docs = {r["file"]: r["doc"] for r in made.collect()}
    assert set(docs) == {"PromoFull-0.gz", "PromoFull-1.gz"}
    first = docs["PromoFull-0.gz"]
    assert first.count("<PromotionID>2</PromotionID>") == 2 and "1-&lt;A&gt;" in first
    # Groups in the order of their key, null first; lines in the order of their number; one line of two of a number.
    groups = re.findall(r"<Groups>(.*?)</Groups>", first)
    assert groups[0] == groups[1] and re.findall(r"<ItemCode>(\d+)</ItemCode>", groups[0]) == ["13", "12", "11"]
    assert "<ItemCode>14</ItemCode>" in first and "15</ItemCode>" not in first and "16</ItemCode>" not in first
    assert "<PromotionItems>" not in docs["PromoFull-1.gz"] and "<Groups></Groups>" in docs["PromoFull-1.gz"]


PLAIN = """<?xml version="1.0" encoding="utf-8"?>
<Root v="1"><ChainId> 7290 </ChainId><StoreId>001</StoreId><Other>x</Other><ITEMS Count='3'>
<Item><ItemCode>007</ItemCode><ItemNm> </ItemNm><itemnm> Milk &amp; א </itemnm><Quantity>1_0.5</Quantity><bIsWeighted>1</bIsWeighted><LastSaleDate/></Item>
<item><PRICEUPDATEDATE>2024-01-02 03:04:05</PRICEUPDATEDATE><Unknown>a</Unknown><ItemCode></ItemCode></item>
</ITEMS></Root>
"""


def test_plain_documents_do_not_need_the_parser(spark):
    """The usual documents are read as columns, with the rows the XML parser gives for the same document."""
    swaps = [
        ("007", "<![CDATA[007]]>"), ("007", "&#48;07"), ("007", "0\r\n7"), ("<ItemCode>", "<ItemCode a='1'>"), ("<LastSaleDate/>", "<ItemName/>"),
        ("<item>", "<Product>"), ("<StoreId>001</StoreId>", "<Items/>"), ("7290", "7<b>290</b>"), ("<Other>x</Other>", "text"), ("<Item>", "<Item>text"),
        ("&amp;", "&"), ("</Item>", "</item>"), ("</item>", ""), ("007", "\x01"), ("v=", "corrupt="), ("Unknown", "Unknown:x"), ("1.0", "1.1"),
    ]
    odd = [PLAIN.replace(old, new) for old, new in swaps] + [PLAIN + PLAIN, PLAIN[:-10], " " + PLAIN]
    empty = "<Root><ChainId>1</ChainId><Items></Items></Root>"
    many = "<Root><Items>" + "".join(f"<Item><ItemCode>{n}</ItemCode></Item>" for n in range(40)) + "</Items></Root>"
    plain = [PLAIN, PLAIN.replace("Item>", "Product>").replace("item>", "product>"), empty, many]
    left = prices.read_plain(docs(spark, *plain, *odd, None), keep=("path",)).where("_plain IS NULL")
    assert sorted(int(r.path) for r in left.collect()) == list(range(len(plain), len(plain) + len(odd) + 1))
    # A comment leaves a document to the parser and changes nothing else.
    told = [t.replace("</Root>", "<!-- c --></Root>") for t in plain]
    assert prices.read_plain(docs(spark, *told)).where("_plain IS NULL").count() == len(told)
    both = [sorted(map(str, prices.price_outcomes(docs(spark, *texts), keep=("path",)).collect())) for texts in (plain, told)]
    assert both[0] == both[1] and len(both[0]) == 44
    first = prices.parse_prices(docs(spark, PLAIN)).orderBy("pos").collect()
    assert [(r.pos, r.itemCode, r.itemName, r.quantity, r.weighted, r.updateTime) for r in first] == [
        (0, "007", "Milk & א", 10.5, True, None), (1, None, None, None, None, "2024-01-02T03:04:05")
    ]
    assert {(r.superProvider, r.storeId) for r in first} == {("7290", "001")}
    assert [r.pos for r in prices.parse_prices(docs(spark, many)).orderBy("pos").collect()] == list(range(40))


def test_price_documents_shuffle_no_text(spark, plan, tmp_path):
    """Offers go as they are to the task of their documents; repeated and odd rows are written as ever."""
    from feedline.plans import rendering as R

    day = datetime.datetime(1996, 1, 2)
    spark.createDataFrame([(1, "b<x>", "B", "T", 3), (2, "a", "B", "T", 1), (2, "A", None, "T", 1), (700, "z", "B", "T", 2)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(3, None), (4, 1), (4, 2), (5, 7)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(3, 2), (3, 1), (4, 2), (4, 700), (3, 1), (9, 1), (None, 1), (4, None)]
    spark.createDataFrame([(s, p, day, n, 1, 2.5, 9.25, "A", None) for n, (s, p) in enumerate(lines)],
        "l_suppkey long, l_partkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_quantity double,"
        "l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")  # fmt: skip
    made = R.price_documents(spark, str(tmp_path))
    nodes = plan(made, "formatted").split("\n\n")
    inputs = [line for node in nodes if ") Exchange" in node for line in node.splitlines() if line.startswith("Input")]
    assert inputs and not any(name in line for line in inputs for name in ("buf#", "items#", "xml#", "row#"))
    found = sorted((r["file"], r["doc"]) for r in made.collect())
    # Supplier 4 is there under two nations.
    assert [f for f, _ in found] == ["PriceFull-3-0.gz", *["PriceFull-4-0.gz"] * 2, *["PriceFull-4-1.gz"] * 2]
    third, fourth = found[0][1], found[1][1]
    # Parts in order, two rows of a part by their text; null texts are empty; tags by the kind of the supplier.
    assert re.findall(r"<ItemName>([^ ]*?)</ItemName>", third) == ["b&lt;x&gt;", "A", "a"]
    assert third.startswith("<Root><ChainId></ChainId><StoreId>00003</StoreId><Items><Product><ItemCode>0000001</ItemCode>")
    assert "<ManufactureName></ManufactureName>" in third and "<LastSaleDateTime>" not in third
    assert fourth.startswith("<Root><ChainId>729001</ChainId>") and fourth.count("<Item>") == 2 and "<ItemPrice>9.25</ItemPrice>" in fourth
