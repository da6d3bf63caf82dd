"""Listing styles from their captures to stored marks."""

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from feedline.operators import cycle
from feedline.sources.marks import load_checkpoint, save_checkpoint

MARKS = "source STRING, mark STRING"
ROOT = "https://f.example.net/"


def test_names_are_quoted_as_in_urls(spark):
    names = ["a b.gz", "é/ü*~+&=%.gz", "PriceFull-1_2.gz", "שלום"]
    found = spark.createDataFrame([(n,) for n in names], "n STRING").select(cycle.quoted(F.col("n"))).collect()
    assert [r[0] for r in found] == [quote(n) for n in names]


def run(spark, tmp_path, captures, style, batch="1", **options):
    out = str(tmp_path / "out")
    found = cycle.run_style(captures, cycle.STYLES[style], str(tmp_path / "marks"), out, batch, ROOT, **options)
    marks = dict(load_checkpoint(spark, str(tmp_path / "marks")).collect())
    return sorted(r.href for r in found.collect()), marks


def test_rows_that_are_no_files_and_other_reports(spark, tmp_path):
    body = """{"aaData": [{"type": "file", "fname": "PriceFull1-20240101-000000.gz"}, {"type": "dir", "fname": "PriceFull2-20240201-000000.gz"},
    {"type": "file", "fname": "Stores3-20240301-000000.gz"}, 5, {"type": "file"}, {"type": "file", "fname": "PromoFull4.gz"}]}"""
    captures = spark.createDataFrame([("a", body), ("b", "{}")], "source STRING, body STRING")
    hrefs, marks = run(spark, tmp_path, captures, "paged_json")
    assert hrefs == [ROOT + "file/d/PriceFull1-20240101-000000.gz", ROOT + "file/d/PromoFull4.gz"]
    assert marks == {"a": "20240101000000"}
    # Nothing is new in a second run, and no mark moves.
    assert run(spark, tmp_path, captures, "paged_json", "2") == ([], marks)


def test_catalogs_keep_the_first_name_and_start_at_a_day(spark, tmp_path):
    first = '[{"fileName": "PriceFull 1-20240102.gz"}, {"fileName": "x-20240103", "fileType": "PROMOFULL"}, {"fileName": ""}, 7]'
    again = '{"data": [{"fileName": "PriceFull 1-20240102.gz"}, {"fileName": "PriceFull2-20231231.gz"}]}'
    captures = spark.createDataFrame([("a", 1, first), ("a", 2, again), ("c", 1, first)], "source STRING, chain INT, body STRING")
    save_checkpoint(spark.createDataFrame([("c", "20240102")], MARKS), str(tmp_path / "marks"))
    hrefs, marks = run(spark, tmp_path, captures, "catalog_json", start="2024-01-01")
    assert hrefs == [ROOT + "PriceFull%201-20240102.gz", ROOT + "x-20240103", ROOT + "x-20240103"]
    assert marks == {"a": "20240103000000", "c": "20240103000000"}


def test_the_last_link_of_a_name_counts(spark, tmp_path):
    def page(n, sign):
        return ("a", 2, n, ROOT, f'<a href="Price{n % 2}-20240101-000000.gz?se={sign}&amp;copy=1"></a><a href="https://other.example/z"></a>')

    rows = [page(0, "x"), page(1, "y"), page(2, "z"), ("a", 3, 0, ROOT, '<a href="PriceX-20250101-000000.gz"></a>')]
    captures = spark.createDataFrame(rows, "source STRING, category INT, page INT, url STRING, html STRING")
    hrefs, marks = run(spark, tmp_path, captures, "signed_html", suffixes=None, host="f.example.net")
    assert hrefs == [ROOT + "Price0-20240101-000000.gz?se=z&copy=1", ROOT + "Price1-20240101-000000.gz?se=y&copy=1"]
    assert marks == {"a": "20240101000000"}


def test_day_pages_from_the_mark_on(spark, tmp_path):
    def days(*names):
        anchors = "".join(f'<a href="{n}.html">d</a>' for n in names)
        return spark.createDataFrame([("a", ROOT, anchors)], "source STRING, url STRING, html STRING")

    pages = [(ROOT + f"2024-01-0{d}.html", f'<a href="7290-20240101-20240{100 + d}-0{h}0000.gz">f</a>' * 2) for d in (1, 2, 3) for h in (1,)]
    captured = spark.createDataFrame(pages, "url STRING, html STRING")
    names = ("2024-01-01", "about", "2024-01-02")
    hrefs, marks = run(spark, tmp_path, days(*names), "day_pages", day_pages=captured)
    assert hrefs == [ROOT + "7290-20240101-20240102-010000.gz"] * 2 and marks == {"a": "20240102010000"}
    hrefs, marks = run(spark, tmp_path, days(*names, "2024-01-03"), "day_pages", "2", day_pages=captured)
    assert hrefs == [ROOT + "7290-20240101-20240103-010000.gz"] * 2 and marks == {"a": "20240103010000"}


def test_unknown_readers_are_refused(spark):
    with pytest.raises(ValueError):
        cycle.read_listing(spark.range(1), {"reader": "ftp"}, spark.range(1), ROOT)


def test_catalog_entries_are_read_once(spark, plan):
    """Filters on the fields of an entry do not read the entry, nor its list, once more."""
    from pyspark.sql import functions as F

    from feedline.sources import listings

    body = '{"files": [{"fileName": " a.gz "}, 5, {"fileName": "", "fileType": "x"}, {"fileType": "y"}]}'
    answers = spark.createDataFrame([(body,), ("[]",), ("{}",), (None,)], "body string")
    found = listings.read_catalog_entries(answers, "body")
    kept = found.where(F.col("fname") != "").where(F.lower("file_type").isNull())
    text = plan(kept).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert text.count("$.fileName") == 1 and text.count("$.fileType") == 1 and "size(" not in text
    assert [tuple(r) for r in found.collect()] == [(0, "a.gz", None), (2, "", "x"), (3, None, "y")]
    assert [r["fname"] for r in kept.collect()] == ["a.gz"]
