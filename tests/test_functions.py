"""Column functions on the edge cases the feeds are known for."""

import math
from datetime import datetime, timedelta
from urllib.parse import urljoin, urlparse
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from feedline.functions import dates, enrich, markup, text, urls


def values(spark, inputs, make, schema="v STRING"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i INT, {schema}").repartition(2)
    return [r[1] for r in sorted(df.select("i", make(F.col("v")).alias("r")).collect())]


def python_number(raw):
    if raw is None:
        return None
    try:
        return float(raw)
    except ValueError:
        return None


NUMBERS = [
    "5", "5.0", " 7 ", "+3", "-.5", "1.", "1e3", "1E-2", "1_000", "1__0", "_1", "1_", "1d", "1.5f", "0x1p3", "0x10",
    "inf", "-Infinity", "+nan", "NaN", "", ".", "e5", "1,5", " 12 ", None, "1_0.2_5e1_0", "12L", "--1",
]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_numbers_follow_the_float_grammar(spark):
    got = values(spark, NUMBERS, text.to_number)
    for raw, value in zip(NUMBERS, got):
        assert same(value, python_number(raw)), raw


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789+-._eEinfa dx", max_size=8), min_size=1, max_size=40))
def test_numbers_on_random_text(spark, raws):
    for raw, value in zip(raws, values(spark, raws, text.to_number)):
        assert same(value, python_number(raw)), raw


def test_booleans(spark):
    raws = ["1", "true", "True", " 1 ", "TRUE", "0", "2", "y", "", None]
    assert values(spark, raws, text.to_bool) == [True] * 4 + [False] * 5 + [None]


def test_timestamps(spark):
    raws = ["2024-01-02 03:04:05", "2024-01-02", "a b c", "", None]
    assert values(spark, raws, text.iso_ts) == ["2024-01-02T03:04:05", "2024-01-02", "aTbTc", None, None]
    assert values(spark, raws[:2], lambda c: text.iso_ts_hour(c, F.lit("09:00:00"))) == [
        "2024-01-02T03:04:05",
        "2024-01-02T09:00:00",
    ]
    assert values(spark, raws[1:2], lambda c: text.iso_ts_hour(c)) == ["2024-01-02T00:00:00"]
    assert values(spark, [None, ""], lambda c: text.iso_ts_hour(c, F.lit("09:00:00"))) == [None, None]


def test_first_text(spark):
    df = spark.createDataFrame([([" ", " ", " b "], None, ["z"])], "a ARRAY<STRING>, b ARRAY<STRING>, c ARRAY<STRING>")
    row = df.select(
        text.first_text(F.col("a")), text.first_text(F.col("b"), F.col("c")), text.first_text(F.col("b"))
    ).first()
    assert tuple(row) == ("b", "z", None)


def test_file_dates(spark):
    names = [
        "PriceFull7290000000001-001-20260802-030000.gz",
        "Price20260101-111111-20260802-030000.gz",
        "PriceFull7290696200003-20260802.gz",
        "PriceFull-20260802_0315.xml",
        "PriceFull-202608020315.xml",
        "PriceFull-120260802.xml",
        "x-20260802-030000.gz.part",
        None,
    ]
    first = values(spark, names, dates.file_date)
    # The first pattern is not tied to digit borders, so a chain id can match.
    assert first[:3] == ["20260802030000", "20260101111111", "96200003202608"]
    assert first[3:6] == [None] * 3 and first[7] is None
    anchored = values(spark, names, lambda c: dates.file_date(c, "anchored"))
    assert anchored[1] == "20260802030000" and anchored[6] is None
    tolerant = values(spark, names, lambda c: dates.file_date(c, "tolerant"))
    assert tolerant[2:6] == ["20260802000000", "20260802031500", "20260802031500", None]
    assert values(spark, ["2026-07-31.html", "index.html"], dates.day_date) == ["20260731", None]


def test_marks(spark):
    raws = ["20260802", "2026-08-02 03:15", "20260802031500", "", None]
    assert values(spark, raws, dates.normalize_mark) == ["20260802000000", "20260802031500", "20260802031500", None, None]
    for bad in ("2026", " ", "202608020"):
        with pytest.raises(SparkRuntimeException):
            values(spark, [bad], dates.normalize_mark)


BASES = [
    "https://h.example/a/b/page.html?x=1#f", "http://h.example", "https://h.example/a/", "https://u:p@h.example:8080/a/b",
]
HREFS = [
    "", "x.gz", "./x.gz", "../x.gz", "../../../x", "/r/./s/../t", "//o.example/z", "?q=2", "#top", "a//b", "https://z.example/q",
    "mailto:a@b", "x?y=1#z", "..", ".", "a/..", "/", "sub/", "x?", "//o.example", "http://h.example/q/../r", "a b.gz",
]


def test_urls_resolve_like_the_standard(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i INT, b STRING, h STRING")
    got = dict(df.select("i", urls.resolve_url(F.col("h"), F.col("b"))).collect())
    wrong = [(b, h, got[i], urljoin(b, h)) for i, (b, h) in enumerate(pairs) if got[i] != urljoin(b, h)]
    assert wrong == []


def test_url_parts(spark):
    links = ["https://h.example/a/b.gz?x=1", "https://h.example/", "https://h.example", "https://h.example/a/b/", "https://h.example/a/./", "https://h.example/a;p=1"]
    want = [PurePosixPath(urlparse(u).path).name or "download" for u in links]
    assert values(spark, links, urls.file_name) == want
    assert values(spark, ["https://H.example:80/x"], urls.url_host) == ["H.example:80"]
    assert values(spark, ["http://x/A.GZ", "http://x/a.gz?q", "http://x/a.xml"], lambda c: urls.has_suffix(c, (".gz", ".xml"))) == [True, False, True]


def test_freshness(spark):
    now = F.lit(datetime(2026, 8, 2, 3, 0, 0))
    links = [
        None,
        "",
        "https://b/f.gz",
        "https://b/f.gz?se=never",
        "https://b/f.gz?sv=1&se=2026-08-02T03%3A02%3A00Z&sig=1",
        "https://b/f.gz?se=2026-08-02T03%3A02%3A01Z",
        "https://b/f.gz?se=2026-08-02T05%3A02%3A00%2B02%3A00",
    ]
    got = values(spark, links, lambda c: urls.is_fresh(c, now, timedelta(minutes=2)))
    assert got == [False, False, True, True, False, True, False]


def test_markup(spark):
    pages = [
        """<A HREF='/a?x=1&amp;y=2'>1</a><a href=/b>2</a><a data-href="/no" title="href='/no'">3</a><a href="">4</a>
        <!-- <a href="/hidden"> --><script>var s='<a href="/js">';</script><a class="x" href="/c&#47;d&#x2F;e"/><abbr href="/no">""",
        None,
    ]
    assert values(spark, pages, markup.hrefs) == [["/a?x=1&y=2", "/b", "/c/d/e"], []]
    assert values(spark, ["a&amp;lt;b &eacute; &nope; &", "plain"], markup.unescape) == ["a&lt;b é &nope; &", "plain"]
    assert values(spark, ["<p> a <b>b</b>\n c</p><p> </p>", "<p></p>", None], markup.html_text) == ["a b c", "", None]
    assert values(spark, ["<a href='?id=2&amp;page=3'><a href='?page=12'>", "", None], markup.page_count) == [12, 1, 1]


def test_enrichment(spark):
    texts = ["To be,  or not to be.", "", "  \n", "aaa bbb", "Good bad GREAT, (love) 'hate'"]
    assert values(spark, texts, enrich.word_count) == [6, 0, 0, 2, 5]
    assert values(spark, texts, enrich.longest_word) == ["be,", None, None, "aaa", "GREAT,"]
    assert values(spark, texts, enrich.sentiment_score) == [0, 0, 0, 0, 1]
    assert values(spark, ["(don't) -- U.S.A. é!"], enrich.tokens) == [["don't", "u.s.a", "é"]]
    same_text = values(spark, [" a ", "a", " a\n"], enrich.text_hash)
    assert len(set(same_text)) == 1


def test_references_equal_the_standard_library(spark):
    import html
    from html.entities import html5

    texts = []
    for name in sorted({n.rstrip(";") for n in html5}):
        texts += [f"a&{name};b", f"a&{name} b", f"&{name}=3", f"&{name}x;", f"&{name.lower()}"]
    texts += [f"&#{n};" for n in [*range(300), 0xD800, 0xFDD0, 0xFFFF, 0x10FFFF, 0x110000, 10**9]]
    texts += [f"&#x{n:X}" for n in (65, 0, 128, 0xFFFE, 0x1F600, 0x1FFFE, 0xFFFFFFFF)]
    texts += ["&#0000000000065;", "&#x00000000041", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "&a&b;&lt", "x", ""]
    assert values(spark, texts, markup.unescape) == [html.unescape(t) for t in texts]


def test_references_in_attributes(spark):
    texts = ["/a?x=1&copy=3&lt=2", "&copy;=3 &copy; &lt", "&copyx; &notit;", "&amp;b&ampb", "&#65&#x42;=", "&NotEqualTilde;"]
    want = ["/a?x=1&copy=3&lt=2", "©=3 © <", "&copyx; &notit;", "&b&ampb", "AB=", "\u2242\u0338"]
    assert values(spark, texts, lambda c: markup.unescape(c, attribute=True)) == want
