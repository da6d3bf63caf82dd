"""Queries of the listing projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedline.functions import dates, markup, urls
from feedline.operators import filters, links
from feedline.plans import expected as E
from feedline.plans import rendering as R
from feedline.plans.registry import query

_ANCHORS = r"""unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1))"""
_ROOT = "regexp_extract(url, '^https?://[^/?#]+', 0)"


@query("lst_01_link_extraction", f"SELECT page_id, {E.unescaped('h')} AS href FROM (SELECT page_id, {_ANCHORS} AS h FROM pages)")
def link_extraction(spark, sf_dir):
    return links.extract_links(R.table(spark, sf_dir, "pages"), keep=("page_id",)).select("page_id", "href")


@query(
    "lst_02_resolve_url",
    rf"""
    WITH p AS (
      SELECT page_id, url, {_ROOT} AS root, regexp_extract(url, '^[a-z]+:', 0) AS scheme,
             regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
             regexp_extract(url, '\?[^#]*', 0) AS q
      FROM pages),
    d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM p)
    SELECT page_id, CASE page_id % 9
        WHEN 0 THEN root || '/a/c.gz?x=1'
        WHEN 1 THEN root || dir || 'rel.gz'
        WHEN 2 THEN root || regexp_replace(dir, '[^/]+/$', '') || 'up.gz'
        WHEN 3 THEN root || path || '?q=2'
        WHEN 4 THEN root || path || q || '#part'
        WHEN 5 THEN scheme || '//other.example.org/d.xml'
        WHEN 6 THEN 'ftp://f.example.org/../x'
        WHEN 7 THEN 'mailto:a@example.org'
        ELSE root || '/e/' END AS link
    FROM d""",
)
def resolve_url(spark, sf_dir):
    written = [
        "/a/b/../c.gz?x=1", "rel.gz", "../up.gz", "?q=2", "#part", "//other.example.org/d.xml",
        "ftp://f.example.org/../x", "mailto:a@example.org", "/e/./f/..",
    ]
    href = F.get(F.array(*[F.lit(h) for h in written]), (F.col("page_id") % len(written)).cast("int"))
    return R.table(spark, sf_dir, "pages").select("page_id", urls.resolve_url(href, F.col("url")).alias("link"))


@query("lst_03_suffix_filter", "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html' OR lower(url) LIKE '%/'")
def suffix_filter(spark, sf_dir):
    pages = R.table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(urls.has_suffix(F.upper("url"), (".html", "/")))


@query(
    "lst_04_file_name",
    rf"""
    SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(regexp_extract(
             url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '[^/]*$', 0), ''), 'download') AS name
    FROM pages""",
)
def file_name(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").select("page_id", urls.file_name(F.col("url")).alias("name"))


@query(
    "lst_05_host_filter",
    f"""
    SELECT page_id, 'https://cdn1.example.net:8443' || {E.unescaped('h')} AS link
    FROM (SELECT page_id, {_ANCHORS} AS h FROM pages) WHERE page_id % 3 = 1""",
)
def host_filter(spark, sf_dir):
    base = F.concat(F.lit("https://cdn"), R.text(F.col("page_id") % 3), F.lit(".example.net:8443/list"))
    found = links.extract_links(R.table(spark, sf_dir, "pages"), base=base, keep=("page_id",))
    return found.where(filters.on_host(F.col("link"), "cdn1.example.net:8443")).select("page_id", "link")


@query(
    "lst_06_prefix_filter",
    "SELECT p_partkey, p_type || p_partkey AS fname FROM part WHERE p_type IN ('PROMO', 'SMALL')",
)
def prefix_filter(spark, sf_dir):
    named = R.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", R.text("p_partkey")).alias("fname"))
    return named.where(filters.has_prefix(F.col("fname"), ("PROMO", "SMALL", "promo")))


@query(
    "lst_07_entry_filter",
    """
    SELECT p_partkey, p_type FROM part
    WHERE p_size % 5 NOT IN (0, 1) AND (p_partkey % 3 = 0 OR p_type = 'LARGE')""",
)
def entry_filter(spark, sf_dir):
    size = F.col("p_size") % 5
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "PriceFull").otherwise("Stores"), F.col("p_name"))
    entries = R.table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", F.when(size == 0, F.lit(None)).when(size == 1, " ").otherwise(name).alias("fname")
    )
    wanted = filters.wanted_entry(F.col("fname"), F.col("p_type"), file_types=("large",))
    return entries.where(wanted).select("p_partkey", "p_type")


@query("lst_08_category_filter", "SELECT p_partkey, p_size % 5 + 1 AS category FROM part WHERE p_size % 5 + 1 IN (2, 4)")
def category_filter(spark, sf_dir):
    listed = R.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("category"))
    return listed.where(filters.full_snapshot(F.col("category")))


@query("lst_09_row_kind_filter", "SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 3 <> 0")
def row_kind_filter(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 != 0, F.replace("event_type", F.lit("view"), F.lit("file")))
    return R.table(spark, sf_dir, "events").where(filters.is_file(kind)).select("event_id")


# The moment an order's file name states.
_STAMP = "o_orderdate + INTERVAL 10 YEAR + to_seconds(o_orderkey % 86400)"


def _stamped(spark, sf_dir):
    second = F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    at = F.add_months("o_orderdate", 120).cast("timestamp") + second
    return R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", at.alias("at"))


def _format(pattern: str):
    return F.date_format("at", pattern)


@query(
    "lst_10_file_date_first",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime({_STAMP}, '%Y%m%d%H%M%S') END AS file_date FROM orders",
)
def file_date_first(spark, sf_dir):
    stamp = F.when(F.col("o_orderkey") % 7 == 0, _format("yyyyMMdd_HHmmss")).otherwise(_format("yyyyMMdd-HHmmss"))
    link = F.concat(F.lit("https://h.example.net/d/PriceFull"), R.text("o_custkey"), F.lit("-001-"), stamp, F.lit("-19990101-000000.gz"))
    # An undashed date falls back to the next dashed one; keep it apart here.
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("PriceFull-"), stamp)).otherwise(link)
    return _stamped(spark, sf_dir).select("o_orderkey", dates.file_date(name).alias("file_date"))


@query(
    "lst_11_file_date_of_name",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime({_STAMP}, '%Y%m%d%H%M%S') END AS file_date FROM orders",
)
def file_date_of_name(spark, sf_dir):
    dated = F.concat(F.lit("https://h.example.net/20010101-000000/f-"), _format("yyyyMMdd-HHmmss"), F.lit(".gz?v=1"))
    in_query = F.concat(F.lit("https://h.example.net/20010101-000000/f.gz?v="), _format("yyyyMMdd-HHmmss"))
    url = F.when(F.col("o_orderkey") % 2 == 0, dated).otherwise(in_query)
    return _stamped(spark, sf_dir).select("o_orderkey", dates.file_date(urls.file_name(url)).alias("file_date"))


@query(
    "lst_12_file_date_anchored",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime({_STAMP}, '%Y%m%d%H%M%S') END AS file_date FROM orders",
)
def file_date_anchored(spark, sf_dir):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, ".gz.part").otherwise(".gz")
    chain = F.lpad(R.text("o_custkey"), 8, "7")
    name = F.concat(F.lit("PriceFull"), chain, F.lit("-123456-"), _format("yyyyMMdd-HHmmss"), suffix)
    return _stamped(spark, sf_dir).select("o_orderkey", dates.file_date(name, "anchored").alias("file_date"))


@query(
    "lst_13_file_date_tolerant",
    f"""
    SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN strftime({_STAMP}, '%Y%m%d') || '000000'
        WHEN 1 THEN strftime({_STAMP}, '%Y%m%d%H%M') || '00'
        WHEN 2 THEN strftime({_STAMP}, '%Y%m%d%H%M%S')
        WHEN 3 THEN strftime({_STAMP}, '%Y%m%d%H%M') || '00'
        WHEN 4 THEN '20010203000000' END AS file_date
    FROM orders""",
)
def file_date_tolerant(spark, sf_dir):
    kind = F.col("o_orderkey") % 6
    older = F.lit("Price-20010203-")
    name = (
        F.when(kind == 0, F.concat(older, _format("yyyyMMdd")))
        .when(kind == 1, F.concat(older, _format("yyyyMMdd-HHmm")))
        .when(kind == 2, F.concat(older, _format("yyyyMMdd_HHmmss")))
        .when(kind == 3, F.concat(older, _format("yyyyMMddHHmm")))
        .when(kind == 4, F.concat(older, F.lit("9"), _format("yyyyMMdd"), F.lit("-x")))
        .otherwise(F.concat(F.lit("Price7"), _format("yyyyMMdd-HHmm")))
    )
    return _stamped(spark, sf_dir).select("o_orderkey", dates.file_date(name, "tolerant").alias("file_date"))


@query("lst_14_day_key", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y%m%d') END AS day FROM events")
def day_key(spark, sf_dir):
    page = F.when(F.col("event_id") % 9 == 0, "index").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    link = F.concat(F.lit("https://h.example.net/1999-01-01/"), page, F.lit(".html"))
    return R.table(spark, sf_dir, "events").select("event_id", dates.day_date(urls.file_name(link)).alias("day"))


@query(
    "lst_15_normalize_mark",
    f"""
    SELECT o_orderkey, CASE o_orderkey % 5
        WHEN 0 THEN strftime({_STAMP}, '%Y%m%d') || '000000'
        WHEN 1 THEN strftime({_STAMP}, '%Y%m%d%H%M') || '00'
        WHEN 2 THEN strftime({_STAMP}, '%Y%m%d%H%M%S') END AS mark
    FROM orders""",
)
def normalize_mark(spark, sf_dir):
    kind = F.col("o_orderkey") % 5
    mark = (
        F.when(kind == 0, _format("yyyy-MM-dd"))
        .when(kind == 1, _format("yyyyMMdd HH:mm"))
        .when(kind == 2, _format("yyyyMMdd-HHmmss"))
        .when(kind == 3, "")
    )
    return _stamped(spark, sf_dir).select("o_orderkey", dates.normalize_mark(mark).alias("mark"))


@query("lst_16_page_count", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 1 ELSE page_id % 37 + 1 END AS n_pages FROM pages")
def page_count(spark, sf_dir):
    last = F.concat(F.lit('<a href="/c?id=2&amp;page=1">1</a><a href="/c?id=2&amp;page='), R.text(F.col("page_id") % 37 + 1), F.lit('">'))
    html = F.when(F.col("page_id") % 4 == 0, F.col("html")).otherwise(F.concat("html", last))
    return R.table(spark, sf_dir, "pages").select("page_id", markup.page_count(html).alias("n_pages"))


_SIGNED = "'1998-06-15 12:00:00'"


def _signed(spark, sf_dir):
    key = F.col("o_orderkey")
    second = F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    limit = F.to_timestamp(F.lit("1998-06-15 12:02:00"))
    at = F.when(key % 7 == 6, limit).otherwise(F.col("o_orderdate").cast("timestamp") + second)
    stamp = F.replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.lit("%3A"))
    tail = (
        F.when(key % 7 == 0, "sig=x")
        .when(key % 7 == 1, "se=soon&sig=x")
        .when(key % 7 == 2, "se=&sig=x")
        .otherwise(F.concat(F.lit("sv=1&se="), stamp, F.lit("&sig=a%2Bb")))
    )
    url = F.when(key % 7 != 3, F.concat(F.lit("https://blob.example.net/f"), R.text(key), F.lit(".gz?"), tail))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))


_EXPIRY = """CASE WHEN o_orderkey % 7 = 6 THEN TIMESTAMP '1998-06-15 12:02:00'
    WHEN o_orderkey % 7 IN (4, 5) THEN o_orderdate + to_seconds(o_orderkey % 86400) END"""


@query("lst_17_link_expiry", f"SELECT o_orderkey, strftime({_EXPIRY}, '%Y-%m-%d %H:%M:%S') AS expiry FROM orders")
def link_expiry(spark, sf_dir):
    expiry = urls.link_expiry(F.col("url"))
    return _signed(spark, sf_dir).select("o_orderkey", F.date_format(expiry, "yyyy-MM-dd HH:mm:ss").alias("expiry"))


@query(
    "lst_18_freshness",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN false
        WHEN {_EXPIRY} IS NULL THEN true
        ELSE {_EXPIRY} - TIMESTAMP {_SIGNED} > INTERVAL 2 MINUTE END AS fresh
    FROM orders""",
)
def freshness(spark, sf_dir):
    now = F.to_timestamp(F.lit("1998-06-15 12:00:00"))
    return _signed(spark, sf_dir).select("o_orderkey", urls.is_fresh(F.col("url"), now).alias("fresh"))


@query(
    "lst_19_table_links",
    f"""
    SELECT p_partkey // {R.PARTS_PER_FILE} AS page, 'https://t.example.net/get/' || p_partkey || '.gz?a=1&b=2' AS link
    FROM part WHERE p_size % 4 IN (0, 1)""",
)
def table_links(spark, sf_dir):
    cell = F.lit("<td>x</td>")
    link = F.concat(F.lit('<TD class="l"><a class="b" href="/get/'), R.text("p_partkey"), F.lit('.gz?a=1&amp;b=2">get</a></TD>'))
    kind = F.col("p_size") % 4
    cells = (
        F.when(kind == 0, F.concat(F.repeat(cell, F.lit(5)), link))
        .when(kind == 1, F.concat(F.repeat(cell, F.lit(5)), link, cell))
        .when(kind == 2, F.concat(F.repeat(cell, F.lit(4)), link))
        .otherwise(F.concat(F.repeat(cell, F.lit(5)), F.lit("<td><a>none</a></td>")))
    )
    rows = R.table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / R.PARTS_PER_FILE).alias("page"),
        F.struct("p_partkey", R.element("tr", cells).alias("xml")).alias("row"),
    )
    body = R.joined(F.collect_list("row"))
    html = F.concat(
        F.lit('<table class="other"><tbody><tr>'),
        F.repeat(F.lit("<td><a href='/no.gz'>n</a></td>"), F.lit(6)),
        F.lit('</tr></tbody></table><table id="t" class="wide gzTable"><thead><tr><th>h</th></tr></thead>'),
        R.element("tbody", body),
        F.lit("</table>"),
    )
    pages = rows.groupBy("page").agg(html.alias("html"))
    return links.table_links(pages, base=F.lit("https://t.example.net"), keep=("page",)).select("page", "link")
