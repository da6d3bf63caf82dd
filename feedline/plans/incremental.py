"""Queries of incremental selection and dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedline.functions import dates, urls
from feedline.operators import cycle, dedup, filters, isolation, selection
from feedline.plans import expected as E
from feedline.plans import rendering as R
from feedline.plans.registry import query
from feedline.session import new_scratch
from feedline.sources import listings
from feedline.sources.marks import clean_marks, load_checkpoint, save_checkpoint


def dated_listing(spark, sf_dir):
    return R.listing(spark, sf_dir).withColumn("file_date", dates.file_date(F.col("fname")))


def stored_marks(spark, sf_dir):
    return clean_marks(R.checkpoint(spark, sf_dir))


@query(
    "inc_01_newest_mark",
    f"""
    WITH {E.LISTING}, s AS (SELECT 's' || n_nationkey AS source FROM nation UNION SELECT 'silent')
    SELECT source, max(file_date) AS mark FROM s LEFT JOIN listing USING (source) GROUP BY source""",
)
def newest_mark(spark, sf_dir):
    known = R.checkpoint(spark, sf_dir).select("source")
    sources = known.union(known.select(F.lit("silent").alias("source")))
    return selection.newest_mark(dated_listing(spark, sf_dir), sources)


@query(
    "inc_02_newest_mark_kept",
    f"""
    WITH {E.LISTING}, {E.MARKS}
    SELECT source, greatest(max(file_date), any_value(mark)) AS mark
    FROM marks LEFT JOIN listing USING (source) GROUP BY source""",
)
def newest_mark_kept(spark, sf_dir):
    return selection.newest_mark_kept(dated_listing(spark, sf_dir), stored_marks(spark, sf_dir))


@query(
    "inc_03_new_links",
    f"""
    WITH {E.LISTING}, {E.MARKS}
    SELECT source, page, pos, href FROM listing JOIN marks USING (source)
    WHERE mark IS NULL OR file_date > mark""",
)
def new_links(spark, sf_dir):
    found = selection.new_links(dated_listing(spark, sf_dir), stored_marks(spark, sf_dir))
    return found.select("source", "page", "pos", "href")


@query(
    "inc_04_new_links_from",
    f"""
    WITH {E.LISTING}, {E.MARKS}
    SELECT source, page, pos, href FROM listing JOIN marks USING (source)
    WHERE CASE WHEN mark IS NOT NULL THEN file_date > left(mark, 8) || '000000'
               ELSE file_date >= '19970110000000' END""",
)
def new_links_from(spark, sf_dir):
    day_marks = stored_marks(spark, sf_dir).withColumn("mark", F.substring("mark", 1, 8))
    found = selection.new_links_from(dated_listing(spark, sf_dir), day_marks, start="1997-01-10")
    return found.select("source", "page", "pos", "href")


def _day_pages(spark, sf_dir):
    """Day pages of each kind of event, each listed once per event."""
    events = R.table(spark, sf_dir, "events")
    link = F.concat_ws("/", F.lit("https://d.example.net"), "event_type", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".html")))
    pages = events.select(F.col("event_type").alias("source"), link.alias("link")).distinct()
    extra = pages.select("source", F.lit("https://d.example.net/about.html").alias("link")).distinct()
    return pages.union(extra).withColumn("day", dates.day_date(urls.file_name(F.col("link"))))


def _day_marks(spark, sf_dir):
    kinds = R.table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()
    mark = F.when(F.col("source") == "click", "20240128093000").when(F.col("source") == "view", "20240105000000")
    return kinds.withColumn("mark", mark)


_DAYS = """
    d AS (SELECT DISTINCT event_type AS source, strftime(ts, '%Y%m%d') AS day,
                 'https://d.example.net/' || event_type || '/' || strftime(ts, '%Y-%m-%d') || '.html' AS link
          FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM d),
    chosen AS (SELECT source, day, link FROM r WHERE rn <= 5 AND CASE source
        WHEN 'click' THEN day >= '20240128' WHEN 'view' THEN day >= '20240105' ELSE rn = 1 END)"""


@query("inc_05_select_days", f"WITH {_DAYS} SELECT source, day, link FROM chosen")
def select_days(spark, sf_dir):
    days = selection.select_days(_day_pages(spark, sf_dir), _day_marks(spark, sf_dir), max_days=5)
    return days.select("source", "day", "link")


@query(
    "inc_06_expand_days",
    f"""
    WITH {_DAYS}
    SELECT source, 'https://d.example.net/' || source || '/download/' || event_id || '.GZ' AS link
    FROM chosen JOIN events ON event_type = source AND strftime(ts, '%Y%m%d') = day
    WHERE event_id % 4 <> 0""",
)
def expand_days(spark, sf_dir):
    days = selection.select_days(_day_pages(spark, sf_dir), _day_marks(spark, sf_dir), max_days=5)
    suffix = F.when(F.col("event_id") % 4 == 0, ".txt").otherwise(".GZ")
    anchor = F.concat(F.lit('<a href="download/'), R.text("event_id"), suffix, F.lit('">f</a>'))
    link = F.concat_ws("/", F.lit("https://d.example.net"), "event_type", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".html")))
    # Captures are cut by event range, so one busy day is several captures.
    captures = (
        R.table(spark, sf_dir, "events")
        .groupBy(link.alias("url"), F.floor(F.col("event_id") / R.ROWS_PER_RESPONSE))
        .agg(F.array_join(F.array_sort(F.collect_list(anchor)), "\n").alias("html"))
        .select("url", "html")
    )
    return selection.expand_days(days, captures).select("source", "link")


@query(
    "inc_07_dedup_first",
    f"""
    WITH {E.LISTING}
    SELECT source, fname, page, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY source, fname ORDER BY page, pos) AS rn FROM listing)
    WHERE rn = 1""",
)
def dedup_first(spark, sf_dir):
    listed = R.listing(spark, sf_dir).select("source", "fname", "page", "pos")
    return dedup.dedup_first(listed, ["source", "fname"], ["page", "pos"])


@query(
    "inc_08_dedup_last",
    f"""
    WITH {E.LISTING}
    SELECT source, category, fname, page, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY source, fname ORDER BY category DESC, page DESC, pos DESC) AS rn
      FROM listing WHERE category IN (2, 4))
    WHERE rn = 1""",
)
def dedup_last(spark, sf_dir):
    listed = R.listing(spark, sf_dir).where(filters.full_snapshot(F.col("category")))
    rows = listed.select("source", "category", "fname", "page", "pos")
    # Over all categories: the later category wins.
    return dedup.dedup_last(rows, ["source", "fname"], ["category", "page", "pos"])


# Links short enough to recur: what a listing repeats from page to page.
_SHORT = "'f' || (l_partkey % 200) || '-' || (l_suppkey % 10) || '.gz'"


@query(
    "inc_09_dedup_pages",
    f"""
    SELECT source, href, page, pos FROM (
      SELECT *, min(page) OVER (PARTITION BY source, href) AS first FROM (
        SELECT 's' || (l_suppkey % 25) AS source, {_SHORT} AS href, l_linenumber AS page, l_orderkey AS pos FROM lineitem))
    WHERE page = first""",
)
def dedup_pages(spark, sf_dir):
    href = F.concat(F.lit("f"), R.text(F.col("l_partkey") % 200), F.lit("-"), R.text(F.col("l_suppkey") % 10), F.lit(".gz"))
    listed = R.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), R.text(F.col("l_suppkey") % 25)).alias("source"),
        href.alias("href"),
        F.col("l_linenumber").alias("page"),
        F.col("l_orderkey").alias("pos"),
    )
    return dedup.dedup_pages(listed).select("source", "href", "page", "pos")


# Newest-first pages by year.  Sources 0 mod 3 repeat page 2 as page 3, those
# 1 mod 3 have no page 4.
_PAGED = f"""
    {E.LISTING},
    paged AS (
      SELECT source, 2002 - year AS page, href, file_date, pos,
             CAST(substr(source, 2) AS INTEGER) % 3 AS k FROM listing
      WHERE fname NOT LIKE 'Stores%'),
    shown AS (
      SELECT * FROM paged WHERE NOT (k = 0 AND page = 3) AND NOT (k = 1 AND page = 4)
      UNION ALL SELECT source, 3, href, file_date, pos, k FROM paged WHERE k = 0 AND page = 2)"""


@query(
    "inc_10_page_cut",
    f"""
    WITH RECURSIVE {_PAGED}, {E.MARKS},
    firsts AS (SELECT *, min(page) OVER (PARTITION BY source, href) AS first FROM shown WHERE page <= 6),
    p AS (
      SELECT source, page, bool_or(first = page) AS unseen,
             coalesce(bool_and(coalesce(file_date, '') <= mark), false) AS old
      FROM firsts JOIN marks USING (source) GROUP BY source, page),
    walked AS (
      SELECT source, page, old FROM p WHERE page = 1 AND unseen
      UNION ALL
      SELECT p.source, p.page, p.old FROM walked w JOIN p ON p.source = w.source AND p.page = w.page + 1
      WHERE NOT w.old AND p.unseen)
    SELECT source, page, href, pos FROM firsts JOIN walked USING (source, page) WHERE first = page""",
)
def page_cut(spark, sf_dir):
    listed = dated_listing(spark, sf_dir).withColumn("page", F.lit(2002) - F.col("year"))
    paged = listed.where(filters.has_prefix(F.col("fname"))).select("source", "page", "href", "file_date", "pos")
    kind = F.substring("source", 2, 9).cast("int") % 3
    shown = paged.where(~((kind == 0) & (F.col("page") == 3)) & ~((kind == 1) & (F.col("page") == 4)))
    repeated = F.when((kind == 0) & (F.col("page") == 2), F.array(F.lit(2), F.lit(3)))
    pages = shown.select("source", "href", "file_date", "pos", F.explode(F.coalesce(repeated, F.array("page"))).alias("page"))
    cut = selection.page_cut(pages, stored_marks(spark, sf_dir), cap=6)
    return cut.select("source", "page", "href", "pos")


@query(
    "inc_11_completeness",
    f"""
    SELECT event_id // {R.ROWS_PER_RESPONSE} % 3 AS source, count(*) AS n_rows,
           CAST({R.ROWS_PER_RESPONSE} + max(CASE WHEN event_id // {R.ROWS_PER_RESPONSE} % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS reported,
           count(*) >= {R.ROWS_PER_RESPONSE} + max(CASE WHEN event_id // {R.ROWS_PER_RESPONSE} % 4 = 3 THEN 1 ELSE 0 END) AS complete
    FROM events GROUP BY 1""",
)
def completeness(spark, sf_dir):
    from feedline.plans.sources import responses

    answers = responses(spark, sf_dir).withColumn("source", F.col("response") % 3)
    return selection.completeness(listings.listing_totals(answers, "body", keep=("source",)))


@query(
    "inc_12_skip_rejected",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 7 <> 3",
)
def skip_rejected(spark, sf_dir):
    answers = R.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 7 == 3, 400).otherwise(200).alias("status")
    )
    rows = R.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return selection.skip_rejected(rows, answers, on="l_suppkey")


_CATEGORY = "CAST(o_orderkey % 2 * 2 + 2 AS INTEGER)"


@query(
    "inc_13_refresh_links",
    f"""
    WITH links AS (
      SELECT o_orderkey AS k, {_CATEGORY} AS category, CAST(o_orderkey % 7 + 1 AS INTEGER) AS page,
             o_orderdate > TIMESTAMP '1998-06-15 12:02:00' AS fresh,
             'https://b.example.net/f' || o_orderkey || '?se=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS href
      FROM orders),
    relisted AS (
      SELECT l_orderkey AS k, l_linenumber AS page, l_partkey AS pos,
             'https://b.example.net/f' || l_orderkey || '?v=' || l_partkey || '-' || l_suppkey AS href
      FROM lineitem),
    on_page AS (SELECT k, page, arg_max(href, (pos, href)) AS h FROM relisted GROUP BY ALL),
    in_cat AS (SELECT k, arg_max(href, (page, pos, href)) AS h FROM relisted GROUP BY ALL)
    SELECT 'f' || links.k AS name, category, links.page,
           CASE WHEN fresh THEN href ELSE coalesce(on_page.h, in_cat.h) END AS href,
           CASE WHEN fresh THEN 'fresh' WHEN on_page.h IS NOT NULL THEN 'page'
                WHEN in_cat.h IS NOT NULL THEN 'category' ELSE 'vanished' END AS status
    FROM links LEFT JOIN on_page ON links.k = on_page.k AND links.page = on_page.page
      LEFT JOIN in_cat ON links.k = in_cat.k""",
)
def refresh_links(spark, sf_dir):
    def identity(key: str):
        return F.concat(F.lit("f"), R.text(key)).alias("name"), (F.col(key) % 2 * 2 + 2).cast("int").alias("category")

    root = F.lit("https://b.example.net/f")
    expiry = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    links = R.table(spark, sf_dir, "orders").select(
        *identity("o_orderkey"),
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("page"),
        F.concat(root, R.text("o_orderkey"), F.lit("?se="), expiry).alias("href"),
    )
    relisting = R.table(spark, sf_dir, "lineitem").select(
        *identity("l_orderkey"),
        F.col("l_linenumber").alias("page"),
        F.col("l_partkey").alias("pos"),
        F.concat(root, R.text("l_orderkey"), F.lit("?v="), R.text("l_partkey"), F.lit("-"), R.text("l_suppkey")).alias("href"),
    )
    return selection.refresh_links(links, relisting, F.to_timestamp(F.lit("1998-06-15 12:00:00")))


@query(
    "inc_14_union_sources",
    """
    WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN 'north' WHEN s_suppkey % 5 = 3 THEN 'south' END AS source FROM supplier)
    SELECT source, count(*) AS n_keys, min(key) AS first_key, max(key) AS last_key
    FROM (SELECT source, source || '/' || s_suppkey AS key FROM s WHERE source IS NOT NULL) GROUP BY source
    UNION ALL SELECT 'broken', 0, NULL, NULL""",
)
def union_sources(spark, sf_dir):
    supplier = R.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey") % 5
    north = supplier.where(key < 3).select(F.concat(F.lit("north/"), R.text("s_suppkey")).alias("key"), "s_name")
    south = supplier.where(key == 3).select(F.concat(F.lit("south/"), R.text("s_suppkey")).alias("key"))
    union = selection.union_sources({"north": north, "broken": None, "south": south})
    # Source names stand in a table, as a registry would hold them.
    names = R.table(spark, sf_dir, "region").select(
        F.get(F.array(F.lit("north"), F.lit("south"), F.lit("broken")), F.col("r_regionkey").cast("int") % 3).alias("source")
    )
    return selection.results_by_source(union, names)


@query(
    "inc_14_isolated_sources",
    """
    SELECT 's' || k AS source, CASE WHEN k IN (1, 3) THEN 'failed' ELSE 'complete' END AS state,
           CASE WHEN k IN (1, 3) THEN 0 ELSE n END AS n_rows, CASE WHEN k IN (1, 3) THEN 0 ELSE n END AS n_stored,
           CASE k WHEN 1 THEN 'USER_RAISED_EXCEPTION' WHEN 3 THEN 'ValueError' END AS reason
    FROM (SELECT o_orderkey % 5 AS k, count(*) AS n FROM orders GROUP BY ALL)""",
)
def isolated_sources(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders")

    def job(k: int):
        def rows():
            if k == 3:
                raise ValueError("no such page")
            key = F.col("o_orderkey")
            mine = orders.where(key % 5 == k).select(F.concat(F.lit(f"s{k}/"), R.text(key)).alias("key"))
            if k == 1:
                # Fails in a task, after other tasks have written.
                mine = mine.withColumn("key", F.when(F.col("key").endswith("6"), F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("key")))
            return mine

        return rows

    path = new_scratch(spark, "sources")
    outcomes = isolation.run_sources(spark, {f"s{k}": job(k) for k in range(5)}, path, "1")
    stored = isolation.stored_rows(spark, path, "1").groupBy("source").agg(F.count("key").alias("n_stored"))
    return outcomes.join(stored, "source", "left").select(
        "source", "state", "n_rows", F.coalesce("n_stored", F.lit(0)).cast("bigint").alias("n_stored"),
        F.substring_index("reason", ":", 1).alias("reason"),
    )


@query(
    "inc_15_plan_cycle",
    f"""
    WITH {E.LISTING}, {E.MARKS},
    s AS (SELECT source, max(file_date) AS newest, count(*) FILTER (mark IS NULL OR file_date > mark) AS n
          FROM listing JOIN marks USING (source) GROUP BY source)
    SELECT source, CASE WHEN n > 0 THEN coalesce(newest, mark) ELSE mark END AS mark, coalesce(n, 0) AS n_new
    FROM marks LEFT JOIN s USING (source)""",
)
def plan_cycle(spark, sf_dir):
    fresh, marks = selection.plan_cycle(dated_listing(spark, sf_dir), stored_marks(spark, sf_dir))
    counts = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return marks.join(counts, "source", "left").select("source", "mark", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_new"))


@query(
    "inc_15_run_cycle",
    f"""
    WITH {E.LISTING},
    wanted AS (SELECT * FROM listing WHERE fname NOT LIKE 'Stores%'),
    m1 AS (SELECT source, max(file_date) AS mark FROM wanted WHERE year < 1998 GROUP BY source),
    n1 AS (SELECT source, count(*) AS n FROM wanted WHERE year < 1998 GROUP BY source),
    n2 AS (SELECT source, count(*) AS n FROM wanted JOIN m1 USING (source) WHERE file_date > mark GROUP BY source),
    m2 AS (SELECT source, max(file_date) AS mark FROM wanted GROUP BY source)
    SELECT source, m2.mark, n1.n + coalesce(n2.n, 0) AS n_links
    FROM m2 JOIN n1 USING (source) LEFT JOIN n2 USING (source)""",
)
def run_cycle(spark, sf_dir):
    listed = R.listing(spark, sf_dir)
    marks, out = new_scratch(spark, "marks"), new_scratch(spark, "links")
    style = cycle.STYLES["paged_html"]
    cycle.run_cycle(listed.where(F.col("year") < 1998), style, marks, out, "1")
    cycle.run_cycle(listed, style, marks, out, "2")
    counted = spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("n_links"))
    return load_checkpoint(spark, marks).join(counted, "source")


def _two_runs(wanted: str) -> str:
    """Expected marks and links after a run over the years before 1998 and one over all."""
    return f"""
    WITH {E.LISTING},
    wanted AS ({wanted}),
    m1 AS (SELECT source, max(file_date) AS mark, count(*) AS n FROM wanted WHERE year < 1998 GROUP BY source),
    n2 AS (SELECT source, count(*) AS n FROM wanted JOIN m1 USING (source) WHERE file_date > mark GROUP BY source),
    m2 AS (SELECT source, max(file_date) AS mark FROM wanted GROUP BY source)
    SELECT source, m2.mark, m1.n + coalesce(n2.n, 0) AS n_links
    FROM m2 JOIN m1 USING (source) LEFT JOIN n2 USING (source)"""


_ROOT = R.LINK_ROOT + "/"


def _runs(spark, style: str, captures, first: str = "year < 1998", before=None, **options):
    """Marks and links after two cycles over the captures that ``captures(condition)`` gives."""
    marks, out = new_scratch(spark, "marks"), new_scratch(spark, "links")
    if before is not None:
        save_checkpoint(before, marks)
    for batch, condition in (("1", first), ("2", "true")):
        found = captures(condition)
        pages = {"day_pages": found[1]} if isinstance(found, tuple) else {}
        index = found[0] if pages else found
        cycle.run_style(index, cycle.STYLES[style], marks, out, batch, _ROOT, **pages, **options)
    counted = spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("n_links"))
    return load_checkpoint(spark, marks).join(counted, "source")


@query("inc_15_cycle_paged_json", _two_runs("SELECT * FROM listing WHERE fname NOT LIKE 'Stores%' AND pos % 10 <> 0"))
def cycle_paged_json(spark, sf_dir):
    kind = F.when(F.col("pos") % 10 == 0, "dir").otherwise("file").alias("type")
    entry = F.to_json(F.struct(kind, "fname"))

    def captures(condition):
        rows = R.listing(spark, sf_dir).where(condition)
        return R.captured(rows, ["source"], entry, '{"aaData": [', "]}", ",")

    return _runs(spark, "paged_json", captures)


@query(
    "inc_15_cycle_catalog_json",
    f"""
    WITH {E.LISTING},
    wanted AS (
      SELECT DISTINCT source, replace(fname, '-19', '-20') AS fname, '20' || substr(file_date, 3) AS file_date
      FROM listing WHERE fname NOT LIKE 'Stores%' AND pos % 3 <> 2),
    marked AS (SELECT *, CASE WHEN source = 's3' THEN '20960615000000' END AS old FROM wanted),
    fresh AS (SELECT * FROM marked WHERE CASE WHEN old IS NULL THEN coalesce(file_date, '') >= '20970101000000' ELSE file_date > old END)
    SELECT source, max(file_date) AS mark, count(*) AS n_links FROM fresh GROUP BY source""",
)
def cycle_catalog_json(spark, sf_dir):
    entry = F.to_json(F.struct(F.concat(F.lit(" "), "fname").alias("fileName"), F.lit(None).cast("string").alias("fileType")))

    def captures(condition):
        rows = R.listing(spark, sf_dir).where(condition).withColumn("fname", F.replace("fname", F.lit("-19"), F.lit("-20")))
        # Each name is listed by the next chain as well; one chain is refused.
        chains = F.array(F.col("pos") % 3, F.when(F.col("pos") % 3 == 0, 1))
        rows = rows.withColumn("chain", F.explode(F.filter(chains, lambda c: c.isNotNull())))
        listed = R.captured(rows, ["source", "chain"], entry, '{"count": 1, "files": [', "]}", ",")
        answers = spark.range(3).select(F.col("id").alias("chain"), F.when(F.col("id") == 2, 400).otherwise(200).alias("status"))
        return selection.skip_rejected(listed, answers, on="chain")

    # A mark of eight digits, and a first day for the sources without one; the second run finds nothing new.
    before = spark.createDataFrame([("s3", "20960615")], "source STRING, mark STRING")
    return _runs(spark, "catalog_json", captures, first="true", before=before, start="2097-01-01")


def _anchor():
    return F.concat(F.lit('<li><a href="'), "href", F.lit('">x</a></li>'))


@query(
    "inc_15_cycle_paged_html",
    f"""
    WITH RECURSIVE {_PAGED}, {E.MARKS},
    firsts AS (SELECT *, min(page) OVER (PARTITION BY source, href) AS first FROM shown WHERE page <= 6),
    p AS (
      SELECT source, page, bool_or(first = page) AS unseen,
             coalesce(bool_and(coalesce(file_date, '') <= mark), false) AS old
      FROM firsts JOIN marks USING (source) GROUP BY source, page),
    walked AS (
      SELECT source, page, old FROM p WHERE page = 1 AND unseen
      UNION ALL
      SELECT p.source, p.page, p.old FROM walked w JOIN p ON p.source = w.source AND p.page = w.page + 1
      WHERE NOT w.old AND p.unseen),
    fresh AS (
      SELECT source, file_date FROM firsts JOIN walked USING (source, page) JOIN marks USING (source)
      WHERE first = page AND (mark IS NULL OR file_date > mark))
    SELECT source, coalesce(max(file_date), any_value(mark)) AS mark, count(*) AS n_links
    FROM fresh JOIN marks USING (source) GROUP BY source""",
)
def cycle_paged_html(spark, sf_dir):
    def captures(_):
        kind = F.substring("source", 2, 9).cast("int") % 3
        rows = R.listing(spark, sf_dir).withColumn("page", F.lit(2002) - F.col("year"))
        shown = rows.where(~((kind == 0) & (F.col("page") == 3)) & ~((kind == 1) & (F.col("page") == 4)))
        repeated = F.when((kind == 0) & (F.col("page") == 2), F.array(F.lit(2), F.lit(3)))
        pages = shown.withColumn("page", F.explode(F.coalesce(repeated, F.array("page"))))
        found = R.captured(pages, ["source", "page"], _anchor(), "<ul>", "<li><a href='/about.html'></a></li></ul>")
        return found.withColumnRenamed("body", "html").withColumn("url", F.lit(R.LINK_ROOT))

    # The second run is over the same pages: it finds nothing new and moves no mark.
    return _runs(spark, "paged_html", captures, before=stored_marks(spark, sf_dir), cap=6)


@query("inc_15_cycle_signed_html", _two_runs("SELECT DISTINCT source, fname, file_date, year FROM listing WHERE category IN (2, 4)"))
def cycle_signed_html(spark, sf_dir):
    signed = F.concat(F.lit('<a href="'), "href", F.lit("?se=2024-01-01&amp;page="), R.text("page"), F.lit('"></a>'))
    other = F.concat(signed, F.lit('<a href="https://elsewhere.example.net/'), "fname", F.lit('"></a>'))

    def captures(condition):
        rows = R.listing(spark, sf_dir).where(condition)
        found = R.captured(rows, ["source", "category", "page"], other, "<div>", "</div>")
        return found.withColumnRenamed("body", "html").withColumn("url", F.lit(R.LINK_ROOT))

    return _runs(spark, "signed_html", captures, suffixes=None, host="files.example.net")


@query("inc_15_cycle_table_html", _two_runs("SELECT * FROM listing"))
def cycle_table_html(spark, sf_dir):
    row = F.concat(F.lit("<tr>" + "<td>1</td>" * 5 + '<td><a href="/'), "source", F.lit("/"), "fname", F.lit('">d</a></td></tr>'))

    def captures(condition):
        rows = R.listing(spark, sf_dir).where(condition)
        found = R.captured(rows, ["source"], row, '<table class="gzTable"><tbody>', "</tbody></table>")
        return found.withColumnRenamed("body", "html").withColumn("url", F.lit(R.LINK_ROOT))

    return _runs(spark, "table_html", captures)


@query(
    "inc_15_cycle_day_pages",
    f"""
    WITH {E.LISTING},
    dated AS (SELECT * FROM listing WHERE file_date IS NOT NULL),
    d1 AS (SELECT source, max(substr(file_date, 1, 8)) AS day FROM dated WHERE year < 1998 GROUP BY source),
    m1 AS (SELECT source, max(file_date) AS mark, count(*) AS n FROM dated JOIN d1 USING (source) WHERE substr(file_date, 1, 8) = day GROUP BY source),
    n2 AS (SELECT source, count(*) AS n FROM dated JOIN m1 USING (source) WHERE file_date > mark GROUP BY source),
    m2 AS (SELECT source, max(file_date) AS mark FROM dated GROUP BY source)
    SELECT source, m2.mark, m1.n + coalesce(n2.n, 0) AS n_links FROM m2 JOIN m1 USING (source) LEFT JOIN n2 USING (source)""",
)
def cycle_day_pages(spark, sf_dir):
    def captures(condition):
        rows = dated_listing(spark, sf_dir).where(condition).where(F.col("file_date").isNotNull())
        day = F.substring("file_date", 1, 8)
        page = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
        dated = rows.withColumn("url", F.concat(F.lit(_ROOT), "source", F.lit("/"), page, F.lit(".html")))
        pages = dated.groupBy("url").agg(R.joined(F.collect_list(F.struct("pos", "fname", _anchor().alias("xml")))).alias("html"))
        listed = dated.select("source", "url").distinct().withColumn("xml", F.concat(F.lit('<a href="'), "url", F.lit('">d</a>')))
        index = listed.groupBy("source").agg(R.joined(F.collect_list(F.struct("url", "xml"))).alias("html"))
        return index.withColumn("url", F.lit(R.LINK_ROOT)), pages

    return _runs(spark, "day_pages", captures)
