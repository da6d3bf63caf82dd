"""Incremental selection against step-by-step counterparts on small listings."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedline.operators import blocks, cycle, dedup, filters, isolation, links, load, read, selection

LISTING = "source STRING, page INT, pos INT, href STRING, file_date STRING"
MARKS = "source STRING, mark STRING"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def walk(rows, mark, cap):
    """Page by page, as a client would read a newest-first listing."""
    pages, seen, kept, page = {}, set(), [], 1
    for row in rows:
        pages.setdefault(row[1], []).append(row)
    while page <= cap:
        listed = pages.get(page, [])
        fresh = [r for r in listed if r[3] not in seen]
        if not fresh:
            break
        seen.update(r[3] for r in fresh)
        kept += fresh
        if mark and all((r[4] or "") <= mark for r in listed):
            break
        page += 1
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_page_cut_walks_like_a_client(spark, seed):
    rng = random.Random(seed)
    rows, marks = [], []
    for s in range(12):
        source = f"s{s}"
        marks.append((source, rng.choice([None, "20240105", "20240108", "20240103"])))
        for page in range(1, rng.randint(1, 9)):
            if rng.random() < 0.1:
                continue
            for pos in range(rng.randint(1, 5)):
                n = rng.randint(0, 30) if rng.random() < 0.5 else page * 100 + pos
                day = None if n % 11 == 0 else f"202401{max(1, 11 - page - n % 3):02d}"
                rows.append((source, page, pos, f"f{n}", day))
    # One date per link, as it is read from the name.
    date_of = {r[3]: r[4] for r in rows}
    rows = [(*r[:4], date_of[r[3]]) for r in rows]
    cut = selection.page_cut(frame(spark, rows, LISTING), frame(spark, marks, MARKS), cap=6)
    want = []
    for source, mark in marks:
        want += walk([r for r in rows if r[0] == source], mark, 6)
    assert sorted(map(str, map(tuple, cut.select("source", "page", "pos", "href", "file_date").collect()))) == sorted(map(str, want))


def test_new_links_boundaries(spark):
    rows = [("a", 1, i, f"f{i}", d) for i, d in enumerate(["20240101000000", "20240102000000", "20240103000000", None])]
    rows += [("b", 1, 9, "g", None)]
    listed = frame(spark, rows, LISTING)
    marked = frame(spark, [("a", "20240102000000"), ("b", None)], MARKS)
    assert sorted(r.href for r in selection.new_links(listed, marked).collect()) == ["f2", "g"]
    none = frame(spark, [], MARKS)
    assert selection.new_links(listed, none).count() == 5
    start = selection.new_links_from(listed, none, start="2024-01-02")
    assert sorted(r.href for r in start.collect()) == ["f1", "f2"]
    assert selection.new_links_from(listed, none).count() == 5
    by_day = frame(spark, [("a", "20240102")], MARKS)
    assert sorted(r.href for r in selection.new_links_from(listed, by_day, start="20240103").collect()) == ["f2"]


def test_days(spark):
    rows = [("a", f"202401{d:02d}", f"{d}.html") for d in range(1, 8)] + [("a", None, "about.html"), ("b", "20240101", "x"), ("b", "20240103", "y"), ("b", "20240103", "z")]
    days = frame(spark, rows, "source STRING, day STRING, link STRING")
    marked = frame(spark, [("a", "20240105120000"), ("b", None)], MARKS)
    chosen = selection.select_days(days, marked)
    assert sorted(r.link for r in chosen.collect()) == ["5.html", "6.html", "7.html", "z"]
    assert sorted(r.link for r in selection.select_days(days, marked, max_days=2).collect()) == ["6.html", "7.html", "z"]
    assert selection.select_days(days, marked, max_days=0).count() == 0


def test_dedup(spark):
    rows = [("k", 2, "b"), ("k", 1, "c"), ("k", 1, "a"), ("n", None, "z"), ("n", 5, "y")]
    df = frame(spark, rows, "key STRING, at INT, v STRING")
    assert {(r.key, r.v) for r in dedup.dedup_first(df.where("key = 'k'"), ["key"], ["at"]).collect()} == {("k", "a")}
    assert {(r.key, r.v) for r in dedup.dedup_last(df, ["key"], ["at"]).collect()} == {("k", "b"), ("n", "y")}
    pages = frame(spark, [("s", 2, 0, "x", None), ("s", 1, 0, "x", None), ("s", 1, 1, "x", None), ("s", 2, 1, "y", None)], LISTING)
    assert sorted((r.page, r.href) for r in dedup.dedup_pages(pages).collect()) == [(1, "x"), (1, "x"), (2, "y")]


def test_copies_collapse_before_the_shuffle(spark, plan):
    df = frame(spark, [("k", 1, "a")], "key STRING, at INT, v STRING")
    shown = plan(dedup.dedup_last(df, ["key"], ["at"]), "simple")
    below = shown.split("Exchange hashpartitioning")[1]
    assert "partial_max" in below and "Window" not in shown


def test_marks_are_broadcast_by_size(spark, plan, tmp_path):
    from feedline.sources import marks

    path = str(tmp_path / "m")
    marks.save_checkpoint(frame(spark, [("a", "1")], MARKS), path)
    rows = spark.range(100_000).select((F.col("id") % 3).cast("string").alias("source"), F.col("id").cast("string").alias("file_date"))
    shown = plan(selection.new_links(rows, marks.load_checkpoint(spark, path)), "simple")
    assert "BroadcastHashJoin" in shown and "Exchange hashpartitioning" not in shown


def test_refresh(spark):
    now = F.lit(datetime(2026, 8, 2, 3, 0))
    live, dead = "https://b/f?se=2026-08-02T04:00:00Z", "https://b/f?se=2026-08-02T03:01:00Z"
    old = frame(spark, [("a", 2, 1, live), ("b", 2, 1, dead), ("c", 2, 1, dead), ("d", 4, 1, dead)], "name STRING, category INT, page INT, href STRING")
    again = frame(
        spark,
        [("a", 2, 1, 0, "n"), ("b", 2, 1, 0, "b0"), ("b", 2, 1, 5, "b5"), ("b", 2, 2, 0, "b9"), ("c", 2, 3, 0, "c3"), ("d", 2, 1, 0, "d")],
        "name STRING, category INT, page INT, pos INT, href STRING",
    )
    got = {r.name: (r.href, r.status) for r in selection.refresh_links(old, again, now).collect()}
    assert got == {"a": (live, "fresh"), "b": ("b5", "page"), "c": ("c3", "category"), "d": (None, "vanished")}


def test_cycle_marks(spark):
    rows = [("a", 1, 0, "f", "5"), ("b", 1, 0, "g", "3"), ("c", 1, 0, "h", None), ("new", 1, 0, "i", "7")]
    marks = frame(spark, [("a", "4"), ("b", "4"), ("c", None), ("idle", "9")], MARKS)
    fresh, after = selection.plan_cycle(frame(spark, rows, LISTING), marks)
    assert sorted(r.href for r in fresh.collect()) == ["f", "h", "i"]
    assert dict(after.collect()) == {"a": "5", "b": "4", "c": None, "idle": "9", "new": "7"}


def test_filters(spark):
    df = frame(spark, [("PriceFull1", None), ("pricefull1", None), ("Stores", "PROMOFULL"), (None, "pricefull"), (" ", "pricefull")], "f STRING, t STRING")
    assert [r[0] for r in df.select(filters.wanted_entry(F.col("f"), F.col("t"))).collect()] == [True, False, True, False, False]
    assert [r[0] for r in df.select(filters.has_prefix(F.col("f"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in frame(spark, [("file",), ("dir",), (None,)], "k STRING").select(filters.is_file(F.col("k"))).collect()] == [True, False, False]


def test_table_links(spark):
    cells = "<td>1</td>" * 5
    html = f"""<table class="big gzTable"><thead><tr>{cells}<td><a href="/head"></td></tr></thead><tbody>
    <tr>{cells}<td><b><a title="t" href="get/a.gz?x=1&amp;y=2">d</a></b></td></tr><tr>{cells}</tr><tr>{cells}<td><a>no</a><a href="/second"></td></tr>
    </tbody></table><table class="gzTable2"><tbody><tr>{cells}<td><a href="/no"></a></td></tr></tbody></table>"""
    found = links.table_links(frame(spark, [(html,)], "html STRING"), base=F.lit("https://h.example"))
    assert [(r.pos, r.link) for r in found.collect()] == [(0, "https://h.example/get/a.gz?x=1&y=2")]


JOBS = """<body><div class="job-box first"><div class="job-content-top-title-ltr"><h2> Lead <b>dev</b></h2></div>
<div class="T14">Co &amp; sons</div><p>unclosed<br><span class="job-regions-content">North</span>
<div class="job-content-top-desc">Text <div class="job-box"><h2>stray</h2><div class="T14">Inner</div></div> after</div>
<a class="tag">x</a><a class="tag"></a><a class="tag">y <i>z</i></a></div>
<div class="job-boxes"></div><h2>outside</h2><div class='job-box'><div class="job-content-top-desc"></div></div></body>"""

SPEC = {
    "block": {"tag": "div", "class": "job-box"},
    "fields": {
        "title": {"within": {"tag": "div", "class_prefix": "job-content-top-title"}, "tag": "h2"},
        "company": {"class": "T14"},
        "location": {"class_any": ["job-content-top-location", "job-regions-content"]},
        "description": {"class": "job-content-top-desc"},
        "tags": {"tag": "a", "class": "tag", "all": True},
    },
}


def test_blocks(spark):
    pages = frame(spark, [(1, JOBS), (2, "<p>none</p>"), (3, None)], "id INT, html STRING")
    rows = blocks.extract_blocks(pages, "id", "html", SPEC).orderBy("block").collect()
    assert [tuple(r) for r in rows] == [
        (1, 1, "Lead dev", "Co & sons", "North", "Text stray Inner after", ["x", "", "y z"]),
        (1, 2, None, "Inner", None, None, []),
        (1, 3, None, None, None, "", []),
    ]


def test_blocks_need_no_shuffle(spark, plan):
    pages = frame(spark, [(1, JOBS)], "id INT, html STRING")
    shown = plan(blocks.extract_blocks(pages, "id", "html", SPEC), "simple")
    assert "Exchange" not in shown and "Join" not in shown and "Window" not in shown


def test_blocks_of_broken_markup(spark):
    html = """</div></p><div class="job-box"><p>a</p></div></div><div class=job-box><br class="T14"/>b<h2>c <!-- <div> --> d &ampe &lt;</h2>
    <script><div class="job-box"></script><img class="job-box"><DIV CLASS="T14 x">open"""
    spec = {"block": {"class": "job-box"}, "fields": {"whole": {"self": True}, "t14": {"class": "T14"}, "all14": {"class": "T14", "all": True}, "h": {"tag": "h2"}}}
    rows = blocks.extract_blocks(frame(spark, [(1, html)], "id INT, html STRING"), "id", "html", spec).orderBy("block").collect()
    assert [tuple(r) for r in rows] == [
        (1, 1, "a", None, [], None),
        (1, 2, "b c  d &e < open", "", ["", "open"], "c  d &e <"),
        (1, 3, "", None, [], None),
    ]


def test_long_pages_take_linear_time(spark):
    import time

    from feedline.functions.page_blocks import page_blocks

    def seconds(n):
        start = time.perf_counter()
        assert len(page_blocks("<p>x</p><div class='job-box'><a class='tag'>y</a></div>" * n, SPEC)) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


def test_upserts(spark):
    schema = "k STRING, at STRING, v INT"
    table = frame(spark, [("a", "1", 1), ("b", "5", 1)], schema)
    batch = frame(spark, [("a", "2", 2), ("b", "4", 2), ("c", None, 2)], schema)
    once = load.upsert(table, batch, ["k"], ["at"])
    twice = load.upsert(once, batch, ["k"], ["at"])
    want = [("a", "2", 2), ("b", "5", 1), ("c", None, 2)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    new = load.insert_new(table, frame(spark, [("a", "9", 9), ("z", "2", 2), ("z", "1", 1), (None, "1", 1)], schema), key="k", order=("at",))
    assert [tuple(r) for r in new.collect()] == [("z", "1", 1)]


def test_messages_split(spark):
    rows = [('{"k":"a","n":1}',), ('{"k":"a"',), ('{"n":1}',), ('{"k":"","n":1}',), ("[1]",), (None,)]
    valid, rejected = load.decode_messages(frame(spark, rows, "value STRING"), "k STRING, n INT", ["k"])
    assert [tuple(r) for r in valid.collect()] == [("a", 1)]
    assert rejected.count() == 5


def test_reads(spark, plan):
    rows = [(i, f"text {i}", f"a{i % 3}", ["x"] if i % 2 else [], i) for i in range(1, 30)]
    quotes = frame(spark, rows, "id INT, text STRING, author STRING, tags ARRAY<STRING>, word_count INT")
    assert [r.id for r in read.list_quotes(quotes, author="a1", tag="x", limit=2, offset=1).collect()] == [7, 13]
    assert [r.id for r in read.list_quotes(quotes, limit=2, after=4).collect()] == [5, 6]
    assert [tuple(r) for r in read.top_authors(quotes, 2).collect()] == [("a1", 10), ("a2", 10)]
    for df in (read.top_authors(quotes), read.list_quotes(quotes, limit=20, offset=5)):
        assert "TakeOrderedAndProject" in plan(df, "simple")
    assert [tuple(r)[0] for r in read.search(quotes, "TEXT 7").select("id").collect()] == [7]
    assert read.search(quotes, "...").count() == 0


def test_styles(spark):
    rows = [
        ("a", "https://h/d/PriceFull1-20240101-000000.gz", "PriceFull1-20240101-000000.gz", None, 2),
        ("a", "https://h/20240105-000000/Stores1.gz?v=20240102-000000", "Stores1.gz", "PRICEFULL", 4),
        ("a", "https://h/d/PromoFull-20240103.gz", "PromoFull-20240103.gz", "x", 3),
    ]
    listed = frame(spark, rows, "source STRING, href STRING, fname STRING, file_type STRING, category INT")
    want = {
        "paged_html": ["20240101000000", None],
        "paged_json": ["20240101000000", None],
        "signed_html": ["20240101000000", None],
        "table_html": ["20240101000000", "20240102000000", None],
        "day_pages": ["20240101000000", None, None],
        "catalog_json": ["20240101000000", None, "20240103000000"],
    }
    for name, dates in want.items():
        assert [r.file_date for r in cycle.prepare_listing(listed, cycle.STYLES[name]).collect()] == dates, name


def test_failed_write_keeps_the_marks(spark, tmp_path):
    from feedline.sources.marks import load_checkpoint

    marks, out = str(tmp_path / "m"), str(tmp_path / "o")
    listed = frame(spark, [("a", "https://h/PriceFull-20240101-000000.gz")], "source STRING, href STRING")
    style = cycle.STYLES["paged_html"]
    broken = listed.withColumn("href", F.when(F.col("source") == "a", F.raise_error(F.lit("gone"))).cast("string"))
    with pytest.raises(Exception):
        cycle.run_cycle(broken, style, marks, out, "1")
    assert load_checkpoint(spark, marks).count() == 0
    for _ in range(2):
        cycle.run_cycle(listed, style, marks, out, "1")
    assert dict(load_checkpoint(spark, marks).collect()) == {"a": "20240101000000"}
    assert cycle.run_cycle(listed, style, marks, out, "2").count() == 0
    assert spark.read.parquet(out).count() == 1


def test_first_pages_has_no_default_limit(spark):
    from feedline.operators import blocks

    rows = spark.range(1, 9).withColumnRenamed("id", "page")
    with pytest.raises(TypeError):
        blocks.first_pages(rows)
    assert blocks.first_pages(rows, 7).count() == 7


def test_page_cut_scans_its_listing_once(spark, tmp_path):
    path = str(tmp_path / "listing")
    frame(spark, [("a", p, i, f"f{p}{i}", "20240101") for p in (1, 2) for i in range(3)], LISTING).write.parquet(path)
    scanned = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    listed = spark.read.parquet(path).mapInArrow(counted, LISTING)
    cut = selection.page_cut(listed, frame(spark, [("a", None)], MARKS))
    assert cut.count() == 6 and cut.columns == listed.columns
    assert scanned.value == 6


def test_refresh_links_shuffles_three_times(spark, plan):
    links = frame(spark, [("n", 1, 1, "h?se=2024-01-01T00:00:00Z")], "name STRING, category INT, page INT, href STRING")
    again = frame(spark, [("n", 1, 2, 0, "x")], "name STRING, category INT, page INT, pos INT, href STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = selection.refresh_links(links, again, F.to_timestamp(F.lit("2024-06-01 00:00:00")))
        assert plan(found, "simple").count("Exchange hashpartitioning") <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(r) for r in found.collect()] == [("n", 1, 1, "x", "category")]


def test_sources_fail_on_their_own(spark, tmp_path):
    path = str(tmp_path / "out")

    def broken_row():
        key = F.when(F.col("id") == 7, F.raise_error(F.lit("row 7")).cast("string")).otherwise(F.col("id").cast("string"))
        return spark.range(10).select(key.alias("key"))

    def no_file():
        return spark.read.parquet(str(tmp_path / "none"))

    def odd():
        raise KeyError("listing")

    jobs = {"good": lambda: spark.range(3).selectExpr("string(id) AS key"), "row": broken_row, "file": no_file, "odd": odd}
    jobs["empty"] = lambda: spark.range(0).selectExpr("string(id) AS key", "1 AS more")
    found = {r.source: (r.state, r.n_rows, (r.reason or "").split(":")[0]) for r in isolation.run_sources(spark, jobs, path, "1").collect()}
    assert found == {
        "good": ("complete", 3, ""), "empty": ("complete", 0, ""), "row": ("failed", 0, "USER_RAISED_EXCEPTION"),
        "file": ("failed", 0, "PATH_NOT_FOUND"), "odd": ("failed", 0, "KeyError"),
    }
    rows = isolation.stored_rows(spark, path, "1")
    assert sorted((r.source, r.key, r.more) for r in rows.collect()) == [("good", str(n), None) for n in range(3)]
    # A source that fails when its batch is run again has nothing left of the first run.
    jobs["good"] = odd
    assert isolation.run_sources(spark, jobs, path, "1").where("state = 'complete'").count() == 1
    assert isolation.stored_rows(spark, path, "1").count() == 0
    assert isolation.stored_rows(spark, str(tmp_path / "out"), "1").columns == ["key", "more", "source"]


def test_pages_of_links_are_taken_apart_once(spark, plan):
    """No filter computes a page's rows or links a second time."""
    row = "<tr>" + "<td>1</td>" * 5 + '<td><a href="{}">d</a></td></tr>'
    html = '<table class="gzTable"><tbody>' + "".join(map(row.format, ("/a.gz", "b.gz", "/c/../d.gz?x=1&amp;y=2#", ""))) + "</tbody></table>"
    pages = spark.createDataFrame([(html,)], "html string")
    base = F.lit("https://h.example.net/s/i.html")
    found = {"tbody": links.table_links(pages, base=base), "[aA]": links.extract_links(pages, base=base, suffixes=(".gz",))}
    for pattern, rows in found.items():
        optimised = plan(rows).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert optimised.count(f"<{pattern}") == 1
    whole = ["https://h.example.net/a.gz", "https://h.example.net/s/b.gz", "https://h.example.net/d.gz?x=1&y=2"]
    assert [r["link"] for r in found["tbody"].collect()] == whole
    assert [r["link"] for r in found["[aA]"].collect()] == whole[:2]
