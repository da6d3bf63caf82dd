"""Incremental selection over listing tables by high-water marks.

Conventions: a listing has ``source``, ``href`` (or another link column) and
``file_date`` (14-digit text or null); a checkpoint has ``source, mark`` with
one row per source.

Marks are joined without a broadcast hint.  A stored checkpoint is far below
``spark.sql.autoBroadcastJoinThreshold`` and is broadcast on that checked
size; a larger one is shuffled, with AQE splitting the partitions of a source
that holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedline.functions.dates import normalize_mark
from feedline.functions.urls import is_fresh
from feedline.operators.dedup import dedup_last
from feedline.operators.links import extract_links
from feedline.session import new_scratch


def newest_mark(listing: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``source, mark``: the highest file date per source, null without any.

    With ``sources`` also those without a listed row appear.
    """
    marks = listing.groupBy("source").agg(F.max("file_date").alias("mark"))
    return marks if sources is None else sources.select("source").distinct().join(marks, "source", "left")


def newest_mark_kept(listing: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """:func:`newest_mark` that never falls behind the checkpoint."""
    found = newest_mark(listing).withColumnRenamed("mark", "_found")
    return found.join(checkpoint, "source", "full_outer").select(
        "source", F.greatest("_found", "mark").alias("mark")
    )


def _marked(listing: DataFrame, checkpoint: DataFrame) -> DataFrame:
    return listing.join(checkpoint.select("source", F.col("mark").alias("_mark")), "source", "left")


def _is_new(date: Column, mark: Column) -> Column:
    return mark.isNull() | (F.coalesce(date, F.lit("")) > mark)


def new_links(listing: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Rows dated strictly after their source's mark; all rows without a mark.

    An undated row only passes on the first run.
    """
    marked = _marked(listing, checkpoint)
    return marked.where(_is_new(F.col("file_date"), F.col("_mark"))).drop("_mark")


def new_links_from(listing: DataFrame, checkpoint: DataFrame, start: str | None = None) -> DataFrame:
    """:func:`new_links`, with a configured first day for sources without a mark.

    The start is inclusive, marks are exclusive; both may have 8, 12 or 14
    digits.
    """
    normal = checkpoint.select("source", normalize_mark(F.col("mark")).alias("mark"))
    marked = _marked(listing, normal)
    date = F.coalesce("file_date", F.lit(""))
    since = normalize_mark(F.lit(start).cast("string"))
    wanted = F.when(F.col("_mark").isNotNull(), date > F.col("_mark")).otherwise(
        since.isNull() | (date >= since)
    )
    return marked.where(wanted).drop("_mark")


def select_days(days: DataFrame, checkpoint: DataFrame, max_days: int | None = None) -> DataFrame:
    """Day pages (``source, day, link``) that may hold new files.

    With a mark: its day and later ones.  Without: only the newest page.
    ``max_days`` keeps the newest so many per source; the row-number filter is
    applied before the shuffle too, so a large source shrinks on the map side.
    """
    marked = _marked(days.where(F.col("day").isNotNull()), checkpoint)
    later = marked.where(F.col("day") >= F.substring("_mark", 1, 8)).drop("_mark")
    first_run = marked.where(F.col("_mark").isNull()).drop("_mark")
    selected = later.unionByName(dedup_last(first_run, ["source"], ["day", "link"]))
    if max_days is None:
        return selected
    newest_first = Window.partitionBy("source").orderBy(F.desc("day"), F.desc("link"))
    ranked = selected.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.where(F.col("_rank") <= max_days).drop("_rank")


def expand_days(
    selected: DataFrame, pages: DataFrame, suffixes: tuple[str, ...] = (".gz",)
) -> DataFrame:
    """File links of the selected day pages.

    ``pages`` holds the captures as ``url, html``; links are resolved against
    the day page they stand on.
    """
    captured = selected.join(pages, selected["link"] == pages["url"]).select("source", "day", "url", "html")
    return extract_links(captured, "html", F.col("url"), suffixes, keep=("source", "day", "url"))


def page_cut(
    listing: DataFrame, checkpoint: DataFrame, cap: int | None = None, key: str = "href"
) -> DataFrame:
    """Rows a newest-first paging run would gather, link copies of later pages left out.

    ``listing`` has ``source, page`` (from 1), the link column and
    ``file_date``, and holds wanted links only.  Per source, paging stops

    * before the first page without an unseen link (or without any link),
    * after the first page whose links are all dated at or before the mark
      (undated counts as old); never by date where there is no mark,
    * after page ``cap``, if one is given.

    The listing is read once: it is grouped by link and page (the copies of a link
    on one page become a list) and stored in the scratch folder; pages, links and
    result come from there.  What is ordered per source is one row per page.
    """
    capped = listing.where(F.col("page") >= 1)
    if cap is not None:
        capped = capped.where(F.col("page") <= cap)
    rest = [c for c in listing.columns if c not in ("source", key, "page")]
    is_old = F.coalesce(F.coalesce("file_date", F.lit("")) <= F.col("_mark"), F.lit(False))
    by_link = (
        _marked(capped, checkpoint)
        .groupBy("source", key, "page")
        .agg(F.bool_and(is_old).alias("_old"), F.collect_list(F.struct(*rest)).alias("_rows"))
    )
    scratch = new_scratch(listing.sparkSession, "pages")
    by_link.write.parquet(scratch)
    by_link = listing.sparkSession.read.schema(by_link.schema).parquet(scratch)
    first_seen = by_link.groupBy("source", key).agg(F.min("page").alias("page"))
    unseen = first_seen.select("source", "page").distinct()
    old = by_link.groupBy("source", "page").agg(F.bool_and("_old").alias("_old"))
    in_order = Window.partitionBy("source").orderBy("page")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    walked = (
        unseen.join(old, ["source", "page"])
        .withColumn("_at", F.row_number().over(in_order))
        .where(F.col("_at") == F.col("page"))
        .withColumn("_stopped", F.coalesce(F.bool_or("_old").over(before), F.lit(False)))
        .where(~F.col("_stopped"))
        .select("source", "page")
    )
    # A link is gathered on its first page, with all its copies there.
    gathered = first_seen.join(walked, ["source", "page"], "left_semi")
    kept = by_link.join(gathered, ["source", key, "page"], "left_semi")
    return kept.select("source", key, "page", F.inline("_rows")).select(*listing.columns)


def completeness(totals: DataFrame) -> DataFrame:
    """Per source: rows delivered against the total reported.

    ``totals`` has ``source, n_rows, reported``, one row per response.
    """
    summed = totals.groupBy("source").agg(
        F.sum("n_rows").alias("n_rows"),
        # One total that cannot be read leaves the source's open.
        F.when(F.count("*") == F.count("reported"), F.max("reported")).cast("bigint").alias("reported"),
    )
    return summed.withColumn("complete", F.coalesce(F.col("n_rows") >= F.col("reported"), F.lit(False)))


def skip_rejected(rows: DataFrame, answers: DataFrame, on: str = "source", rejected: int = 400) -> DataFrame:
    """Rows of the chains whose request was not answered ``rejected``."""
    return rows.join(answers.where(F.col("status") == rejected).select(on), on, "left_anti")


def refresh_links(links: DataFrame, relisting: DataFrame, now: Column) -> DataFrame:
    """Replace links about to lapse by those of a newer listing.

    ``links`` has ``name, category, page, href`` (one row per name);
    ``relisting`` has ``name, category, page, pos, href``.  A stale link takes
    the last relisted one of its own page, else the last of its category.
    Result: ``name, category, page, href, status`` with status ``fresh``,
    ``page``, ``category`` or ``vanished`` (``href`` null).
    """
    # One row for each page of a name before anything is joined: a name with many copies is small then.
    on_page = dedup_last(relisting.select("name", "category", "page", "pos", "href"), ["name", "category", "page"], ["pos"])
    again = on_page.select("name", "category", F.col("page").alias("_page"), "pos", F.col("href").alias("_href"))
    judged = links.select("name", "category", "page", "href", is_fresh(F.col("href"), now).alias("_fresh"))
    both = judged.join(again, ["name", "category"], "left")
    found = both.groupBy("name", "category", "page", "href", "_fresh").agg(
        F.max(F.when(F.col("_page") == F.col("page"), F.col("_href"))).alias("_on_page"),
        # The last row of a category is the last row of its last page.
        F.max(F.when(F.col("_href").isNotNull(), F.struct("_page", "pos", "_href")))["_href"].alias("_in_category"),
    )
    fresh = F.col("_fresh")
    return found.select(
        "name",
        "category",
        "page",
        F.when(fresh, F.col("href")).otherwise(F.coalesce("_on_page", "_in_category")).alias("href"),
        F.when(fresh, "fresh")
        .when(F.col("_on_page").isNotNull(), "page")
        .when(F.col("_in_category").isNotNull(), "category")
        .otherwise("vanished")
        .alias("status"),
    )


def union_sources(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Rows of several sources under one ``source`` column.

    A source that failed is given as ``None`` and contributes no rows; the
    others are unaffected.
    """
    union: DataFrame | None = None
    for source, part in parts.items():
        if part is None:
            continue
        named = part.withColumn("source", F.lit(source))
        union = named if union is None else union.unionByName(named, allowMissingColumns=True)
    if union is None:
        raise ValueError("every source failed")
    return union


def results_by_source(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: how many keys it stored and the first and last of them.

    A source without keys is listed with 0.  The keys themselves stay rows:
    one source may hold most of them, and a list would put them all in one
    task.
    """
    counted = keys.groupBy("source").agg(
        F.count("key").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
    return (
        sources.select("source")
        .distinct()
        .join(counted, "source", "left")
        .withColumn("n_keys", F.coalesce("n_keys", F.lit(0)).cast("bigint"))
    )


def plan_cycle(
    listing: DataFrame, checkpoint: DataFrame, regress: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One run's new links and the marks to store after they are saved.

    A source without a new link keeps its mark, also where it listed newer
    dates; otherwise the mark becomes its newest date, or stays where it
    listed none.  With ``regress=False`` the mark never falls.
    """
    fresh = new_links(listing, checkpoint)
    summed = (
        _marked(listing, checkpoint)
        .groupBy("source")
        .agg(
            F.max("file_date").alias("_newest"),
            F.bool_or(_is_new(F.col("file_date"), F.col("_mark"))).alias("_any"),
        )
    )
    newest = F.col("_newest") if regress else F.greatest("_newest", "mark")
    marks = checkpoint.join(summed, "source", "full_outer").select(
        "source", F.when(F.col("_any"), F.coalesce(newest, "mark")).otherwise(F.col("mark")).alias("mark")
    )
    return fresh, marks
