"""One crawl cycle as jobs: read a listing, select what is new, store it, then move the marks.

A listing style says how a kind of publisher names and lists its files; a new
publisher is a dict, not code:

* ``reader``: what the captures are: ``json`` (offset-paged rows), ``catalog``
  (entries), ``html`` (anchors), ``table`` (rows of a table), ``days`` (an index of
  day pages);
* ``wanted``: ``prefix`` (report type in the name), ``entry`` (name or stated
  type), ``category`` (full-snapshot categories), or None for all;
* ``folder``: for readers that list names, where below the root a file lies;
* ``keep_first``, ``keep_last``: one link for each name, by these columns;
* ``cut``: True where paging ends at pages without news;
* ``date`` and ``date_on``: the date mode, and whether it reads the whole
  ``link``, its ``last`` segment with the query, or the file ``name``;
* ``normalize``: True where marks and the start day have 8, 12 or 14 digits.

The mark of a source never falls: it moves to the newest of the links stored, and
these are all dated after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedline.functions.dates import day_date, file_date, normalize_mark
from feedline.functions.urls import file_name
from feedline.operators import filters, links
from feedline.operators.dedup import dedup_first, dedup_last
from feedline.operators.selection import expand_days, new_links, new_links_from, newest_mark, page_cut, select_days
from feedline.session import new_scratch
from feedline.sources import listings
from feedline.sources.marks import commit_checkpoint, load_checkpoint

STYLES: dict[str, dict] = {
    "paged_html": {"reader": "html", "wanted": "prefix", "cut": True, "date": "first", "date_on": "link"},
    "paged_json": {"reader": "json", "wanted": "prefix", "folder": "file/d/", "date": "first", "date_on": "last"},
    "signed_html": {
        "reader": "html", "wanted": "category", "keep_last": ("category", "page", "pos"), "date": "first", "date_on": "name",
    },
    "table_html": {"reader": "table", "wanted": None, "date": "first", "date_on": "last"},
    "day_pages": {"reader": "days", "wanted": None, "date": "anchored", "date_on": "name"},
    "catalog_json": {
        "reader": "catalog", "wanted": "entry", "folder": "", "keep_first": ("chain", "pos"),
        "date": "tolerant", "date_on": "name", "normalize": True,
    },
}


def _wanted(kind: str | None) -> Column:
    if kind is None:
        return F.lit(True)
    if kind == "prefix":
        return filters.has_prefix(file_name(F.col("href"), fallback=None))
    if kind == "entry":
        return filters.wanted_entry(F.col("fname"), F.col("file_type"))
    if kind == "category":
        return filters.full_snapshot(F.col("category"))
    raise ValueError(f"unknown filter {kind!r}")


def _dated(rows: DataFrame, style: dict) -> DataFrame:
    link = F.col("href")
    read = {
        "link": link,
        "last": F.substring_index(link, "/", -1),
        "name": file_name(link, fallback=None),
    }[style["date_on"]]
    return rows.withColumn("file_date", file_date(read, style["date"]))


def prepare_listing(listing: DataFrame, style: dict) -> DataFrame:
    """The wanted rows of a listing with their ``file_date``."""
    return _dated(listing.where(_wanted(style["wanted"])), style)


def quoted(name: Column) -> Column:
    """A file name as part of a URL: all but letters, digits and ``_.-~/`` by their bytes."""
    form = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(F.replace(form, F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def read_listing(
    captures: DataFrame,
    style: dict,
    marks: DataFrame,
    root: str,
    *,
    day_pages: DataFrame | None = None,
    host: str | None = None,
    suffixes: tuple[str, ...] | None = (".gz",),
    cap: int | None = None,
    max_days: int | None = None,
) -> DataFrame:
    """The wanted rows of a style's captures: at least ``source``, ``href`` and ``file_date``.

    ``captures`` has ``source`` and, by reader: ``body`` (``json``); ``chain`` and
    ``body``, rejected chains left out before (``catalog``); ``page``, ``category`` if
    the style asks for it, ``url`` and ``html`` (``html``, ``table``); ``url`` and
    ``html`` of the index, with ``day_pages`` as ``url, html`` (``days``).  ``host``
    keeps the links to one host.
    """
    reader = style["reader"]
    kept = tuple(c for c in ("source", "category", "page", "chain") if c in captures.columns)
    if reader == "json":
        rows = listings.read_json_listing(captures, "body", keep=kept).where(filters.is_file(F.col("row_type")))
        rows = rows.where(F.col("fname") != "").withColumn("href", F.concat(F.lit(root + style["folder"]), "fname"))
    elif reader == "catalog":
        rows = listings.read_catalog_entries(captures, "body", keep=kept).where(F.col("fname") != "")
        rows = rows.withColumn("href", F.concat(F.lit(root + style["folder"]), quoted(F.col("fname"))))
    elif reader == "html":
        found = links.extract_links(captures, "html", F.col("url"), suffixes, keep=kept)
        rows = found.withColumn("href", F.col("link")).drop("link")
    elif reader == "table":
        found = links.table_links(captures, "html", F.col("url"), keep=kept)
        rows = found.withColumn("href", F.col("link")).drop("link")
    elif reader == "days":
        found = links.extract_links(captures, "html", F.col("url"), keep=kept)
        days = found.select("source", day_date(file_name(F.col("link"))).alias("day"), "link")
        chosen = select_days(days, marks, max_days)
        found = expand_days(chosen, day_pages, suffixes)
        rows = found.select("source", "day", "pos", F.col("link").alias("href"))
    else:
        raise ValueError(f"unknown reader {reader!r}")
    if host is not None:
        rows = rows.where(filters.on_host(F.col("href"), host))
    rows = rows.where(_wanted(style["wanted"]))
    # The date is that of the link, so it is read after the copies of a link are gone.
    named = rows.withColumn("_name", file_name(F.col("href"), fallback=None))
    if "keep_first" in style:
        rows = dedup_first(named, ["source", "_name"], list(style["keep_first"])).drop("_name")
    if "keep_last" in style:
        rows = dedup_last(named, ["source", "_name"], list(style["keep_last"])).drop("_name")
    rows = _dated(rows, style)
    return page_cut(rows, marks, cap) if style.get("cut") else rows


def run_style(
    captures: DataFrame,
    style: dict,
    mark_path: str,
    out_path: str,
    batch_id: str,
    root: str = "",
    *,
    start: str | None = None,
    **options,
) -> DataFrame:
    """One cycle of a publisher from its captures to the stored marks; returns the new links.

    ``start`` is the first day for sources without a mark; ``options`` are those of
    :func:`read_listing`.  What is stored when is as in :func:`run_cycle`.
    """
    marks = load_checkpoint(captures.sparkSession, mark_path)
    if style.get("normalize"):
        marks = marks.select("source", normalize_mark(F.col("mark")).alias("mark"))
    listing = read_listing(captures, style, marks, root, **options)
    return _store(new_links_from(listing, marks, start) if start else new_links(listing, marks), mark_path, out_path, batch_id)


def run_cycle(listing: DataFrame, style: dict, mark_path: str, out_path: str, batch_id: str) -> DataFrame:
    """Write the new links below ``batch_id``, then save the marks; returns the new links.

    The listing is computed once, into a scratch table.  The marks come from
    that stored batch: a new link is dated after its source's mark, so the
    newest stored date is the newest listed one, and no mark passes a link that
    was not stored.  They move only after the links are stored, so a failed run
    is redone whole, and the redone run replaces its own batch.  Without a new
    link the batch stays as it is and no mark moves.  Each cycle takes a fresh
    batch id.
    """
    marks = load_checkpoint(listing.sparkSession, mark_path)
    return _store(new_links(prepare_listing(listing, style), marks), mark_path, out_path, batch_id)


def _store(fresh: DataFrame, mark_path: str, out_path: str, batch_id: str) -> DataFrame:
    spark = fresh.sparkSession
    scratch = new_scratch(spark, "cycle")
    fresh.write.parquet(scratch)
    batch = spark.read.schema(fresh.schema).parquet(scratch)
    if batch.isEmpty():
        return batch
    target = f"{out_path.rstrip('/')}/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(target)
    commit_checkpoint(newest_mark(batch), mark_path)
    return spark.read.schema(fresh.schema).parquet(target)
