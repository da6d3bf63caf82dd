"""Links out of HTML listings.

A page is taken apart inside its own row, so none of this shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedline.functions import markup
from feedline.functions.urls import has_suffix, resolve_url
from feedline.operators.prices import exploded


def extract_links(
    pages: DataFrame,
    html: str = "html",
    base: Column | None = None,
    suffixes: tuple[str, ...] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per anchor link in document order, copies kept.

    Rows: the ``keep`` columns, ``pos`` in the page, ``href`` as written and
    ``link`` resolved against ``base``.  ``suffixes`` keeps file-like links.
    """
    based = pages.select(
        *keep,
        (F.lit(None).cast("string") if base is None else base).alias("_base"),
        markup.hrefs(F.col(html)).alias("_hrefs"),
    )
    found = exploded(based.select(*keep, "_base", "_hrefs"), "_hrefs", "href")
    links = found.select(
        *keep, "pos", "href", resolve_url(F.col("href"), F.col("_base")).alias("link")
    )
    return links.where(has_suffix(F.col("link"), suffixes)) if suffixes else links


def table_links(
    pages: DataFrame,
    html: str = "html",
    base: Column | None = None,
    table_class: str = "gzTable",
    min_cells: int = 6,
    link_cell: int = 6,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per table row that has enough cells and a link in its link cell.

    The rows are those of the body of every element of class ``table_class``.
    """
    whole = F.lit(0)
    tables = F.filter(
        F.regexp_extract_all(
            markup.visible(F.col(html)), F.lit(r"(?is)<table\b[^>]*>(?:[^<]+|<(?!/table\s*>))*+</table\s*>"), whole
        ),
        lambda t: F.array_contains(
            markup.class_tokens(F.regexp_extract(t, r"(?is)^<table\b[^>]*>", 0)), table_class
        ),
    )

    def inner(part: Column, tag: str) -> Column:
        return F.regexp_extract_all(part, F.lit(rf"(?is)<{tag}\b[^>]*>((?:[^<]+|<(?!/{tag}\s*>))*+)</{tag}\s*>"), F.lit(1))

    bodies = F.flatten(F.transform(tables, lambda t: inner(t, "tbody")))
    rows = F.flatten(F.transform(bodies, lambda b: inner(b, "tr")))
    # Step by step, since a value that is used twice would be computed twice.
    cells = F.transform(rows, lambda r: inner(r, "td"))
    linked = F.transform(cells, lambda c: F.when(F.size(c) >= min_cells, F.get(c, F.lit(link_cell - 1))))
    # Only the first anchor of the cell counts, whether or not it has a link.
    anchors = F.transform(linked, lambda cell: F.regexp_extract(cell, r"(?is)<a\b[^>]*>", 0))
    hrefs = F.transform(anchors, lambda anchor: F.get(markup.attribute_values(anchor, "href"), F.lit(0)))
    based = pages.select(
        *keep, (F.lit(None).cast("string") if base is None else base).alias("_base"), hrefs.alias("_hrefs")
    )
    return exploded(based, "_hrefs", "href").where(F.col("href") != "").select(
        *keep, "pos", "href", resolve_url(F.col("href"), F.col("_base")).alias("link")
    )
