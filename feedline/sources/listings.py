"""JSON listing responses and CSV price files as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.functions.text import first_text, strip
from feedline.operators.prices import PRICE_FIELDS, price_columns

# Members stay raw text first, so that an odd one cannot empty the response.
PAGED_SCHEMA = "aaData ARRAY<STRING>, iTotalRecords STRING"
ENTRY_SCHEMA = "type STRING, fname STRING"

# Where a catalog response may hold its list.
WRAPPERS = ("files", "data", "items", "result")


def _paged_members(responses: DataFrame, col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``pos``, the raw ``member`` and the ``entry`` it is, null where it is no object."""
    parsed = responses.select(*keep, F.from_json(col, PAGED_SCHEMA).alias("r"))
    members = parsed.select(*keep, F.posexplode("r.aaData").alias("pos", "member"))
    entry = F.when(F.ltrim("member").startswith("{"), F.from_json("member", ENTRY_SCHEMA))
    return members.select(*keep, "pos", "member", entry.alias("entry"))


def read_json_listing(responses: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per entry of the offset-paged responses in ``col``.

    Rows: the ``keep`` columns, ``pos`` in the response, ``row_type``,
    ``fname``.  A response without ``aaData`` gives none.  Members that are no
    objects are left out and are in :func:`odd_members`.
    """
    entries = _paged_members(responses, col, keep).where(F.col("entry").isNotNull())
    return entries.select(*keep, "pos", F.col("entry.type").alias("row_type"), F.col("entry.fname").alias("fname"))


def odd_members(responses: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The members of offset-paged responses that are no objects: ``keep``, ``pos`` and ``member`` as text."""
    return _paged_members(responses, col, keep).where(F.col("entry").isNull()).select(*keep, "pos", "member")


def listing_totals(responses: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per response: entries delivered and the total it reports."""
    parsed = responses.select(*keep, F.from_json(col, PAGED_SCHEMA).alias("r"))
    return parsed.select(
        *keep,
        F.coalesce(F.size("r.aaData"), F.lit(0)).cast("bigint").alias("n_rows"),
        # A total that is missing is 0; one that is no number is null, and its listing not complete.
        F.when(F.col("r.iTotalRecords").isNull(), F.lit(0))
        .otherwise(F.trim("r.iTotalRecords").try_cast("bigint"))
        .cast("bigint")
        .alias("reported"),
    )


def read_catalog_entries(responses: DataFrame, col: str, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """One row per entry of a catalog response, bare list or wrapped.

    Elements that are not objects are dropped.  A response that is neither a
    list nor an object with a list under a known key gives no entry and is in
    ``odd_catalogs``; with ``strict`` it raises.
    """
    members = _members(responses, col, keep)
    if strict:
        odd = F.raise_error(F.lit("unexpected catalog response")).cast("array<string>")
        members = members.withColumn("_members", F.coalesce("_members", odd))
    # Outer and filtered afterwards, and the fields generated from a one-element array: else the
    # optimizer reads the list once more to see whether it is empty, and a member once more for each filter on it.
    entries = members.select(*keep, F.posexplode_outer("_members").alias("pos", "member"))
    fields = F.struct(
        strip(F.get_json_object("member", "$.fileName")).alias("fname"),
        F.get_json_object("member", "$.fileType").alias("file_type"),
    )
    found = entries.where(F.ltrim("member").startswith("{")).select(*keep, "pos", F.explode_outer(F.array(fields)).alias("_entry"))
    return found.select(*keep, "pos", "_entry.fname", "_entry.file_type")


def odd_catalogs(responses: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The responses that hold no list of entries: ``keep`` and the response."""
    return _members(responses, col, (*keep, col)).where(F.col("_members").isNull()).select(*keep, col)


def _members(responses: DataFrame, col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``_members``, the raw entries of each response; null where it has no list."""
    text = F.ltrim(F.col(col))
    # Elements stay raw text first, so one odd member cannot null the list.
    bare = F.when(text.startswith("["), F.from_json(col, "ARRAY<STRING>"))
    wrapped = F.from_json(col, "STRUCT<" + ", ".join(f"{w}: STRING" for w in WRAPPERS) + ">")
    listed = responses.select(*keep, bare.alias("_bare"), wrapped.alias("_wrapped"))

    def as_list(name: str):
        held = F.col(f"_wrapped.{name}")
        return F.when(F.ltrim(held).startswith("["), F.from_json(held, "ARRAY<STRING>"))

    return listed.select(*keep, F.coalesce("_bare", *[as_list(w) for w in WRAPPERS]).alias("_members"))


def _by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files below ``path`` by their header line; empty files have none.

    Only each file's first split counts.  The list is the one a reader's file
    listing holds as well: one entry for each file.
    """
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("n"), "_metadata.file_path", "_metadata.file_block_start"
    )
    starts = lines.where("file_block_start = 0 AND trim(value) <> ''")
    headers = starts.groupBy("file_path").agg(F.min_by("value", "n").alias("header"))
    found: dict[str, list[str]] = {}
    for row in headers.toLocalIterator():
        found.setdefault(row["header"].lstrip("\ufeff").rstrip("\r"), []).append(row["file_path"])
    return found


def read_prices_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Price records from CSV files whose headers are the feed's tag names.

    Everything is read as text, then goes through the same value rules as the
    XML feed.  Header names match in any case; ``ChainId`` and ``StoreId``
    are columns of the file.  Files of one header are read together, so a file
    with its columns in another order keeps them apart by name.
    """

    def texts(files: list[str] | str) -> DataFrame:
        rows = spark.read.options(header="true", inferSchema="false", **options).csv(files)
        have = {c.strip().lstrip("\ufeff").lower(): c for c in rows.columns}

        def leaf(*tags: str):
            found = [F.array(F.col(f"`{have[t.lower()]}`")) for t in tags if t.lower() in have]
            return first_text(*found) if found else F.lit(None).cast("string")

        return rows.select(
            leaf("ChainId").alias("superProvider"),
            leaf("StoreId").alias("storeId"),
            *[leaf(*tags).alias(name) for name, (tags, _) in PRICE_FIELDS.items()],
        )

    parts = [texts(files) for files in _by_header(spark, path).values()] or [texts(path)]
    joined = reduce(DataFrame.unionByName, parts)
    return joined.select("superProvider", "storeId", *price_columns())
