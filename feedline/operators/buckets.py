"""A stored table of one current row per key, in hash buckets of the key.

A version (:mod:`feedline.sources.versions`) says for every bucket in which folder it
lies.  A batch reads and rewrites the buckets its keys fall into and no other; the
rest of the new version points to the folders of the old one.  Readers see a whole
version or the one before.  The number of buckets is fixed when the table is made:
take so many that one bucket is some 100 MB.

A column that decides the bucket alone (``within``, part of the key) lets a reader
that knows its values read their buckets only.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedline.operators.load import upsert
from feedline.session import new_scratch
from feedline.sources import versions

BUCKETS = 64
BUCKET = "_bucket"
# Stored bytes of table and batch that are merged, and so shuffled, at once; a larger bucket is merged alone.
GROUP_BYTES = 512 << 20


def bucket_of(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def folders(content: dict, wanted: list[int] | None = None) -> list[str]:
    """The bucket folders of a version, or those of some buckets only."""
    chosen = content["folders"].items()
    return [f"{folder}/{BUCKET}={b}" for b, folder in chosen if wanted is None or int(b) in wanted]


def schema_of(content: dict) -> StructType:
    return StructType.fromJson(content["schema"])


def _read(spark: SparkSession, content: dict, wanted: list[int] | None = None) -> DataFrame:
    paths = folders(content, wanted)
    if not paths:
        return spark.createDataFrame([], schema_of(content))
    return spark.read.schema(schema_of(content)).parquet(*paths)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    _, content = versions.newest(spark, path)
    if content is None:
        raise ValueError(f"no table at {path}")
    return _read(spark, content)


def read_keys(spark: SparkSession, path: str, values: list) -> DataFrame:
    """The rows of the buckets that some values of the ``within`` column fall into; none where there is no table."""
    _, content = versions.newest(spark, path)
    if content is None:
        raise ValueError(f"no table at {path}")
    (column,) = content["within"]
    kind = schema_of(content)[column].dataType
    named = spark.createDataFrame([(v,) for v in values], f"{column} {kind.simpleString()}")
    wanted = {r[0] for r in named.select(bucket_of([column], content["buckets"])).collect()}
    return _read(spark, content, sorted(wanted)).where(F.col(column).isin(*values))


def merge(
    batch: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    *,
    buckets: int = BUCKETS,
    within: list[str] | None = None,
) -> int:
    """Upsert a batch into the table at ``path``, made where there is none; returns the version.

    The newest row of a key by ``order`` wins; a batch without rows commits nothing,
    and one merged again changes no row.  ``buckets`` and ``within`` count for a new
    table only.  Columns the table does not have are an error, those the batch lacks
    are null.
    """
    spark = batch.sparkSession
    scratch = new_scratch(spark, "batch")
    _, there = versions.newest(spark, path)
    dealt = (there["within"], there["buckets"]) if there else (within or keys, buckets)
    # Written once: it says which buckets are touched, and a retry on conflict needs the same rows.
    batch.withColumn(BUCKET, bucket_of(*dealt)).write.partitionBy(BUCKET).parquet(scratch)
    _free_shuffles(spark)

    def arrived(wanted: list[int]) -> DataFrame:
        return spark.read.schema(batch.schema).parquet(*[f"{scratch}/{BUCKET}={b}" for b in wanted])

    def step(content: dict | None) -> dict | None:
        known = content or {"keys": keys, "within": within or keys, "buckets": buckets, "folders": {}}
        if known["keys"] != list(keys):
            raise ValueError(f"the table is keyed by {known['keys']}")
        extra = [c for c in batch.columns if content and c not in schema_of(content).names]
        if extra:
            raise ValueError(f"the table has no columns {extra}")
        written = sorted(int(n.split("=")[1]) for n in versions.children(spark, scratch) if n.startswith(f"{BUCKET}="))
        if not written:
            return None
        place, touched = bucket_of(known["within"], known["buckets"]), written
        same = dealt == (known["within"], known["buckets"])
        if not same:
            # Another writer made the table meanwhile, with buckets of its own.
            touched = sorted(r["b"] for r in arrived(written).select(place.alias("b")).distinct().collect())
        target = versions.new_folder(path)
        for group in _groups(spark, known, touched, scratch if same else None):
            held = arrived(group) if same else arrived(written).where(place.isin(group))
            merged = _read(spark, content, group).unionByName(held, allowMissingColumns=True) if content else held
            rows = upsert(merged, merged.limit(0), keys, order).withColumn(BUCKET, place)
            if len(group) > 1:
                # Each task would write a file for every bucket: AQE joins small buckets and splits large ones.
                rows = rows.hint("rebalance", BUCKET)
            rows.write.mode("append").partitionBy(BUCKET).parquet(target)
            _free_shuffles(spark)
        schema = content["schema"] if content else batch.schema.jsonValue()
        return {**known, "schema": schema, "folders": {**known["folders"], **{str(b): target for b in touched}}}

    try:
        return versions.update(spark, path, step)
    finally:
        versions.remove(spark, scratch)


def _groups(spark: SparkSession, known: dict, touched: list[int], scratch: str | None) -> list[list[int]]:
    """The touched buckets in groups of about ``GROUP_BYTES``, at least one each; the batch's bytes by bucket below ``scratch``."""
    groups: list[list[int]] = []
    left = 0
    for b in touched:
        folder = known["folders"].get(str(b))
        size = versions.size(spark, f"{folder}/{BUCKET}={b}") if folder else 0
        size += versions.size(spark, f"{scratch}/{BUCKET}={b}") if scratch else 0
        if not groups or size > left:
            groups.append([])
            left = GROUP_BYTES
        groups[-1].append(b)
        left -= size
    return groups


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is done: it does once the driver's JVM has collected their plans."""
    gc.collect()
    spark._jvm.System.gc()


def sweep(spark: SparkSession, path: str, grace: float) -> list[str]:
    """Delete the data folders that no version of the last ``grace`` seconds, nor the one before, names; returns them.

    Merges that take longer than ``grace`` must not run meanwhile: what they wrote is not named yet.
    """
    base = path.rstrip("/")
    named = {f for content in versions.since(spark, path, grace) for f in content["folders"].values()}
    gone = [f for name in versions.children(spark, f"{base}/data") if (f := f"{base}/data/{name}") not in named]
    for folder in gone:
        versions.remove(spark, folder)
    return gone
