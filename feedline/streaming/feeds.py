"""Structured Streaming over feed files and messages.

The parsers and decoders are stateless, so the batch functions run on streams
unchanged; this module adds the pickup, the idempotent loader and the cadence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from feedline.functions.enrich import text_hash
from feedline.operators.dedup import dedup_last
from feedline.operators.prices import parse_prices, price_outcomes
from feedline.operators.promotions import parse_promotions, promotion_outcomes
from feedline.sources import versions
from feedline.sources.raw import documents, stream_raw

EVERY = "6 hours"
# Runs of one level that become one of the next.
FANOUT = 8


def stream_prices(spark: SparkSession, path: str, glob: str | None = None, **options) -> DataFrame:
    """Price records of every new file below ``path``."""
    return parse_prices(stream_raw(spark, path, glob, text=True, **options), keep=("path",))


def stream_promotions(spark: SparkSession, path: str, glob: str | None = None, **options) -> DataFrame:
    """Promotion records of every new file below ``path``."""
    return parse_promotions(stream_raw(spark, path, glob, text=True, **options), keep=("path",))


def price_stream_outcomes(spark: SparkSession, path: str, glob: str | None = None, **options) -> DataFrame:
    """Price records of every new file, and a row with its ``reason`` for each that cannot be loaded."""
    return price_outcomes(_readable(stream_raw(spark, path, glob, **options)), keep=("path", "error"))


def promotion_stream_outcomes(spark: SparkSession, path: str, glob: str | None = None, **options) -> DataFrame:
    """Promotion records of every new file, and a row with its ``reason`` for each that cannot be loaded."""
    return promotion_outcomes(_readable(stream_raw(spark, path, glob, **options)), keep=("path", "error"))


def _readable(raw: DataFrame) -> DataFrame:
    return documents(raw, ("path",))


def stream_messages(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """JSON messages, one a line in a column ``value``.

    A message broker differs only in the source's format and options.
    """
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def once(writer: DataStreamWriter) -> StreamingQuery:
    """Process all that is there, then stop; what an outside scheduler calls."""
    return writer.trigger(availableNow=True).start()


def every(writer: DataStreamWriter, interval: str = EVERY) -> StreamingQuery:
    """Run now and then at every interval."""
    return writer.trigger(processingTime=interval).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def append_log(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch into a folder of its own.

    The stream's offsets are committed after it returns, so a crash in
    between delivers the batch again under the same number, and the rewrite
    replaces only that batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        dedup_last(batch, keys, order).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def routed_log(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for rows with a ``reason``: what was read and what was rejected, side by side.

    Each micro-batch is one write of one folder, from one parse: its rows (``reason``
    null, the newest of each key) and its rejects lie in two parts of it.  So both are
    there or neither, and a batch that is delivered again replaces both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rejected = F.col("reason").isNotNull()
        # A reject is a row of its own: it has no key to be newest of.
        own = F.when(rejected, F.xxhash64(*[F.col(c).cast("string") for c in batch.columns if c != "reason"]))
        told = batch.select("*", rejected.cast("int").alias("rejected"), own.alias("_own"))
        kept = dedup_last(told, ["rejected", "_own", *keys], order).drop("_own")
        kept.write.mode("overwrite").partitionBy("rejected").parquet(batch_folder(path, batch_id))

    return write


def route_stream(
    outcomes: DataFrame, path: str, state: str, keys: list[str], order: list[str]
) -> DataStreamWriter:
    """Idempotent loader of rows and rejects into the log at ``path``."""
    return outcomes.writeStream.foreachBatch(routed_log(path, keys, order)).option("checkpointLocation", state)


def routed_rows(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """One current row per key over the rows of a routed log."""
    rows = spark.read.parquet(path).where("rejected = 0").drop("rejected", "reason", "batch_id")
    return dedup_last(rows, keys, order)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rejects of a routed log, with their ``reason`` and ``batch_id``."""
    return spark.read.parquet(path).where("rejected = 1").drop("rejected")


def load_stream(
    rows: DataFrame, path: str, state: str, keys: list[str], order: list[str]
) -> DataStreamWriter:
    """Idempotent loader of a stream into the append log at ``path``."""
    return rows.writeStream.foreachBatch(append_log(path, keys, order)).option("checkpointLocation", state)


def logged_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches in the log; those still being written have none."""
    found = []
    for name in versions.children(spark, path):
        number = name.removeprefix("batch_id=")
        if number.isdigit() and "_SUCCESS" in versions.children(spark, batch_folder(path, int(number))):
            found.append(int(number))
    return sorted(found)


def _batches(spark: SparkSession, path: str, numbers: list[int], schema) -> DataFrame:
    folders = [batch_folder(path, n) for n in numbers]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _runs(content: dict | None) -> tuple[list[dict], int]:
    """The runs of a version, oldest first, and the last batch they cover."""
    runs = content["runs"] if content else []
    return runs, max((r["last"] for r in runs), default=-1)


def current_view(
    spark: SparkSession, path: str, keys: list[str], order: list[str], runs: str | None = None
) -> DataFrame:
    """One current row per key over the log.

    With ``runs``, the folder that :func:`compact` writes, its runs stand for the
    batches they cover, and only the later batches of the log are read.
    """
    content = versions.newest(spark, runs)[1] if runs else None
    if content is None:
        return dedup_last(spark.read.parquet(path).drop("batch_id"), keys, order)
    held, upto = _runs(content)
    schema = StructType.fromJson(content["schema"])
    later = [n for n in logged_batches(spark, path) if n > upto]
    compacted = spark.read.schema(schema).parquet(*[r["folder"] for r in held])
    return dedup_last(compacted.unionByName(_batches(spark, path, later, schema)), keys, order)


def compact(
    spark: SparkSession, path: str, runs: str, keys: list[str], order: list[str], fanout: int = FANOUT
) -> int:
    """Bring the batches logged since the last call into a run; returns the last batch that is covered.

    Only those batches are read.  ``fanout`` runs of one level become one of the
    next, so a row is rewritten once for each level, not with every call.  The new
    list of runs is committed as one version; the log stays as it is until
    :func:`retire`, so a reader is never without one of the two.
    """

    def merged(rows: DataFrame) -> str:
        folder = versions.new_folder(runs, "runs")
        dedup_last(rows, keys, order).write.parquet(folder)
        return folder

    def step(content: dict | None) -> dict | None:
        held, upto = _runs(content)
        later = [n for n in logged_batches(spark, path) if n > upto]
        if not later:
            return None
        stated = content["schema"] if content else spark.read.parquet(batch_folder(path, later[0])).schema.jsonValue()
        schema = StructType.fromJson(stated)
        rows = merged(_batches(spark, path, later, schema))
        held = [*held, {"level": 1, "first": later[0], "last": later[-1], "folder": rows}]
        level = 1
        while len(same := [r for r in held if r["level"] == level]) >= fanout:
            rows = merged(spark.read.schema(schema).parquet(*[r["folder"] for r in same]))
            run = {"level": level + 1, "first": same[0]["first"], "last": same[-1]["last"], "folder": rows}
            held = [r for r in held if r["level"] > level] + [run]
            level += 1
        return {"schema": stated, "runs": held}

    versions.update(spark, runs, step)
    return _runs(versions.newest(spark, runs)[1])[1]


def retire(spark: SparkSession, path: str, runs: str, grace: float) -> list[int]:
    """Delete the logged batches that runs have covered for ``grace`` seconds; returns their numbers.

    A reader that listed the log before a compaction has that long to finish.
    """
    covered = versions.covered_since(spark, runs, grace)
    _, upto = _runs(covered)
    gone = [n for n in logged_batches(spark, path) if n <= upto]
    for n in gone:
        versions.remove(spark, batch_folder(path, n))
    return gone


def drop_redelivered(
    messages: DataFrame, time: str, within: str, text: str | None = None, key: str = "quote_hash"
) -> DataFrame:
    """Each message once, as long as its copies come within ``within``.

    State is kept per key for that long only.
    """
    keyed = messages if text is None else messages.withColumn(key, text_hash(F.col(text)))
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
