"""Queries of the streaming jobs, each run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedline.functions.enrich import text_hash
from feedline.operators import load
from feedline.plans import rendering as R
from feedline.plans.registry import query
from feedline.session import new_scratch
from feedline.streaming import feeds

SCHEMA = "event_id BIGINT, user_id BIGINT, event_type STRING, amount DOUBLE, ts STRING"
KEYS, ORDER = ["event_id"], ["ts"]


def _folders(spark, *labels):
    return [new_scratch(spark, label) for label in labels]


@query(
    "str_01_feed_stream",
    f"""
    SELECT CAST(p_partkey // {R.PARTS_PER_FILE} AS VARCHAR) AS "storeId", lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS "itemCode",
           p_name AS "itemName", p_retailprice AS price, '2024-01-01T00:00:0' || (p_size % 10) AS "updateTime"
    FROM part""",
)
def feed_stream(spark, sf_dir):
    inbox, out, state = _folders(spark, "inbox", "prices", "state")
    R.write_part_files(spark, sf_dir, inbox)
    rows = feeds.stream_prices(spark, inbox).select("storeId", "itemCode", "itemName", "price", "updateTime")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    feeds.once(writer).awaitTermination()
    return spark.read.parquet(out)


@query(
    "str_01_feed_rejects",
    f"""
    SELECT CAST(f AS VARCHAR) AS file, CASE WHEN f % 5 = 2 THEN 'not well-formed' END AS reason,
           CAST(CASE WHEN f % 5 = 2 THEN 0 ELSE n END AS BIGINT) AS n_items
    FROM (SELECT p_partkey // {R.PARTS_PER_FILE} AS f, count(*) AS n FROM part GROUP BY ALL)""",
)
def feed_rejects(spark, sf_dir):
    inbox, log, state = _folders(spark, "inbox", "log", "state")
    cut = F.when(F.col("file") % 5 == 2, F.expr("left(doc, length(doc) - 9)")).otherwise(F.col("doc"))
    R.write_part_files(spark, sf_dir, inbox, cut)
    # The second run finds every file picked up already.
    for _ in range(2):
        outcomes = feeds.price_stream_outcomes(spark, inbox)
        writer = feeds.route_stream(outcomes, log, state, ["storeId", "itemCode"], ["updateTime", "pos"])
        feeds.once(writer).awaitTermination()
    rows = feeds.routed_rows(spark, log, ["storeId", "itemCode"], ["updateTime", "pos"]).withColumn("reason", F.lit(None).cast("string"))
    both = rows.select("path", "reason", "itemCode").unionByName(feeds.rejects(spark, log).select("path", "reason", "itemCode"))
    file = F.regexp_extract("path", r"file=([0-9]+)/", 1).alias("file")
    return both.groupBy(file, "reason").agg(F.count("itemCode").alias("n_items"))


def _deliver(spark, sf_dir, inbox):
    """All messages, twice over."""
    messages = R.event_messages(spark, sf_dir)
    for _ in range(2):
        messages.select("value").write.mode("append").text(inbox)


def _decoded(spark, inbox):
    valid, _ = load.decode_messages(feeds.stream_messages(spark, inbox), SCHEMA, KEYS)
    return valid


@query(
    "str_02_idempotent_loader",
    "SELECT event_id, user_id, event_type, value AS amount FROM events WHERE event_id % 50 <> 49",
)
def idempotent_loader(spark, sf_dir):
    inbox, log, state = _folders(spark, "inbox", "log", "state")
    _deliver(spark, sf_dir, inbox)
    writer = feeds.load_stream(_decoded(spark, inbox), log, state, KEYS, ORDER)
    feeds.once(writer).awaitTermination()
    return feeds.current_view(spark, log, KEYS, ORDER).drop("ts")


@query(
    "str_02_compacted_log",
    "SELECT event_id, user_id, event_type, value AS amount FROM events WHERE event_id % 50 <> 49",
)
def compacted_log(spark, sf_dir):
    inbox, log, runs, state = _folders(spark, "inbox", "log", "runs", "state")
    messages = R.event_messages(spark, sf_dir)
    for part in (0, 1, 2, 1):
        messages.where(F.col("event_id") % 3 == part).select("value").write.mode("append").text(inbox)
        feeds.once(feeds.load_stream(_decoded(spark, inbox), log, state, KEYS, ORDER)).awaitTermination()
        # The last batch is not compacted: a reader takes it from the log.
        if part != 2:
            feeds.compact(spark, log, runs, KEYS, ORDER, fanout=2)
            feeds.retire(spark, log, runs, 0)
    return feeds.current_view(spark, log, KEYS, ORDER, runs).drop("ts")


@query(
    "str_02_routed_messages",
    """
    SELECT CAST(event_id AS VARCHAR) AS event, NULL AS reason, user_id FROM events WHERE event_id % 50 <> 49
    UNION ALL
    SELECT substr('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type"', 1, 20), 'no JSON object', NULL
    FROM events WHERE event_id % 50 = 49""",
)
def routed_messages(spark, sf_dir):
    inbox, log, state = _folders(spark, "inbox", "log", "state")
    _deliver(spark, sf_dir, inbox)
    outcomes = load.message_outcomes(feeds.stream_messages(spark, inbox), SCHEMA, KEYS)
    feeds.once(feeds.route_stream(outcomes, log, state, KEYS, ORDER)).awaitTermination()
    rows = feeds.routed_rows(spark, log, KEYS, ORDER)
    rows = rows.select(R.text("event_id").alias("event"), F.lit(None).cast("string").alias("reason"), "user_id")
    bad = feeds.rejects(spark, log).select(F.col("message").alias("event"), "reason", F.lit(None).cast("bigint").alias("user_id"))
    return rows.unionByName(bad)


@query(
    "str_03_drop_redelivered",
    "SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS quote_hash FROM events WHERE event_id % 50 <> 49",
)
def drop_redelivered(spark, sf_dir):
    inbox, out, state = _folders(spark, "inbox", "distinct", "state")
    _deliver(spark, sf_dir, inbox)
    timed = _decoded(spark, inbox).select(
        "event_id", text_hash(R.text("event_id")).alias("quote_hash"), F.to_timestamp("ts").alias("at")
    )
    kept = feeds.drop_redelivered(timed, "at", "60 days").select("event_id", "quote_hash")
    writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    feeds.once(writer).awaitTermination()
    return spark.read.parquet(out)


@query(
    "str_04_replay_counts",
    """
    WITH v AS (SELECT * FROM events WHERE event_id % 50 <> 49)
    SELECT run, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, max(event_id) AS last_id
    FROM v, (SELECT unnest([1, 2]) AS run) GROUP BY run""",
)
def replay_counts(spark, sf_dir):
    inbox, log, state = _folders(spark, "inbox", "log", "state")
    counted = None
    for run in (1, 2):
        # The second run delivers everything again.
        _deliver(spark, sf_dir, inbox)
        feeds.once(feeds.load_stream(_decoded(spark, inbox), log, state, KEYS, ORDER)).awaitTermination()
        view = feeds.current_view(spark, log, KEYS, ORDER)
        (snapshot,) = _folders(spark, "stats")
        stats = view.agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.max("event_id").alias("last_id")
        )
        stats.withColumn("run", F.lit(run)).write.parquet(snapshot)
        stored = spark.read.parquet(snapshot)
        counted = stored if counted is None else counted.union(stored)
    return counted


@query(
    "str_05_periodic_run",
    "SELECT event_type, count(*) AS n_rows FROM events WHERE event_id % 50 <> 49 GROUP BY event_type",
)
def periodic_run(spark, sf_dir):
    inbox, out, state = _folders(spark, "inbox", "rows", "state")
    messages = R.event_messages(spark, sf_dir)
    for half in (0, 1):
        messages.where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(inbox)
        rows = _decoded(spark, inbox)
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        # Each scheduled run takes only what came since the last one.
        feeds.once(writer).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
