"""Streams: pickup, redelivery and replay."""

import gzip
import time

from pyspark.sql import functions as F

from feedline.operators.load import message_outcomes
from feedline.operators.prices import price_outcomes
from feedline.streaming import feeds

ITEM = "<Root><StoreId>{0}</StoreId><Items><Item><ItemCode>{1}</ItemCode></Item></Items></Root>"


def test_new_files_only(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for run in range(3):
        (tmp_path / "in" / f"f{run}.gz").write_text(ITEM.format(run, run))
        writer = feeds.stream_prices(spark, inbox).writeStream.format("parquet").option("path", out)
        feeds.once(writer.option("checkpointLocation", state)).awaitTermination()
        assert spark.read.parquet(out).count() == run + 1


def test_promotion_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.gz").write_text("<r><Promotion><PromotionID>1</PromotionID></Promotion></r>")
    out = str(tmp_path / "out")
    writer = feeds.stream_promotions(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", out)
    feeds.once(writer.option("checkpointLocation", str(tmp_path / "state"))).awaitTermination()
    assert [r.promotionId for r in spark.read.parquet(out).collect()] == ["1"]


def test_replayed_batch_replaces_itself(spark, plan, tmp_path):
    log = str(tmp_path / "log")
    write = feeds.append_log(log, ["k"], ["at"])
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k STRING, at INT")
    second = spark.createDataFrame([("b", 3)], "k STRING, at INT")
    write(first, 0)
    write(second, 1)
    before = sorted(map(tuple, feeds.current_view(spark, log, ["k"], ["at"]).collect()))
    write(first, 0)
    write(second, 1)
    after = sorted(map(tuple, feeds.current_view(spark, log, ["k"], ["at"]).collect()))
    assert before == after == [("a", 2), ("b", 3)]
    assert spark.read.parquet(log).count() == 3


def test_compaction_reads_later_batches_only(spark, tmp_path):
    log, runs = str(tmp_path / "log"), str(tmp_path / "runs")
    write = feeds.append_log(log, ["k"], ["at"])
    for n in range(5):
        write(spark.createDataFrame([(f"k{n % 3}", n), ("all", n)], "k STRING, at INT"), n)
        assert feeds.compact(spark, log, runs, ["k"], ["at"], fanout=2) == n
        # What is covered is not read again: the next calls work without it.
        for f in (tmp_path / "log" / f"batch_id={n}").glob("*.parquet"):
            f.write_bytes(b"no parquet")
    assert feeds.compact(spark, log, runs, ["k"], ["at"], fanout=2) == 4
    content = feeds.versions.newest(spark, runs)[1]
    assert [(r["level"], r["first"], r["last"]) for r in content["runs"]] == [(3, 0, 3), (1, 4, 4)]
    write(spark.createDataFrame([("k1", 9), ("k2", 1)], "k STRING, at INT"), 5)
    view = feeds.current_view(spark, log, ["k"], ["at"], runs)
    assert sorted(map(tuple, view.collect())) == [("all", 4), ("k0", 3), ("k1", 9), ("k2", 2)]
    assert not any("batch_id=4" in f for f in view.inputFiles())


def test_covered_batches_are_retired_after_a_grace(spark, tmp_path):
    log, runs = str(tmp_path / "log"), str(tmp_path / "runs")
    write = feeds.append_log(log, ["k"], ["at"])
    assert feeds.retire(spark, log, runs, 0) == []
    for n in range(3):
        write(spark.createDataFrame([("a", n)], "k STRING, at INT"), n)
    feeds.compact(spark, log, runs, ["k"], ["at"])
    write(spark.createDataFrame([("b", 1)], "k STRING, at INT"), 3)
    (tmp_path / "log" / "batch_id=4").mkdir()  # still being written
    assert feeds.retire(spark, log, runs, 3600) == []
    assert feeds.retire(spark, log, runs, 0) == [0, 1, 2]
    view = feeds.current_view(spark, log, ["k"], ["at"], runs)
    assert sorted(map(tuple, view.collect())) == [("a", 2), ("b", 1)]


def test_rows_and_rejects_of_a_stream(spark, tmp_path):
    inbox, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_text(ITEM.format(1, 1))
    (tmp_path / "in" / "b.gz").write_bytes(gzip.compress(ITEM.format(2, 2).encode() * 9)[:40])
    (tmp_path / "in" / "c.gz").write_text(ITEM.format(3, 3)[:-3])
    (tmp_path / "in" / "d.gz").write_bytes(b"\xff\xfa\xff")
    keys = ["storeId", "itemCode"]
    outcomes = feeds.price_stream_outcomes(spark, inbox)
    feeds.once(feeds.route_stream(outcomes, log, state, keys, ["updateTime"])).awaitTermination()

    def stored():
        rows = [r.itemCode for r in feeds.routed_rows(spark, log, keys, ["updateTime"]).collect()]
        bad = {(r.path[-4:], r.reason, (r.error or "").split(":")[0], r.batch_id) for r in feeds.rejects(spark, log).collect()}
        return rows, bad

    want = (["1"], {("b.gz", "no text", "gzip", 0), ("c.gz", "not well-formed", "", 0), ("d.gz", "no text", "charset", 0)})
    assert stored() == want
    # A replay replaces both sides of its batch.
    batch = spark.read.format("binaryFile").load(inbox)
    again = price_outcomes(feeds._readable(batch), keep=("path", "error"))
    feeds.routed_log(log, keys, ["updateTime"])(again, 0)
    assert stored() == want


def test_message_outcomes(spark):
    rows = [('{"k": "a", "n": 1}',), ('{"k": "", "n": 2}',), ("{oops",), (None,), ('{"n": 3}',), ("[]",)]
    found = message_outcomes(spark.createDataFrame(rows, "value STRING"), "k STRING, n INT", ["k"]).collect()
    assert [(r.k, r.n, r.reason) for r in found if r.reason is None] == [("a", 1, None)]
    assert {(r.message, r.reason) for r in found if r.reason} == {
        ('{"k": "", "n": 2}', "no k"), ("{oops", "no JSON object"), (None, "no JSON object"), ('{"n": 3}', "no k"), ("[]", "no JSON object"),
    }
    assert all(r.k is None and r.n is None for r in found if r.reason)


def test_redelivery_makes_no_row(spark, tmp_path):
    inbox, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    messages = spark.range(50).select(F.to_json(F.struct("id")).alias("value"))
    counts = []
    for _ in range(2):
        messages.write.mode("append").text(inbox)
        rows = feeds.stream_messages(spark, inbox).select(F.from_json("value", "id BIGINT").alias("m")).select("m.*")
        feeds.once(feeds.load_stream(rows, log, state, ["id"], [])).awaitTermination()
        counts.append(feeds.current_view(spark, log, ["id"], []).count())
    assert counts == [50, 50]


def test_periodic_run_starts_at_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m").write_text("one\n")
    out = str(tmp_path / "out")
    writer = feeds.stream_messages(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", out)
    running = feeds.every(writer.option("checkpointLocation", str(tmp_path / "state")))
    try:
        # The next trigger is hours away, so only look for the first one.
        deadline = time.monotonic() + 60
        while not running.recentProgress and time.monotonic() < deadline:
            time.sleep(0.2)
        assert spark.read.parquet(out).count() == 1
    finally:
        running.stop()
