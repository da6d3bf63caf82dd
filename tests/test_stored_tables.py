"""Versions, bucketed tables, marks and compaction on files."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedline.operators import buckets
from feedline.operators.dedup import dedup_last
from feedline.session import shared_folder
from feedline.sources import marks, versions

SCHEMA = "k STRING, at INT, v STRING"
KEYS, ORDER = ["k"], ["at"]


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stamps(path):
    return {str(f): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def state(spark, path):
    return sorted(tuple(r) for r in buckets.read_table(spark, path).collect())


def test_versions_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.newest(spark, path) == (0, None)
    assert versions.commit(spark, path, 1, {"a": "é"})
    assert not versions.commit(spark, path, 1, {"a": 2})
    assert versions.newest(spark, path) == (1, {"a": "é"})


def test_a_version_left_empty_counts_for_its_number_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "PATIENCE", 0.2)
    path = str(tmp_path / "v")
    versions.commit(spark, path, 1, {"a": 1})
    (tmp_path / "v" / "versions" / "0000000002").write_text("")
    assert versions.newest(spark, path) == (2, {"a": 1})
    assert versions.update(spark, path, lambda old: {"a": old["a"] + 1}) == 3
    assert versions.newest(spark, path) == (3, {"a": 2})


def test_concurrent_updates_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "v")

    def add(n):
        return versions.update(spark, path, lambda old: {"seen": [*(old or {"seen": []})["seen"], n]})

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(add, range(8)))
    assert sorted(numbers) == list(range(1, 9))
    assert sorted(versions.newest(spark, path)[1]["seen"]) == list(range(8))


def test_merge_leaves_other_buckets_alone(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    first = batch(spark, [(f"k{n}", n % 3, "old") for n in range(200)] + [("k1", 9, "newer"), ("k1", 8, "old")])
    assert buckets.merge(first, path, KEYS, ORDER, buckets=16) == 1
    before, files = state(spark, path), stamps(path)
    assert len(before) == 200 and ("k1", 9, "newer") in before
    _, content = versions.newest(spark, path)

    second = batch(spark, [("k5", 7, "new"), ("k1", 1, "late")])
    touched = {r[0] for r in second.select(buckets.bucket_of(KEYS, 16)).collect()}
    assert buckets.merge(second, path, KEYS, ORDER) == 2
    now = versions.newest(spark, path)[1]
    kept = {b: f for b, f in content["folders"].items() if int(b) not in touched}
    assert kept and all(now["folders"][b] == f for b, f in kept.items())
    # No file of the first version was rewritten, and the new ones hold the touched buckets only.
    after = stamps(path)
    assert all(after[f] == t for f, t in files.items())
    assert {int(Path(f).parent.name.split("=")[1]) for f in after.keys() - files.keys()} == touched
    want = sorted([r for r in before if r[0] != "k5"] + [("k5", 7, "new")])
    assert state(spark, path) == want

    # Other buckets cannot even be read: their files are gone, and the merge still works.
    for b, folder in kept.items():
        for f in Path(f"{folder}/_bucket={b}").rglob("*.parquet"):
            f.rename(tmp_path / f"gone-{f.name}")
    assert buckets.merge(batch(spark, [("k5", 8, "newest")]), path, KEYS, ORDER) == 3


def test_merging_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = batch(spark, [("a", 1, "x"), ("b", None, "y"), (None, 1, "z"), ("a", 1, "x")])
    buckets.merge(rows, path, KEYS, ORDER, buckets=4)
    before = buckets.read_table(spark, path).collect()
    buckets.merge(rows, path, KEYS, ORDER)
    assert sorted(map(str, before)) == sorted(map(str, buckets.read_table(spark, path).collect()))
    assert len(before) == 3
    assert buckets.merge(rows.limit(0), path, KEYS, ORDER) == 2


def test_merge_refuses_other_keys_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        buckets.read_table(spark, path)
    buckets.merge(batch(spark, [("a", 1, "x")]), path, KEYS, ORDER)
    with pytest.raises(ValueError):
        buckets.merge(batch(spark, [("a", 1, "x")]), path, ["k", "v"], ORDER)
    with pytest.raises(ValueError):
        buckets.merge(batch(spark, [("a", 1, "x")]).withColumn("w", F.lit(1)), path, KEYS, ORDER)
    buckets.merge(batch(spark, [("c", 1, "x")]).drop("v"), path, KEYS, ORDER)
    assert ("c", 1, None) in [tuple(r) for r in buckets.read_table(spark, path).collect()]


def test_concurrent_merges_keep_both(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.merge(batch(spark, [("a", 1, "x")]), path, KEYS, ORDER, buckets=2)
    parts = [batch(spark, [(f"p{n}", 1, "x"), ("a", n + 2, f"from {n}")]) for n in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda p: buckets.merge(p, path, KEYS, ORDER), parts))
    assert state(spark, path) == [("a", 4, "from 2"), ("p0", 1, "x"), ("p1", 1, "x"), ("p2", 1, "x")]


def test_sweep_keeps_what_versions_name(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(3):
        buckets.merge(batch(spark, [("a", n, "x"), ("b", n, "y")]), path, KEYS, ORDER, buckets=1)
    assert buckets.sweep(spark, path, grace=3600) == []
    assert len(buckets.sweep(spark, path, grace=0)) == 2
    assert buckets.sweep(spark, path, grace=0) == []
    assert len(state(spark, path)) == 2


def test_keys_are_read_from_their_buckets(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    rows = batch(spark, [(f"k{n}", 1, f"v{n % 7}") for n in range(100)])
    buckets.merge(rows, path, ["k", "v"], ORDER, buckets=32, within=["k"])
    found = buckets.read_keys(spark, path, ["k3", "k77", "none"])
    assert sorted(r["k"] for r in found.collect()) == ["k3", "k77"]
    assert len({Path(f).parent.name for f in found.inputFiles()}) <= 3
    whole = dedup_last(rows, ["k", "v"], ORDER)
    assert buckets.read_table(spark, path).count() == whole.count()


def test_cycles_side_by_side_keep_their_marks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "marks")
    marks.save_checkpoint(spark.createDataFrame([("a", "1"), ("b", "1")], marks.MARK_SCHEMA), path)
    real, late = versions.commit, []

    def overtaken(spark, path, number, content):
        # Another cycle that read the same version commits first.
        if not late:
            late.append(number)
            marks.commit_checkpoint(spark.createDataFrame([("b", "5"), ("c", "2")], marks.MARK_SCHEMA), path)
        return real(spark, path, number, content)

    monkeypatch.setattr(versions, "commit", overtaken)
    assert marks.commit_checkpoint(spark.createDataFrame([("a", "9"), ("b", None)], marks.MARK_SCHEMA), path) == 3
    assert dict(marks.load_checkpoint(spark, path).collect()) == {"a": "9", "b": "5", "c": "2"}
    assert late == [2]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "32KB")
        spark.conf.set(names[1], "false")
        batch = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(4)
        buckets.merge(batch, str(tmp_path / "t"), ["id"], ["v"], buckets=1)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) > 1
    assert buckets.read_table(spark, str(tmp_path / "t")).distinct().count() == 40_000


def test_a_merge_in_groups_leaves_no_files_behind(spark, tmp_path, monkeypatch):
    """Large buckets are merged group by group; what a merge wrote for itself is gone after it."""
    scratch = Path(shared_folder(spark)) / "feedline"
    before = set(scratch.glob("batch-*"))
    rows = batch(spark, [(f"k{n}", n % 5, f"v{n % 3}") for n in range(300)] + [(None, 1, "n"), ("k1", 9, "new")])
    states = []
    for size in (buckets.GROUP_BYTES, 1, 3000):
        monkeypatch.setattr(buckets, "GROUP_BYTES", size)
        path = str(tmp_path / f"t{size}")
        for part in (rows.where("at < 3"), rows.where("at >= 2"), rows.where("at >= 2")):
            buckets.merge(part, path, KEYS, ORDER, buckets=8)
        states.append(sorted(map(str, buckets.read_table(spark, path).collect())))
    assert states[0] == states[1] == states[2] == sorted(map(str, dedup_last(rows, KEYS, ORDER).collect()))
    assert set(scratch.glob("batch-*")) == before
    with pytest.raises(ValueError):
        buckets.merge(rows, path, ["k", "v"], ORDER)
    assert set(scratch.glob("batch-*")) == before


def test_an_upsert_in_batches_keeps_one_version(spark, sf_dir):
    from feedline.plans import tables

    scratch = Path(shared_folder(spark)) / "feedline"
    before = set(scratch.glob("prices-*"))
    found = tables.bucketed_upsert(spark, sf_dir)
    (made,) = set(scratch.glob("prices-*")) - before
    assert len(list((made / "data").iterdir())) == 1
    assert found.count() == tables.current_prices(spark, sf_dir).count()


def test_buckets_of_another_number_made_meanwhile(spark, tmp_path, monkeypatch):
    path, real, late = str(tmp_path / "t"), versions.update, []

    def overtaken(spark, at, step):
        if not late:
            late.append(at)
            buckets.merge(batch(spark, [("a", 1, "x"), ("z", 3, "y")]), path, KEYS, ORDER, buckets=3)
        return real(spark, at, step)

    monkeypatch.setattr(versions, "update", overtaken)
    buckets.merge(batch(spark, [("a", 2, "later"), ("b", 1, "x")]), path, KEYS, ORDER, buckets=8)
    assert state(spark, path) == [("a", 2, "later"), ("b", 1, "x"), ("z", 3, "y")]
    assert versions.newest(spark, path)[1]["buckets"] == 3
