"""Every stage on the same awkward rows, one after the other."""

import re
from collections import Counter
from random import Random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedline.llm import langid, nearcopies


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    items = [(1, " ".join(texts[18].split()[:390])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}


def first_ids(rows):
    """The smallest id of each group of texts that are 0.8 alike or more, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    groups = [[i for g, (i, _) in zip(group, sets, strict=True) if g == root and i is not None] for root in set(group)]
    return [min(ids, default=None) for ids in groups]


def test_stages_in_turn(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    before, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder).persist()
        if name == "tokens":
            assert after.count() == before.count()
            break
        assert after.columns == names
        old, new = (Counter(r["doc_id"] for r in x.collect()) for x in (before, after))
        assert not new - old
        if name == "language":
            gone = {r["doc_id"] for r in before.collect() if not re.search(r"[^\W\d_]", r["text"] or "")}
            assert set(new) == set(old) - gone
        if name == "near_duplicates":
            assert new == Counter(first_ids([(r["doc_id"], r["text"]) for r in before.collect()]))
            assert new[9] == 0 and new[8] == 1 and new[20] == 0 and new[18] == 1
        if name == "decontaminated":
            assert new[18] == 0 and sum((old - new).values()) <= 2
        if name == "private":
            assert new == old and after.filter("text LIKE '%@mail.example.org%'").count() == 0
            assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
        before = after


def test_repeated_rows_leave_one(spark, docs, folder):
    twice = docs.filter("doc_id IN (4, 5)").union(docs.filter("doc_id IN (4, 5)"))
    kept = corpus_pipeline.near_duplicates(spark, twice, folder)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [
        (4, "another text under an id that was used"),
        (4, "one"),
        (5, "one two"),
    ]


def test_no_task_has_two_python_workers(spark, docs, folder, monkeypatch):
    """Between two Python operators of a plan lies an exchange or a stored table."""
    monkeypatch.setattr(langid, "STEPS", 5)

    def chained(node, inside):
        name = node.nodeName()
        python = re.search("Arrow|Python|Pandas", name) is not None
        if "Exchange" in name or name.startswith("AdaptiveSparkPlan"):
            inside = python = False
        below = [node.inputPlan()] if name.startswith("AdaptiveSparkPlan") else list(node_children(node))
        return python and inside or any(chained(c, inside or python) for c in below)

    def node_children(node):
        children = node.children()
        return (children.apply(n) for n in range(children.size()))

    twice = docs.mapInArrow(lambda rows: rows, docs.schema).mapInArrow(lambda rows: rows, docs.schema)
    assert chained(twice._jdf.queryExecution().executedPlan(), False)
    # The plan that near_duplicates returns only reads what it has stored.
    for stage in (corpus_pipeline.tokens, corpus_pipeline.language, corpus_pipeline.decontaminated, corpus_pipeline.private):
        plan = stage(spark, docs, folder)._jdf.queryExecution().executedPlan()
        assert not chained(plan, False), stage.__name__


def test_no_documents(spark, none, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_near_copies_at_four_fifths(spark, none, folder):
    """Copies with scattered changes go from 0.8 up, against brute force over all pairs; chains are followed."""
    random = Random(11)
    rows, n = [], 0
    for _ in range(60):
        words = [f"v{random.randrange(5000)}" for _ in range(200)]
        for changes in (0, 1, 2, 3, 4, 7, 9):
            copy = list(words)
            for at in random.sample(range(200), changes):
                copy[at] = f"c{random.randrange(10**6)}"
            rows.append((n, " ".join(copy), "en", None, None, "x", "y", 1, 2))
            n += 1
    docs = spark.createDataFrame(rows, none.schema).repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert kept == set(first_ids([(r[0], r[1]) for r in rows])) and 60 < len(kept) < n


def template_rows(random, n, own):
    shared = [f"t{i}" for i in range(400)]
    return [(i, " ".join([f"o{i}x{random.randrange(10**9)}" for _ in range(own)] + shared)) for i in range(n)]


def test_texts_on_one_template_make_few_pairs(spark, monkeypatch):
    """Below 0.8 a shared template is not even looked at; the pairs grow with the texts, not with their square."""
    sizes, verify = [], nearcopies.verified

    def counted(pairs, *args, **names):
        sizes[-1] += pairs.count()
        return verify(pairs, *args, **names)

    monkeypatch.setattr(nearcopies, "verified", counted)
    for n in (200, 400):
        sizes.append(0)
        rows = template_rows(Random(n), n, 66)  # 0.75 alike
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert nearcopies.links(docs) is None
    assert sizes[0] <= 200 and sizes[1] <= 400


def test_a_group_of_near_copies_is_not_paired_all_with_all(spark, monkeypatch):
    sizes, verify = [], nearcopies.verified

    def counted(pairs, *args, **names):
        sizes.append(pairs.count())
        return verify(pairs, *args, **names)

    monkeypatch.setattr(nearcopies, "verified", counted)
    rows = template_rows(Random(5), 300, 9)  # 0.95 alike
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = nearcopies.near_copies(docs)
    assert groups.select("root").distinct().count() == 1
    assert sum(sizes) < 10 * 300


def test_prints_link_near_copies(spark, monkeypatch):
    """Without the join that finds the rest, most texts with one changed word still meet by their prints."""
    monkeypatch.setattr(nearcopies, "open_postings", lambda posted, found: posted.withColumn("root", F.col("h")).limit(0))
    random, rows = Random(3), []
    for n in range(20):
        words = [f"p{n}x{random.randrange(10**9)}" for _ in range(1500)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:700], "changed", *words[701:]]))]
    groups = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert len(found) == 40 and all(c in (i, i - i % 2) for i, c in found.items())
    assert sum(i != c for i, c in found.items()) >= 10


def test_order_of_shingles_changes_no_result(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text_key"], r["component_id"]) for r in nearcopies.near_copies(docs).collect()]
    monkeypatch.setattr(nearcopies, "COMMON", 3)
    monkeypatch.setattr(nearcopies, "AT_LEAST", 1)
    monkeypatch.setattr(nearcopies, "ROUNDS", 0)
    again = [(r["doc_id"], r["text_key"], r["component_id"]) for r in nearcopies.near_copies(docs).collect()]
    assert Counter(rows) == Counter(again)


def test_columns_of_the_stages_own_names_stay(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    names = {c: F.lit(f"my {c}") for c in ("score", "lang_pred", "guess", "key", "__key", "__letters", "root")}
    more = docs.withColumns(names)
    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated, corpus_pipeline.private):
        kept = stage(spark, more, folder)
        assert kept.columns == more.columns
        row = kept.filter("doc_id = 21").first()
        assert all(row[c] == f"my {c}" for c in names)


def test_near_copies_of_awkward_rows(spark, docs, folder):
    """12 and 13 are 0.64 alike, 18 to 20 0.97."""
    kept = corpus_pipeline.near_duplicates(spark, docs.filter("doc_id > 3"), folder)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 21]


def test_every_label_with_text_is_sampled(spark):
    """A label of many copies, empty texts and few other texts keeps all of its distinct texts."""
    rows = [(f"bonjour {i}", "fr") for i in range(20)] + [("copie", "fr")] * 4000 + [("", "fr"), (None, "fr")] * 2000
    docs = spark.createDataFrame(rows + [("hello", "en"), ("", "xx")], "text string, lang string").repartition(3)
    pairs = langid.sample(docs, text="text", lang="lang", per_class=30, windows=1, window=8)
    assert [label for label, _ in pairs].count("fr") == 21 and {label for label, _ in pairs} == {"en", "fr"}


def test_language_without_labels_keeps_texts(spark, docs, texts, folder):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, unlabelled, folder)
    assert kept.columns == docs.columns
    letters = sum(bool(re.search(r"[^\W\d_]", t or "")) for t in texts)
    assert kept.count() == letters + 3


def test_language_is_decided_by_the_probabilities(spark, docs, folder, monkeypatch):
    """Bytes of ``q`` leave four labels at a quarter each, all others speak for the first."""
    net = langid.Network(
        ["a", "b", "c", "d"],
        np.zeros((2, 3, 257, 1), np.float32),
        np.zeros((2, 3, 1, 1), np.float32),
        np.array([[9, 9], [0, 0], [0, 0], [0, 0]], np.float32),
        np.zeros((4, 1), np.float32),
    )
    net.table[:, :2], net.table[:, 2] = 9, 9
    net.table[:, 2, ord("q")] = 0
    net.table[:, :, 256] = 0
    monkeypatch.setattr(langid, "fit", lambda docs: net)
    rows = spark.createDataFrame([(1, "q" * 90), (2, "a clean text"), (3, "?!")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, rows, folder).collect()] == [2]
