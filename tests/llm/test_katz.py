"""Katz backoff against dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from feedline.llm import katz


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return lower.encode().split()


@pytest.fixture(scope="module")
def corpus():
    random.seed(8)
    vocabulary = [f"w{int(random.paretovariate(0.7))}" for _ in range(300)] + ["the"] * 60
    rows = [(n, " ".join(random.choices(vocabulary, k=random.choice((1, 3, 30, 200))))) for n in range(80)]
    return [*rows, (80, None), (81, ""), (82, " \t\n"), (83, "THE The the"), (83, "the"), (None, "unseen things w1"), (5, rows[5][1])]


def brute(train, model):
    single, pair, context = Counter(), Counter(), Counter()
    for text in train:
        sequence = [None, *words(text), 0]
        for v, w in zip(sequence, sequence[1:], strict=False):
            single[w] += 1
            pair[v, w] += 1
            context[v] += 1
    n = sum(single.values())

    def cut(found, c):
        return float(found(np.array([c]))[0])

    unknown = sum(c - cut(model.single, c) for c in single.values()) / n
    p1 = {w: cut(model.single, c) / n for w, c in single.items()}
    left, taken = Counter(), Counter()
    for (v, w), c in pair.items():
        left[v] += c - cut(model.pair, c)
        taken[v] += p1[w]

    def p(v, w):
        if (v, w) in pair:
            return cut(model.pair, pair[v, w]) / context[v]
        low = p1.get(w, unknown)
        return left[v] / context[v] / (1 - taken[v]) * low if v in context else low

    return single, n, p, context


@pytest.mark.parametrize(("buckets", "hot"), [(1, 8), (3, 8), (7, 0)])
def test_scores(spark, corpus, monkeypatch, buckets, hot):
    if not hot:
        monkeypatch.setattr(katz, "hot_words", lambda *_: np.zeros(0, np.uint64))
    monkeypatch.setattr(katz, "RUN", 16)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    train = [t for i, t in corpus if i is None or i % 4]
    model = katz.fit(docs.filter("doc_id IS NULL OR doc_id % 4 != 0"), buckets=buckets)
    single, n, p, contexts = brute(train, model)
    assert (model.tokens, model.types, model.texts) == (n, len(single), len(train))
    for v in [*list(contexts)[:40], b"never seen"]:
        assert abs(sum(p(v, w) for w in [*single, b"unknown"]) - 1) < 1e-9
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(docs, model).collect())
    want = []
    for doc_id, text in corpus:
        sequence = [None, *words(text), 0]
        base = sum(math.log10((single[w] + 0.5) / (n + 0.5 * (len(single) + 1))) for w in sequence[1:])
        score = sum(math.log10(p(v, w)) for v, w in zip(sequence, sequence[1:], strict=False))
        known = sum(single[w] > 0 for w in sequence[1:])
        want.append((str(doc_id), len(sequence) - 1, known, round(base, 6), round(score, 6)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-5 and abs(a[4] - b[4]) < 1e-5


def test_nothing_to_learn_from(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    model = katz.fit(docs.limit(0))
    rows = katz.score(docs, model).collect()
    assert len(rows) == len(corpus) and all(r["score"] == 0 and r["n_known"] == 0 for r in rows)
    assert katz.score(docs.limit(0), model).count() == 0
