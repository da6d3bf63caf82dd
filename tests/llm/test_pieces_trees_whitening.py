"""SentencePiece ids, ranked search and whitening against the library and plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from feedline.llm import balltree, feast, pieces
from feedline.llm.common import stored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["a ", " a  b ", "x▁y▁▁z", "▁", "a\n b\t\0c  ", " " * 30, "日本 😀" + " " * 3, "x" * 3000 + " " * 20 + "y"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL))


@pytest.mark.parametrize("segment", (pieces.SEGMENT, 40))
def test_pieces_equal_the_library(spark, docs, library, monkeypatch, segment):
    monkeypatch.setattr(pieces, "SEGMENT", segment)
    table = pieces.ChunkTable(path(pieces.MODEL))
    texts = [r["text"] or "" for r in docs.collect()] + ODD
    found = pieces.ids_of(texts, table, [library.eos_id()])
    assert [x.tolist() for x in found] == library.encode(texts, add_eos=True)


def test_pieces_of_rows(spark, docs, library):
    more = spark.createDataFrame([(100 + n, t) for n, t in enumerate(ODD)], "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(more)
    rows = pieces.decode(pieces.encode(whole)).collect()
    want = Counter()
    for r in whole.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want[(r["doc_id"], tuple(ids), library.decode(ids))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    bare = pieces.encode(whole, add_eos=False).filter("doc_id IS NULL").first()
    assert bare["ids"] == library.encode("no id at all")


def test_a_full_table_begins_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 500)
    table = pieces.ChunkTable(path(pieces.MODEL))
    for n in range(20):
        text = f"one word {n} and words{n}"
        assert pieces.ids_of([text], table, [])[0].tolist() == library.encode(text)
        assert len(table.codes) < 20


def test_distinct_chunks_are_whole(spark, docs, library):
    rows = pieces.distinct_chunks(docs).collect()
    assert len({r["chunk"] for r in rows}) == len(rows)
    total = sum(len(library.encode(r["text"] or "")) for r in docs.collect())
    assert sum(r["n"] * len(r["ids"]) for r in rows) == total


def test_models_with_crossing_pieces_are_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, n):
            return "of▁the"

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        pieces.processor("no such model")


def test_pieces_without_rows(spark, none):
    assert pieces.decode(pieces.encode(none)).collect() == []
    assert pieces.distinct_chunks(none).collect() == []


def ranking(docs, items, k=20):
    """The ranking by its definition, without floats but for the weights."""
    counts = [(d, Counter(TERM.findall(t.translate(LOWER)))) for d, t in docs if t is not None]
    counts = [(d, c) for d, c in counts if c]
    n_docs, all_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        if text is not None:
            asked[item].update(TERM.findall(text.translate(LOWER)))
    found = set()
    for item, terms in asked.items():
        scored = []
        for d, c in counts:
            m = 75 + 25 * c.total() * n_docs // all_terms
            score = 0
            for t, repeats in terms.items():
                if c[t]:
                    weight = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1)))
                    score += repeats * weight * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort()
        found |= {(item, n + 1, d, -s) for n, (s, _, d) in enumerate(scored[:k])}
    return found


@pytest.fixture(scope="module")
def crowd(spark, docs):
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(4000)]
    rows = [(n, " ".join(rng.sample(words, rng.randrange(1, 60)))) for n in range(700)]
    rows += [(1000 + n, "the same text W1, w2; w3 w4") for n in range(300)]  # a hot group of copies
    rows += [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3"), (8, None), (9, ""), (10, ".,-")]
    return docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)


ITEMS = [(n, f"w{n} W{n + 1} w{n + 2} w1 w1 Straße x1") for n in range(30)]
ITEMS += [(50, None), (51, ""), (52, "none of them"), (53, "w1"), (53, "w5 w5"), (None, "gnu license w3")]


@pytest.mark.parametrize("block", (balltree.BLOCK_ITEMS, 4))
def test_ranking_equals_its_definition(spark, crowd, monkeypatch, block):
    monkeypatch.setattr(balltree, "BLOCK_ITEMS", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("a clash"))
    found = balltree.search(stored(balltree.term_counts(crowd), "counts"), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in found.collect()]
    want = ranking([tuple(r) for r in crowd.collect()], ITEMS)
    assert len(rows) == len(set(rows)) == len(want)
    assert set(rows) == want


def test_bounds_hold_and_prune(crowd):
    """No document scores above the bound of a node that holds it, and far subtrees are not scored."""
    rng = np.random.default_rng(4)
    terms = [f"t{n}" for n in range(400)]
    topics = [rng.choice(400, 12, replace=False) for _ in range(40)]
    items = [{"item_id": n, "pairs": [{"term": terms[t], "weight": 900, "repeats": 1} for t in topics[n]]} for n in range(40)]
    block = balltree.Block(items)
    code = {t: n for n, t in enumerate(block.terms)}
    mine = [[code[terms[t]] for t in topics[n % 40] if terms[t] in code] for n in range(4000)]
    ends = np.cumsum([0, *map(len, mine)])
    values = rng.integers(400_000, 900_000, ends[-1])
    tree = balltree.BallTree(ends, np.concatenate(mine), values, block.roots)
    bounds, leaves = tree.bounds(block), [n for n, c in enumerate(tree.children) if not c]
    for n in range(40):
        for leaf in leaves:
            assert tree.scores(leaf, block.exact[n]).max() <= bounds[n, leaf]
    seen, plain = [], balltree.BallTree.scores
    tree.scores = lambda node, item: seen.append(node) or plain(tree, node, item)
    best = tree.search(block.exact[0], bounds[0].tolist(), list(range(4000)), [], 20)
    scores = [sum(block.exact[0][c] * v for c, v in zip(mine[d], values[ends[d] :], strict=False)) for d in range(4000)]
    assert [b[0] for b in best] == sorted(scores, reverse=True)[:20]
    assert len(seen) < len(leaves) / 2


def test_ranking_without_rows(spark, none, docs):
    items = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    counted = stored(balltree.term_counts(docs), "counts")
    for c, i in ((balltree.term_counts(none), items), (counted, items.limit(0)), (counted, items.withColumn("text", F.lit(None).cast("string")))):
        found = balltree.search(c, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert found.collect() == []


SPECTRA = {
    "plain": lambda rng, d: rng.random(d) * 100,
    "clusters": lambda rng, d: np.repeat(rng.random((d + 3) // 4) * 10, 4)[:d],
    "one value": lambda rng, d: np.ones(d),
    "low rank": lambda rng, d: np.r_[rng.random(min(d, 7)), np.zeros(max(0, d - 7))],
    "steep": lambda rng, d: 3.0 ** -np.arange(d),
}


@pytest.mark.parametrize("kind", SPECTRA)
@pytest.mark.parametrize("d", (1, 2, 24, 64))
def test_contours_find_every_eigenvalue(kind, d):
    rng = np.random.default_rng(d)
    values = SPECTRA[kind](rng, d)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    for shift in (-1.0, values.mean() * 1.0001, values.max() + 1):
        assert feast.inertia(matrix - shift * np.eye(d)) == (values < shift).sum()
    found = [feast.eigenpairs(matrix, *part) for part in feast.intervals(matrix, 32)]
    got = np.sort(np.concatenate([f[0] for f in found]))[::-1][:32]
    want = np.sort(values)[::-1][:32]
    # Only what counts as without variance is left out.
    assert (want[len(got) :] <= feast.LEAST * 10 * want[0]).all()
    want = want[: len(got)]
    assert np.abs(got - want).max() < 1e-12 * max(1, want[0])
    vectors = np.concatenate([f[1] for f in found], axis=1)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-7


def test_missed_eigenvalues_are_an_error():
    with pytest.raises(ArithmeticError):
        feast.eigenpairs(np.diag([1.0, 2.0, 3.0]), 1.5, 2.5, 2)


def whitened(rows, k):
    """Whitening by a dense decomposition of the exact covariance."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    off = (x * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:k]
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    return [i for i, _ in kept], deviation, off @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    spread = rng.random(40) * 3
    rows = [(n, [float(c) for c in np.float32(rng.standard_normal(40) * spread)]) for n in range(300)]
    rows += [(n, rows[0][1]) for n in range(300, 400)]  # a hot vector
    return rows + [(5, rows[5][1]), (None, rows[3][1])]


def test_whitening_equals_a_dense_decomposition(spark, vectors):
    bad = [(900, None), (901, []), (902, [None] + [0.0] * 39), (903, [math.nan] * 40), (904, [math.inf] * 40), (905, [1.0, 2.0])]
    table = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    table = table.withColumn("x", F.lit("a clash")).withColumn("n", F.lit(1)).repartition(4)
    rows = feast.whiten(table).collect()
    ids, deviation, scores, explained = whitened(vectors, 32)
    assert len(rows) == len(ids) * 32
    assert {r["n"] for r in rows} == {len(ids)}
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]}
    assert rows[0]["identity_error"] < 1e-10
    assert Counter((r["vec_id"], int(r["deviation"])) for r in rows if r["component"] == 1) == Counter(zip(ids, deviation, strict=True))
    for c in range(32):
        mine = [r for r in rows if r["component"] == c + 1]
        assert all(abs(r["explained"] / explained[c] - 1) < 1e-10 for r in mine)
        want = dict(zip(ids, scores[:, c], strict=True))
        sign = np.sign(want[7]) * np.sign(next(r["whitened"] for r in mine if r["vec_id"] == 7))
        assert all(abs(r["whitened"] - sign * want[r["vec_id"]]) < 1e-8 for r in mine)


def test_products_beyond_floats_are_exact():
    rng = np.random.default_rng(3)
    rows = rng.integers(-(2**40), 2**40, (50, 4))
    assert feast.exact_products(rows) == (rows.astype(object).T @ rows.astype(object)).tolist()
    small = rows % 1000
    assert feast.exact_products(small) == (small.T @ small).tolist()


def test_components_without_variance_are_left_out(spark):
    schema = "vec_id long, embedding array<float>"
    flat = [(n, [float(n % 3), 2.0, float(n % 3)]) for n in range(9)]
    rows = feast.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in rows} == {1}
    assert all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    for table in ([], [(1, None)], [(1, [1.0, 2.0])], [(n, [4.0]) for n in range(5)]):
        assert feast.whiten(spark.createDataFrame(table, schema)).collect() == []


def test_lists_of_one_length_only(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 0.0]), (3, [5.0])]
    found = feast.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["vec_id"] for r in found.collect()} == {1, 2}
