"""Exact ranked search by ball trees over sparse document vectors.

A document's vector holds, for each of its terms, the whole number
``(1000000000 * tf) div (1000 * tf + 12 * m)`` with the length factor
``m = 75 + (25 * n * N) div L``; an item's vector holds ``floor(1000 * ln((2N + 2)
/ (2df + 1)))`` for each of its terms, times its repeats.  A score is their inner
product.

Statistics are Spark aggregates over all documents.  Items are searched in blocks
of bounded size, one broadcast at a time.  A task gathers documents up to a bound,
keeps the coordinates that the block's items have (others add nothing), and builds
a ball tree: a node has the centroid of its documents and a radius that holds them
all.  By Cauchy-Schwarz no document below it scores more than the item's product
with the centroid plus its length times the radius.  Nodes are taken best first,
until no bound reaches the k-th score.  Bounds are floats with a margin above any
rounding, scores are whole numbers added exactly, so no document is lost.  Every
task hands on its k best of each item, whose best are the result.

Documents without terms (null and empty texts too) do not count and are never
found.  Rows are documents: repeated ids and texts are ranked apart, equal scores by
ascending id, null ids last.  Rows of ``items`` with one id are one item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedline.llm.common import LOWER, as_batch, slices, stored, utf8

# Bytes that separate terms, and the same as a pattern.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_PLAIN = bytes(LOWER[b] if LOWER[b] in _KEPT else 0x20 for b in range(256))

LEAF = 32
# Documents and coordinates of one tree.
TREE_DOCS = 8192
TREE_SIZE = 1 << 21
# Items, and terms of items, of one block.
BLOCK_ITEMS = 256
BLOCK_TERMS = 1 << 15
# Entries of the centroids of one tree.
CENTRES = 1 << 23
# Above the relative rounding error of any sum here.
MARGIN = 1e-9


def term_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` and the distinct ``terms`` with their ``tfs`` of every document that has any."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            tallies = [Counter(t.translate(_PLAIN).split()) for t in utf8(part, "text")]
            ends = pa.array(np.cumsum([0, *map(len, tallies)]), pa.int32())
            terms = pa.array([t for tally in tallies for t in tally], pa.binary()).cast(pa.string())
            tfs = pa.array([n for tally in tallies for n in tally.values()], pa.int64())
            totals = pa.array([tally.total() for tally in tallies], pa.int64())
            lists = [pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)]
            columns = [part.column("doc_id"), totals, *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n long, terms array<string>, tfs array<long>").filter("n > 0")


def item_vectors(counted: DataFrame, items: DataFrame, n_docs: int, *, item_id: str, text: str) -> DataFrame:
    """``item_id`` and ``pairs`` of term, weight and repeats; terms that weigh nothing are left out."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = F.regexp_extract_all(F.translate(F.col(text), upper, lower), F.lit(TERM), F.lit(0))
    asked = items.select(F.col(item_id).alias("item_id"), F.explode(words).alias("term"))
    asked = asked.groupBy("item_id", "term").agg(F.count("*").alias("repeats"))
    # Counted before the join: what is shuffled is one row for each term of a task.
    known = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df").cast("double") + 1.0)
    weighed = asked.join(known, "term").withColumn("weight", F.floor(1000.0 * F.log(ratio)).cast("long"))
    pair = F.struct("term", "weight", "repeats")
    return weighed.filter("weight > 0").groupBy("item_id").agg(F.collect_list(pair).alias("pairs"))


class Block:
    """Some items as dense vectors over the terms that any of them has."""

    def __init__(self, items: list) -> None:
        weights = {p["term"]: p["weight"] for item in items for p in item["pairs"]}
        self.ids = [item["item_id"] for item in items]
        self.terms = sorted(weights)
        code = {t: n for n, t in enumerate(self.terms)}
        # Both sides carry the root of the weight: common terms hardly widen a ball.
        self.roots = np.sqrt([float(weights[t]) for t in self.terms])
        self.exact = np.zeros((len(items), len(code)), np.int64)
        self.points = np.zeros((len(items), len(code)))
        for n, item in enumerate(items):
            for p in item["pairs"]:
                self.exact[n, code[p["term"]]] = p["weight"] * p["repeats"]
                self.points[n, code[p["term"]]] = np.sqrt(float(p["weight"])) * p["repeats"]
        self.lengths = np.sqrt((self.points**2).sum(axis=1))


def blocks(vectors: DataFrame) -> Iterator[Block]:
    """The items in blocks; one of them is with the driver at a time."""
    held, size = [], 0
    for item in vectors.toLocalIterator():
        if held and (len(held) == BLOCK_ITEMS or size + len(item["pairs"]) > BLOCK_TERMS):
            yield Block(held)
            held, size = [], 0
        held.append(item)
        size += len(item["pairs"])
    if held:
        yield Block(held)


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of several runs, one after another."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class BallTree:
    """Documents in tree order; node ``i`` owns ``[low[i], high[i])`` and has a centroid and a radius."""

    def __init__(self, ends: np.ndarray, codes: np.ndarray, values: np.ndarray, roots: np.ndarray) -> None:
        begins, sizes = ends[:-1], np.diff(ends)
        points = values * roots[codes]
        squares = np.add.reduceat(points**2, begins)
        self.order = np.arange(len(sizes))
        self.low, self.high, self.children, centres, self.radius = [], [], [], [], []
        stack = [(0, len(sizes), -1)]
        while stack:
            low, high, parent = stack.pop()
            node = len(self.low)
            if parent >= 0:
                self.children[parent].append(node)
            rows = self.order[low:high]
            at = runs(begins[rows], sizes[rows])
            cut = np.cumsum(sizes[rows]) - sizes[rows]
            mine, here = codes[at], points[at]
            centre = np.bincount(mine, here, len(roots)) / len(rows)
            away = squares[rows] - 2 * np.add.reduceat(here * centre[mine], cut) + centre @ centre
            safe = np.maximum(away, 0) + MARGIN * (squares[rows] + centre @ centre)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            centres.append(centre)
            self.radius.append(np.sqrt(safe.max()) * (1 + MARGIN))
            if len(rows) > LEAF:
                # Along the line between a farthest document and the one farthest from it.
                one = self._dense(rows[away.argmax()], begins, sizes, codes, points, len(roots))
                off = squares[rows] - 2 * np.add.reduceat(here * one[mine], cut)
                other = self._dense(rows[off.argmax()], begins, sizes, codes, points, len(roots))
                side = np.argsort(np.add.reduceat(here * (other - one)[mine], cut), kind="stable")
                self.order[low:high] = rows[side]
                middle = (low + high) // 2
                stack += [(middle, high, node), (low, middle, node)]
        self.centres, self.radius = np.array(centres), np.array(self.radius)
        at = runs(begins[self.order], sizes[self.order])
        self.codes, self.values = codes[at], values[at]
        self.ends = np.concatenate([[0], np.cumsum(sizes[self.order])])

    @staticmethod
    def _dense(row, begins, sizes, codes, points, width) -> np.ndarray:
        mine = slice(begins[row], begins[row] + sizes[row])
        return np.bincount(codes[mine], points[mine], width)

    def bounds(self, block: Block) -> np.ndarray:
        """No document of a node (column) scores more for an item (row)."""
        reach = block.points @ self.centres.T + block.lengths[:, None] * self.radius
        return reach * (1 + MARGIN) + 1

    def scores(self, node: int, item: np.ndarray) -> np.ndarray:
        low, high = self.ends[self.low[node]], self.ends[self.high[node]]
        mine = slice(low, high)
        starts = self.ends[self.low[node] : self.high[node]] - low
        return np.add.reduceat(item[self.codes[mine]] * self.values[mine], starts)

    def search(self, item: np.ndarray, bounds: list[float], ids: list, best: list, k: int) -> list:
        """``best``, the k best (score, id) so far, with the documents of this tree that are among them."""
        waiting = [(-bounds[0], 0)]
        least = best[-1][0] if len(best) == k else 1
        while waiting and -waiting[0][0] >= least:
            bound, node = heappop(waiting)
            for child in self.children[node]:
                heappush(waiting, (-min(-bound, bounds[child]), child))
            if self.children[node]:
                continue
            found = self.scores(node, item)
            rows = np.flatnonzero(found >= least)
            if len(rows):
                best = best + [(int(found[r]), ids[self.order[self.low[node] + r]]) for r in rows]
                best = sorted(best, key=lambda b: (-b[0], b[1] is None, b[1]))[:k]
                least = best[-1][0] if len(best) == k else 1
        return best


def vectors_of(part: pa.RecordBatch, block: Block, n_docs: int, all_terms: int) -> tuple:
    """Ids, entry counts, term codes and exact values of the rows that share a term with the block."""
    lists = part.column("terms")
    codes = pc.index_in(lists.flatten(), value_set=pa.array(block.terms, pa.string()))
    known = pc.is_valid(codes).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[known]
    tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False)[known]
    factor = np.array([75 + (25 * n * n_docs) // all_terms for n in part.column("n").to_pylist()], np.int64)
    values = (1_000_000_000 * tf) // (1000 * tf + 12 * factor[owner])
    held = np.bincount(owner, minlength=len(sizes))
    rows = np.flatnonzero(held)
    ids = part.column("doc_id").take(pa.array(rows)).to_pylist()
    return ids, held[rows], pc.drop_null(codes).to_numpy(zero_copy_only=False), values


def search(
    counted: DataFrame, items: DataFrame, *, k: int = 20, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the k best documents of every item.

    ``counted`` is what :func:`term_counts` gives; it is read several times, so
    hand it over as a stored table.
    """
    spark = counted.sparkSession
    n_docs, all_terms = counted.agg(F.count("*"), F.sum("n")).first()
    types = {"item_id": items.schema[item_id].dataType, "doc_id": counted.schema["doc_id"].dataType}
    result = f"item_id {types['item_id'].simpleString()}, doc_id {types['doc_id'].simpleString()}, score long"
    # One column for the place in the block, since ids need not be unique or comparable.
    found_schema = f"place int, doc_id {types['doc_id'].simpleString()}, score long"
    parts: list[DataFrame] = []
    for block in blocks(item_vectors(counted, items, n_docs, item_id=item_id, text=text)):
        shared = spark.sparkContext.broadcast(block)
        docs_limit = min(TREE_DOCS, max(LEAF, CENTRES * LEAF // (4 * len(block.terms))))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared, limit=docs_limit) -> Iterator[pa.RecordBatch]:
            block, best, ids, sizes, codes, values = shared.value, [[] for _ in shared.value.ids], [], [], [], []

            def one_tree() -> None:
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                tree = BallTree(ends, np.concatenate(codes), np.concatenate(values), block.roots)
                for n, bounds in enumerate(tree.bounds(block).tolist()):
                    best[n] = tree.search(block.exact[n], bounds, ids, best[n], k)
                for held in (ids, sizes, codes, values):
                    held.clear()

            kind = None
            step = max(1, limit // 16)
            for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                kind = part.schema.field("doc_id").type
                more = vectors_of(part, block, n_docs, all_terms)
                if ids and (len(ids) + len(more[0]) > limit or sum(map(len, codes)) + len(more[2]) > TREE_SIZE):
                    one_tree()
                if more[0]:
                    ids += more[0]
                    for held, new in zip((sizes, codes, values), more[1:], strict=True):
                        held.append(new)
            if ids:
                one_tree()
            rows = [(n, doc, score) for n, mine in enumerate(best) for score, doc in mine]
            if rows:
                schema = pa.schema([("place", pa.int32()), ("doc_id", kind), ("score", pa.int64())])
                yield as_batch(schema, *map(list, zip(*rows, strict=True)))

        best_of_tasks = counted.mapInArrow(searched, found_schema)
        one_item = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = best_of_tasks.withColumn("rank", F.row_number().over(one_item)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"place int, item_id {types['item_id'].simpleString()}")
        parts.append(stored(ranked.join(names, "place").select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], result).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole
