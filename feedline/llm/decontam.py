"""Benchmark decontamination by suffix arrays over the training documents.

Documents are taken shard by shard.  Of a shard only the runs of words that the
benchmark knows, as long as its shortest window, can hold a window; their
suffixes are sorted into the shard's suffix array.  Every suffix of every
benchmark item is then sought by binary search, many of them in step.  Its
neighbours in the array give its longest verbatim match and where it is; where that
is at least a window long, the array's range of the window gives all its places.

A window is ``width`` consecutive words of an item; an item of fewer words, but
not none, is one window.  A document word inside any window's occurrence is hit.

The benchmark is the stated query set.  It is read in blocks of at most
``block_bytes`` of text; what a task holds is one block, whatever the
benchmark's size.  Null and empty texts have no words: such a document has no
hits, such an item no window.  Items are told apart by id; a null id is the
empty string.  Rows equal in id and text count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedline.llm.common import keyed, same_document, slices, stored, unused, utf8

WIDTH = 13
BLOCK_BYTES = 8 << 20
# Text of one shard: its suffix array is built and searched in one go.
SHARD_BYTES = 16 << 20
# Words of a suffix that are compared at a time, and suffixes that are sought together.
STEP = 16
TOGETHER = 1 << 16
# What does not belong to a word becomes a blank: all but 0-9, a-z and bytes beyond ASCII.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Queries:
    """The suffixes of some benchmark items as positions in their numbered words, a zero after each item."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.names, words, starts, owners, windows, lengths = [], [], [], [], [], []
        for name, text in items:
            found = words_of(text)
            if found:
                window = min(width, len(found))
                begin = sum(lengths) + len(lengths)
                count = len(found) - window + 1
                starts.append(np.arange(begin, begin + count))
                owners.append(np.full(count, len(self.names)))
                windows.append(np.full(count, window))
                words += [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found]
                words.append(0)
                lengths.append(len(found))
                self.names.append(name)
        empty = [np.empty(0, np.int64)]
        self.starts, self.owners, self.windows = (np.concatenate(x or empty) for x in (starts, owners, windows))
        self.begins = np.cumsum([0, *(n + 1 for n in lengths)])
        self.longest = max(lengths, default=0)
        self.shortest = int(self.windows.min(initial=width))
        self.words = np.concatenate([np.array(words, np.int32), np.zeros(STEP, np.int32)])

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))


def compared(text: np.ndarray, at: np.ndarray, queries: Queries, starts: np.ndarray, limits: np.ndarray) -> tuple:
    """For each pair of places: words in common, and the sign of text against query at the first other word.

    A pair ends at its limit or where the query's item ends; the sign is zero where
    nothing differs up to there.  All pairs go on together, some words at a time.
    """
    same, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    going, step, done = np.arange(len(at)), np.arange(STEP), 0
    while len(going):
        left = text[np.minimum(at[going, None] + done + step, len(text) - 1)]
        right = queries.words[np.minimum(starts[going, None] + done + step, len(queries.words) - 1)]
        # Up to the limit, and no further than the zero that ends the item.
        open_ = (done + step < limits[going, None]) & (np.cumsum(right == 0, axis=1) - (right == 0) == 0)
        differ = (left != right) & open_
        stops = differ | ~open_ | (right == 0)
        first, some = stops.argmax(axis=1), stops.any(axis=1)
        same[going] += np.where(some, first, STEP)
        row = np.arange(len(going))
        hit = differ[row, first] & some
        sign[going[hit]] = np.sign(left[row, first] - right[row, first])[hit]
        going = going[~some]
        done += STEP
    return same, sign


def bound(text, array, queries, starts, limits, after: bool) -> np.ndarray:
    """The first places in the suffix array not below the queries, or above them with ``after``; all at once."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        _, sign = compared(text, array[middle], queries, starts[open_], limits[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words, by prefix doubling."""
    rank = words.astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[:-reach] = rank[reach:] + 1
        pair = rank * (int(max(behind.max(), rank.max())) + 2) + behind
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.empty(len(rank), np.int64)
        fresh[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank, reach = fresh, reach * 2
        if len(rank) and rank.max() == len(rank) - 1:
            break
    return order


def search(numbered: list[np.ndarray], queries: Queries) -> list[tuple[int, int, str, int, int, int]]:
    """(document, item offset, item, match length, document offset, window) of all windows found in a shard.

    The match length is that of the item's longest verbatim match from there
    on; the places are those of its first window.
    """
    lengths = np.array([len(x) for x in numbered], np.int64)
    if not queries.names or not lengths.sum():
        return []
    # A zero after each document: no run leads from one into the next.
    words = np.concatenate([np.append(x, np.int32(0)) for x in numbered])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], words > 0, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= queries.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return []
    sizes = ends - begins + 1  # with the zero that ends the run
    at = np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    text = words[at]
    array = suffix_array(text, queries.longest)
    bounds = np.append(0, np.cumsum(lengths + 1))
    whole = np.full(len(queries.starts), queries.longest)
    found = []
    for begin_at in range(0, len(queries.starts), TOGETHER):
        own = slice(begin_at, begin_at + TOGETHER)
        starts, windows, owners = queries.starts[own], queries.windows[own], queries.owners[own]
        place = bound(text, array, queries, starts, whole[own], after=False)
        match = np.zeros(len(starts), np.int64)
        for near in (place - 1, place):
            there = np.flatnonzero((near >= 0) & (near < len(array)))
            same, _ = compared(text, array[near[there]], queries, starts[there], whole[own][there])
            match[there] = np.maximum(match[there], same)
        good = np.flatnonzero(match >= windows)
        low = bound(text, array, queries, starts[good], windows[good], after=False)
        high = bound(text, array, queries, starts[good], windows[good], after=True)
        for n, one, other in zip(good.tolist(), low.tolist(), high.tolist(), strict=True):
            places = at[array[one:other]]
            docs = np.searchsorted(bounds, places, side="right") - 1
            offset, name = int(starts[n] - queries.begins[owners[n]]), queries.names[owners[n]]
            hits = zip(docs.tolist(), (places - bounds[docs]).tolist(), strict=True)
            found.extend((doc, offset, name, int(match[n]), place_in, int(windows[n])) for doc, place_in in hits)
    return found


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size, one after another."""
    body = F.coalesce(F.col(text), F.lit(""))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), body.alias("text"))
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["name"], row["text"].encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each document and block ``n_words``, disjoint hit ``spans`` of words, the ``items`` found, and the longest match.

    ``longest`` has the length, the item, its offset and the document's offset.
    """
    rows = keyed(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    best = pa.struct([("words", pa.int64()), ("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64())])

    def over(shared: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(shared.value, width)
            for part in slices(batches, "text", SHARD_BYTES):
                numbered = [queries.numbered(words_of(t)) for t in utf8(part, "text")]
                hits: dict[int, list] = {}
                for doc, offset, name, length, at, window in search(numbered, queries):
                    hits.setdefault(doc, []).append((at, at + window, offset, name, length))
                spans, items, longest = [], [], []
                for n in range(len(numbered)):
                    own = sorted(hits.get(n, ()))
                    merged: list[list[int]] = []
                    for at, end, *_ in own:
                        if merged and at <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([at, end])
                    spans.append([{"begin": a, "end": b} for a, b in merged])
                    items.append(sorted({hit[3] for hit in own}))
                    top = max(own, key=lambda hit: (hit[4], -hit[0]), default=None)
                    longest.append(top and {"words": top[4], "item": top[3], "item_at": top[2], "at": top[0]})
                counts = pa.array([len(x) for x in numbered], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), counts]
                    + [pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(longest, best)],
                    ["doc_id", "text_key", "n_words", "spans", "items", "longest"],
                )

        return rows.mapInArrow(
            scan,
            f"doc_id {kind}, text_key long, n_words long, spans array<struct<begin:long,end:long>>, "
            "items array<string>, longest struct<words:long,item:string,item_at:long,at:long>",
        )

    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    context = docs.sparkSession.sparkContext
    if second is None:
        return over(context.broadcast(first))
    # Each block's finds are stored before the next one comes, so that one is held at a time everywhere.
    found = None
    for block in chain([first, second], blocks):
        shared = context.broadcast(block)
        part = stored(over(shared), "matches")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # Several blocks: what they found of a document comes together, without its text.
    merged = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"),
        F.max_by("longest", F.struct("longest.words", -F.col("longest.at"))).alias("longest"),
    )
    ids = keyed(docs, doc_id=doc_id, text=text, keep=False)
    return ids.join(merged, same_document(ids, merged)).select(ids["doc_id"], ids["text_key"], "n_words", "spans", "items", "longest")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``matches`` with ``n_hit``, sorted distinct ``items``, and ``contaminated``: a twentieth of the words or more are hit."""
    found = matches(docs, benchmark, **options)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["begin"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct("items"))
    counted = found.select("doc_id", "text_key", "n_words", "spans", covered.alias("n_hit"), items.alias("items"), "longest")
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return counted.withColumn("contaminated", bad)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they are.

    The contaminated ones are joined by id and text hash, so the texts are
    shuffled only if those are too many to broadcast.
    """
    bad = contamination(docs, benchmark, doc_id=doc_id, text=text, **options).filter("contaminated")
    names = unused(docs, "bad_id"), unused(docs, "bad_key")
    bad = bad.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]))
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[names[0]]) & (key == bad[names[1]]), "left_anti")
