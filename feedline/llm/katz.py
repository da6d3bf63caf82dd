"""Katz backoff over words: Good-Turing counts of pairs that back off to single words and to one unknown word.

    P(w | v) = c*(v, w) / c(v)           where the pair was seen
               alpha(v) * P(w)           where only v was seen
               P(w)                      else
    P(w)     = c*(w) / N, what the discounts leave is the unknown word's

Every text starts after a start mark and ends with an end token.  Discounts are
Turing's for counts up to ``LOW`` where they are sound, else (and above) those
of a line through the logarithms of the counts of counts, so every context
keeps some mass; ``alpha`` divides exactly that mass by the mass of the words
not seen after it, so each distribution sums to one.

**Tables.**  ``pairs`` lies in buckets of the following word, ``contexts`` in
buckets of the context; a row of a table is a run of sorted arrays.  Words are
64-bit hashes.  A word that makes up a notable share of a bounded sample would
fill its bucket: its pairs are spread over all buckets by their context, and its
total is kept with the model.  The sample steers the spreading alone, never a
count.  That list holds at most ``HOT`` words for each bucket.

**Work.**  A slice of texts is reduced to its distinct pairs before anything is
shuffled, as one block of arrays for each bucket.  A token is evaluated where
its pair's bucket is; the count of a context is looked up where the context word
itself is evaluated, since each word of a text is the context of the token after
it; tokens that back off go on to the bucket of their context.  Blocks bring
sums for each text, never single tokens, back together.

Null texts are empty: one end token.  Rows are independent, also where they
share an id.  If there is nothing to learn from, only the unknown word is left
and every score is zero.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedline.llm.common import LOWER, slices, uri, utf8
from feedline.session import new_scratch

START, END = np.uint64(0), np.uint64(1)
LOW = 5
FIT = 10
SLICE = 8 << 20
RUN = 1 << 16
HOT = 8
SAMPLE_ROWS = 20_000
# Text bytes for each bucket: its pairs must fit in a task.
BUCKET_BYTES = 24 << 20


# Blocks -----------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(c.tobytes() for c in columns))


def unpacked(block: bytes, *kinds: str) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(block)
    rows, at, out = int(np.frombuffer(body, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, rows, at))
        at += out[-1].nbytes
    return out


def sums_by(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of each of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return [key[firsts], *((np.add.reduceat(v[order], firsts) if len(key) else v[:0]) for v in values)]


@dataclass
class Tokens:
    """The tokens of a slice of texts: local numbers of words, and hashes by number (0: start, 1: end)."""

    hashes: np.ndarray
    context: np.ndarray
    word: np.ndarray
    doc: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    numbers: dict[bytes, int] = defaultdict(count(2).__next__)
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for n, text in enumerate(texts):
        own = text.translate(LOWER).split()
        sizes[n] = len(own) + 1
        flat.extend(map(numbers.__getitem__, own))
        flat.append(1)
    word = np.array(flat, np.int64)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = 0
    digest = xxhash.xxh64_intdigest
    # The two marks' hashes belong to no word.
    hashes = np.array([0, 1, *((digest(w) if digest(w) > 1 else 2) for w in numbers)], np.uint64)
    return Tokens(hashes, context, word, np.repeat(np.arange(len(texts), dtype=np.int64), sizes))


def spread(word: np.ndarray, context: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair: the word's, or for a hot word the context's turn after it."""
    mixed = word >> np.uint64(20)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, word), len(hot) - 1)] == word
        mixed = mixed + np.where(is_hot, context >> np.uint64(24), np.uint64(0))
    return (mixed % np.uint64(buckets)).astype(np.int32)


def in_buckets(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its rows, in the given order within."""
    if not len(order):
        return
    order = order[np.argsort(bucket[order], kind="stable")]
    ordered = bucket[order]
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(ordered[a]), order[a:b]


# Discounts --------------------------------------------------------------


@dataclass
class Discounts:
    """``low``: discounted counts of 0..LOW; ``slope``: of the line through log counts of counts."""

    low: np.ndarray
    slope: float

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = np.maximum(counts, 1).astype(np.float64)
        out = c * (1 + 1 / c) ** (self.slope + 1)
        small = counts <= LOW
        out[small] = self.low[counts[small]]
        return out


def discounts(counts_of_counts: dict[int, int]) -> Discounts:
    seen = [(r, counts_of_counts[r]) for r in range(1, FIT + 1) if counts_of_counts.get(r)]
    slope = -2.0
    if len(seen) > 1:
        slope = float(np.polyfit(np.log([r for r, _ in seen]), np.log([n for _, n in seen]), 1)[0])
    # A slope above -1 would raise counts; one far below would leave nothing of them.
    slope = min(max(slope, -2.5), -1.1)
    low = np.zeros(LOW + 1)
    for r in range(1, LOW + 1):
        turing = (r + 1) * counts_of_counts.get(r + 1, 0) / max(1, counts_of_counts.get(r, 0))
        low[r] = turing if 0.05 * r < turing < 0.999 * r else r * (1 + 1 / r) ** (slope + 1)
    return Discounts(low, slope)


# Model ------------------------------------------------------------------


@dataclass
class Model:
    folder: str
    buckets: int
    tokens: int  # N
    types: int  # V
    texts: int
    unknown: float  # P of the unknown word
    single: Discounts
    pair: Discounts
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def totals(self, words: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct words: the sums at hand, or the model's where a word is spread."""
        if not len(self.hot):
            return local
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, self.hot_counts[at], local)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.single(counts) / max(1, self.tokens), self.unknown)


def table_of(folder: str, name: str, bucket: int, *columns: str) -> list[np.ndarray]:
    """One bucket of a table of the model, its runs put together in order."""
    store, base = pafs.FileSystem.from_uri(f"{folder}/{name}/bucket={bucket}")
    if store.get_file_info(base).type == pafs.FileType.NotFound:
        return [np.zeros(0, np.int64) for _ in columns]
    rows = pq.read_table(base, filesystem=store, partitioning=None, columns=["run", *columns]).sort_by("run")
    return [rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in columns]


def runs(bucket: int, key: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, pa.DataType]) -> pa.Table:
    """Arrays in rows of about ``RUN`` entries that never part equal keys."""
    edges = [0]
    while edges[-1] < len(key):
        end = min(edges[-1] + RUN, len(key))
        edges.append(int(np.searchsorted(key, key[end - 1], side="right")))
    out = {"bucket": pa.array([bucket] * (len(edges) - 1), pa.int32()), "run": pa.array(range(len(edges) - 1), pa.int32())}
    for name, values in columns.items():
        kind = pa.list_(kinds[name])
        parts = [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        out[name] = pa.array(parts, kind)
    return pa.table(out)


def hot_words(docs: DataFrame, text: str, rows: int, buckets: int) -> np.ndarray:
    """Hashes of the words that make up a notable share of about ``SAMPLE_ROWS`` rows, ``HOT`` a bucket at most."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = tokens_of(utf8(part, "text"))
            n = np.bincount(found.word, minlength=len(found.hashes))
            # Whatever reaches the share in all reaches it in some slice.
            often = np.flatnonzero(n >= len(found.word) / (HOT * buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.hashes[often].astype(np.int64)), pa.array(n[often]), pa.array([len(found.word)] * len(often))],
                ["word", "n", "all"],
            )

    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sampled = docs.select(F.col(text).alias("text")).sample(fraction=share, seed=1) if share < 1 else docs.select(F.col(text).alias("text"))
    found = sampled.mapInArrow(shares, "word long, n long, all long").groupBy("word").agg(F.sum("n") / F.sum("all"))
    top = found.toDF("word", "share").filter(F.col("share") >= 1 / (HOT * buckets)).orderBy(F.desc("share"), "word")
    words = [r["word"] for r in top.limit(HOT * buckets).collect()]
    return np.sort(np.array(words, np.int64).astype(np.uint64))


BLOCKS = "bucket int, slice long, block binary"


def fit(docs: DataFrame, *, text: str = "text", buckets: int | None = None) -> Model:
    """Learn from every row of ``docs`` and store the tables in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    rows, bytes_in = size[0], size[1] or 0
    buckets = buckets or max(8, -(-bytes_in // BUCKET_BYTES))
    hot = hot_words(docs, text, rows, buckets)
    folder = uri(new_scratch(spark, "katz"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = tokens_of(utf8(part, "text"))
            width = len(found.hashes)
            pair, n = np.unique(found.context * width + found.word, return_counts=True)
            word, context = found.hashes[pair % width], found.hashes[pair // width]
            bucket = spread(word, context, hot, buckets)
            for b, at in in_buckets(bucket, np.lexsort((context, word))):
                block = packed(word[at], context[at], n[at].astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([0], pa.int64()), pa.array([block], pa.binary())],
                    ["bucket", "slice", "block"],
                )

    kinds = {"word": pa.int64(), "context": pa.int64(), "n": pa.int64()}

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        blocks = [unpacked(b, "<u8", "<u8", "<u4") for b in group.column("block").to_pylist()]
        word, context, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.lexsort((context, word))
        word, context, n = word[order], context[order], n[order].astype(np.int64)
        firsts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])))
        n = np.add.reduceat(n, firsts)
        columns = {"word": word[firsts].astype(np.int64), "context": context[firsts].astype(np.int64), "n": n}
        return runs(key[0].as_py(), word[firsts], columns, kinds)

    texts = docs.select(F.col(text).alias("text"))
    pairs = texts.mapInArrow(counted, BLOCKS).groupBy("bucket").applyInArrow(
        merged, "bucket int, run int, word array<long>, context array<long>, n array<long>"
    )
    pairs.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/pairs")
    pairs = spark.read.schema(pairs.schema).parquet(f"{folder}/pairs")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of counts (kind 1: words, 2: pairs) and partial totals of hot words (kind 0)."""
        for batch in batches:
            for row in range(batch.num_rows):
                word, n = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("word", "n"))
                words, totals = sums_by(word.astype(np.uint64), n)
                is_hot = np.isin(words, hot)
                out = [(0, words[is_hot].astype(np.int64), totals[is_hot])]
                out += [(1, *np.unique(totals[~is_hot], return_counts=True)), (2, *np.unique(n, return_counts=True))]
                for kind, key, value in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(value)], ["kind", "key", "n"]
                    )

    table = pairs.select("word", "n").mapInArrow(histogram, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    table.write.parquet(f"{folder}/counts")
    table = spark.read.schema(table.schema).parquet(f"{folder}/counts")
    totals = {r["key"]: r["n"] for r in table.filter("kind = 0").collect()}
    hot_counts = np.array([totals.get(w, 0) for w in hot.astype(np.int64).tolist()], np.int64)
    small = {(r["kind"], r["key"]): r["n"] for r in table.filter((F.col("kind") > 0) & (F.col("key") <= FIT)).collect()}
    for c in hot_counts[(hot_counts > 0) & (hot_counts <= FIT)].tolist():
        small[1, c] = small.get((1, c), 0) + 1
    single = discounts({r: n for (kind, r), n in small.items() if kind == 1})
    pair = discounts({r: n for (kind, r), n in small.items() if kind == 2})

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key * n), pa.array(n), pa.array((key - single(key)) * n)], ["tokens", "types", "left"]
            )

    sums = table.filter("kind = 1").select("key", "n").mapInArrow(left, "tokens long, types long, left double")
    tokens, types, rest = sums.agg(F.sum("tokens"), F.sum("types"), F.sum("left")).first()
    tokens, types = (tokens or 0) + int(hot_counts.sum()), (types or 0) + int((hot_counts > 0).sum())
    rest = (rest or 0.0) + float((hot_counts - single(hot_counts)).sum())
    model = Model(folder, buckets, tokens, types, rows, rest / tokens if tokens else 1.0, single, pair, hot, hot_counts)
    store_contexts(pairs, model)
    return model


def store_contexts(pairs: DataFrame, model: Model) -> None:
    """The table of contexts: for each the count and the logarithm of the mass it hands down, times its count."""
    buckets, pair = model.buckets, model.pair

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                word, context, n = (
                    batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("word", "context", "n")
                )
                word, context = word.astype(np.uint64), context.astype(np.uint64)
                words, where = np.unique(word, return_inverse=True)
                totals = model.totals(words, np.bincount(where, n, len(words)).astype(np.int64))
                key, left, taken = sums_by(context, n - pair(n), model.p(totals)[where])
                bucket = spread(key, key, np.zeros(0, np.uint64), buckets)
                for b, at in in_buckets(bucket, np.arange(len(key))):
                    block = packed(key[at], left[at], taken[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([0], pa.int64()), pa.array([block], pa.binary())],
                        ["bucket", "slice", "block"],
                    )

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        blocks = [unpacked(b, "<u8", "<f8", "<f8") for b in group.column("block").to_pylist()]
        context, left, taken = sums_by(*(np.concatenate(x) for x in zip(*blocks, strict=True)))
        # The unknown word is never seen after a context: what is free is at least its mass.
        free = np.maximum(1 - taken, model.unknown)
        columns = {"context": context.astype(np.int64), "handed": np.log10(left / free)}
        return runs(key[0].as_py(), context, columns, {"context": pa.int64(), "handed": pa.float64()})

    blocks = pairs.select("word", "context", "n").mapInArrow(partial, BLOCKS)
    table = blocks.groupBy("bucket").applyInArrow(merged, "bucket int, run int, context array<long>, handed array<double>")
    table.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{model.folder}/contexts")


# Evaluation -------------------------------------------------------------


class Bucket:
    """One bucket of pairs, ready for look-ups."""

    def __init__(self, model: Model, bucket: int):
        word, context, n = table_of(model.folder, "pairs", bucket, "word", "context", "n")
        word, context = word.astype(np.uint64), context.astype(np.uint64)
        self.n = n
        self.words, where = np.unique(word, return_inverse=True)
        self.contexts = np.unique(context)
        # The order of pairs is that of (word, context), so these keys are sorted.
        self.keys = where * max(1, len(self.contexts)) + np.searchsorted(self.contexts, context)
        self.totals = model.totals(self.words, np.bincount(where, n, len(self.words)).astype(np.int64))

    def counts(self, model: Model, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words and of the pairs."""
        if not len(self.words):
            zero = np.zeros(len(word), np.int64)
            return model.totals(word, zero), zero
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        beside = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.words[at] == word
        key = at * len(self.contexts) + beside
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        seen = known & (self.contexts[beside] == context) & (self.keys[place] == key)
        return model.totals(word, np.where(known, self.totals[at], 0)), np.where(seen, self.n[place], 0)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row.

    ``base_score`` is that of single words with a half added to each count.
    """
    types = {c: docs.schema[c].dataType.simpleString() for c in keep}
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    row_type = f"struct<{','.join(f'`{c}`:{t}' for c, t in types.items())}>"
    buckets = model.buckets
    shared = docs.sparkSession.sparkContext.broadcast(model)  # scalars and the bounded list of hot words

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, number = shared.value.hot, TaskContext.get().partitionId() << 32
        for part in slices(batches, "__text", SLICE):
            found = tokens_of(utf8(part, "__text"))
            width = len(found.hashes)
            key, order = np.unique(found.context * width + found.word, return_inverse=True)
            each, n = np.unique(order * len(part) + found.doc, return_counts=True)
            pair, doc = key[each // len(part)], each % len(part)
            word, context = found.hashes[pair % width], found.hashes[pair // width]
            kept = pa.StructArray.from_arrays([part.column(c) for c in keep], names=list(keep))
            kind = pa.list_(kept.type)
            for b, at in in_buckets(spread(word, context, hot, buckets), np.lexsort((context, word))):
                block = packed(word[at], context[at], doc[at].astype(np.uint32), n[at].astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([block], pa.binary()), pa.nulls(1, kind)],
                    ["bucket", "slice", "block", "kept"],
                )
            # The rows themselves: negative buckets, spread like the others.
            listed = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - number % buckets], pa.int32()), pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), listed],
                ["bucket", "slice", "block", "kept"],
            )
            number += 1

    sent = rows.mapInArrow(blocks, f"{BLOCKS}, kept array<{row_type}>")
    sent = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    out = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("block", pa.binary())])
    wide = f"{BLOCKS}, kept array<{row_type}>"

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for each text (bucket -1), what backs off by bucket of its context, and the rows themselves."""
        model, number, table = shared.value, None, None
        for batch in batches:
            kind = batch.schema.field("kept").type
            for at, row in enumerate(batch.select(["bucket", "slice", "block"]).to_pylist()):
                if row["bucket"] < 0:
                    yield batch.slice(at, 1)
                    continue
                if row["bucket"] != number:
                    number = row["bucket"]
                    table = Bucket(model, number)
                word, context, doc, n = unpacked(row["block"], "<u8", "<u8", "<u4", "<u4")
                total, together = table.counts(model, word, context)
                full = np.where(together > 0, model.pair(together), model.p(total))
                as_context = np.where((word != END) & (total > 0), np.log10(np.maximum(total, 1)), 0.0)
                base = np.log10((total + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                value = n * (np.log10(full) - as_context)
                docs, *sums = sums_by(doc, n.astype(np.int64), n * (total > 0), n * base, value)
                rows = [(-1, packed(docs, *(s.astype("<f8") for s in sums)))]
                back = np.flatnonzero(together == 0)
                bucket = spread(context[back], context[back], np.zeros(0, np.uint64), buckets)
                for b, at in in_buckets(bucket, np.argsort(context[back], kind="stable")):
                    rows.append((b, packed(context[back][at], doc[back][at], n[back][at])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([row["slice"]] * len(rows), pa.int64())]
                    + [pa.array([x for _, x in rows], pa.binary()), pa.nulls(len(rows), kind)],
                    ["bucket", "slice", "block", "kept"],
                )

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the contexts of tokens that back off add to each text."""
        model, number = shared.value, None
        context, mass = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != number:
                    number = row["bucket"]
                    context, mass = table_of(model.folder, "contexts", number, "context", "handed")
                    context = context.astype(np.uint64)
                own, doc, n = unpacked(row["block"], "<u8", "<u4", "<u4")
                value = np.zeros(len(own))
                if len(context):
                    at = np.minimum(np.searchsorted(context, own), len(context) - 1)
                    value = np.where(context[at] == own, n * mass[at], 0.0)
                docs, sums = sums_by(doc, value)
                zero = np.zeros(len(docs))
                block = packed(docs, zero, zero, zero, sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([row["slice"]], pa.int64()), pa.array([block], pa.binary())], schema=out
                )

    evaluated = sent.mapInArrow(seen, wide)
    backed = evaluated.filter("bucket >= 0").drop("kept").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    backed = backed.mapInArrow(handed, BLOCKS).withColumn("kept", F.lit(None).cast(f"array<{row_type}>"))
    parts = evaluated.filter("bucket < 0").unionByName(backed).select("slice", "block", "kept")
    names = ["n_tokens", "n_known", "base_score", "score"]

    def summed(key: tuple, group: pa.Table) -> pa.Table:
        kept = group.column("kept").combine_chunks().drop_null().flatten()
        total = np.zeros((4, len(kept)))
        for block in group.column("block").drop_null().to_pylist():
            docs, *sums = unpacked(block, "<u4", "<f8", "<f8", "<f8", "<f8")
            total[:, docs] += sums
        # Each text's first context is the start mark, which is no word: its count is that of the texts.
        if model.texts:
            total[3] -= np.log10(model.texts)
        columns = [kept.field(c) for c in keep] + [pa.array(total[i].astype(np.int64)) for i in (0, 1)]
        return pa.table([*columns, pa.array(total[2]), pa.array(total[3])], [*keep, *names])

    ddl = "".join(f"`{c}` {t}, " for c, t in types.items())
    return parts.groupBy("slice").applyInArrow(summed, f"{ddl}n_tokens long, n_known long, base_score double, score double")
