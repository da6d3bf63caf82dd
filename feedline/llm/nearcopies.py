"""Near copies: texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more.

SimHash prints of the five-word shingles find the first candidates, by the ball hashing
of :mod:`feedline.llm.simhash`: texts of one print, and each print with the smallest one
within its radius.  No radius over a print reaches 0.8, so an exact prefix-filter join
finds the rest, between texts that are not connected by then.  All texts list their shingles in
one order, common ones last.  Two texts x and y, y not larger, that are 0.8 alike share
a shingle that is among the first fifth of x and the first ninth of y (each rounded
down, plus one); so only these are posted, only a ninth can be met, and what many
texts share (a template, a banner) is not posted at all while a text has enough of
its own.  Sizes, and the places of the shingle that is met, rule out most of what
still meets.  Every candidate is verified on the whole sets; only verified pairs are
links, and none that is 0.8 alike is passed over.

How common a shingle is comes from a share of the texts.  It decides the order alone,
and with it the time, never the result.

Copies of a text are one text from the start.  Texts that meet are first each paired
with one centre, in a few rounds; then all candidate pairs between texts that are not
connected yet are verified.  A group of near copies is so never paired all with all.

Texts without words are copies of each other; one of fewer words than a shingle has
one shingle, the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedline.llm import simhash
from feedline.llm.common import LOWER, keyed, slices, stored, utf8
from feedline.llm.simhash import components

WORDS = 5
# Least similarity as a fraction, so that the comparison is exact.
SIMILAR, OF = 4, 5
# Shares of a text's shingles that are posted: to look up, and to be met.
PROBE, INDEX = 5, 9
# Text whose shingles are at hand at once.
SLICE = 1 << 18
# Texts that are counted for the order: one in so many, but so many at least; and the shingles kept.
ONE_IN, AT_LEAST, COMMON = 8, 1 << 15, 1 << 19
# So many unconnected pairs for each text are looked at at once; rounds of centres before all are.
FEW, ROUNDS = 4, 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
# The one shingle of a text without words.
_NONE = np.array([1], np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens, digest = text.translate(LOWER).split(), xxhash.xxh64_intdigest
    if not tokens:
        return _NONE
    hashes = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    found = np.full(len(tokens) - width + 1, width, np.uint64)
    for i in range(width):
        found = found * _MIX + hashes[i : len(tokens) - width + 1 + i]
    return np.unique((found ^ (found >> np.uint64(32))) * _FOLD)


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task whose text it has not had yet; other tasks may have copies."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for n, key in enumerate(batch.column("text_key").to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append(n)
        if new:
            yield batch.take(pa.array(new))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the counted texts have, sorted, and how common each is (bits of its count)."""
    n = texts.select(F.approx_count_distinct("text_key")).first()[0]
    share = min(1.0, max(1 / ONE_IN, AT_LEAST / max(n, 1)))
    some = texts.filter(F.xxhash64("text_key") / F.lit(2.0**64) + 0.5 <= share)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(unseen(batches), "text", SLICE):
            sets = [shingles(t).view(np.int64) for t in utf8(part, "text")]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column("text_key"), lists], ["text_key", "hashes"])

    one_each = some.mapInArrow(listed, "text_key long, hashes array<long>").dropDuplicates(["text_key"])
    counts = one_each.select(F.explode("hashes").alias("h")).groupBy("h").count().filter("count > 1")
    table = counts.orderBy(F.desc("count"), "h").limit(COMMON).toArrow().sort_by("h")
    hashes = table.column("h").to_numpy().astype(np.int64)
    return hashes, np.log2(table.column("count").to_numpy().astype(float) + 1).astype(np.uint8)


def prefixes(texts: DataFrame) -> DataFrame:
    """``text_key``, ``n`` and ``prefix``, the shingles to post, in order, of every distinct text."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes = shared.value
        for part in slices(unseen(batches), "text", SLICE):
            found, sizes = [], []
            for text in utf8(part, "text"):
                own = shingles(text).view(np.int64)
                rank = np.zeros(len(own), np.uint8)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    rank = np.where(hashes[at] == own, classes[at], 0)
                sizes.append(len(own))
                found.append(own[np.lexsort((own, rank))[: len(own) // PROBE + 1]])
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            columns = [part.column("text_key"), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "n", "prefix"])

    rows = texts.mapInArrow(cut, "text_key long, n long, prefix array<long>")
    return rows.dropDuplicates(["text_key"])


def may_link(x: str, y: str) -> Column:
    """Whether the smaller of two posted texts could be met at this shingle and both could be alike enough."""
    nx, ny, kx, ky, px, py = (F.col(f"{s}.{c}") for c in ("n", "text_key", "pos") for s in (x, y))
    y_smaller = (ny < nx) | ((ny == nx) & (ky < kx))
    met = F.when(y_smaller, py * INDEX <= ny).otherwise(px * INDEX <= nx)
    sizes = (OF * F.least(nx, ny) >= SIMILAR * F.greatest(nx, ny))
    # All that is left from this shingle on must hold the overlap that 0.8 needs.
    left = (SIMILAR + OF) * F.least(nx - px, ny - py) >= SIMILAR * (nx + ny)
    return met & sizes & left


@lru_cache(maxsize=32)
def _held(text: bytes) -> np.ndarray:
    return shingles(text)


def similar(a: bytes, b: bytes) -> bool:
    """Whether the shingle sets are at least ``SIMILAR`` / ``OF`` alike."""
    left, right = _held(a), _held(b)
    if OF * min(len(left), len(right)) < SIMILAR * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return OF * both >= SIMILAR * (len(left) + len(right) - both)


def verified(pairs: DataFrame, docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of text keys that are near copies."""
    needed = stored(pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct(), "needed")
    rows = keyed(docs, doc_id=doc_id, text=text).select("text_key", "text").join(needed, "text_key", "left_semi")
    texts = rows.mapInArrow(unseen, "text_key long, text string")
    texts = stored(texts.dropDuplicates(["text_key"]), "texts")
    of_a = texts.select(F.col("text_key").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("text_key").alias("b"), F.col("text").alias("text_b"))

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a"):
            same = map(similar, utf8(part, "text_a"), utf8(part, "text_b"))
            yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return pairs.join(of_a, "a").join(of_b, "b").mapInArrow(proved, "a long, b long")


def print_pairs(docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """Pairs ``a < b`` of text keys of one print or of near ones, at most one for each text and one for each print."""
    found = simhash.fingerprints(docs, doc_id=doc_id, text=text, words=WORDS)
    prints = stored(found.select("text_key", "print").distinct(), "prints")
    firsts = stored(prints.groupBy("print").agg(F.min("text_key").alias("first")), "firsts")
    same = prints.join(firsts, "print").select(F.col("first").alias("a"), F.col("text_key").alias("b"))
    near = simhash.links(firsts).groupBy("b").agg(F.min("a").alias("a"))
    of_a = firsts.select(F.col("print").alias("a"), F.col("first").alias("first_a"))
    of_b = firsts.select(F.col("print").alias("b"), F.col("first").alias("first_b"))
    near = near.join(of_a, "a").join(of_b, "b").select("first_a", "first_b")
    x, y = F.col("a"), F.col("b")
    return same.union(near).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()


def shared_postings(texts: DataFrame) -> DataFrame:
    """``h``, ``text_key``, ``n`` and ``pos`` where several texts post a shingle and one of them can be met."""
    posted = texts.select("text_key", "n", F.posexplode("prefix").alias("pos", "h"))
    counts = posted.groupBy("h").agg(F.count("*").alias("c"), F.max(F.col("pos") * INDEX <= F.col("n")).alias("met"))
    return posted.join(counts.filter("c > 1 AND met").select("h"), "h", "left_semi")


def open_postings(posted: DataFrame, found: DataFrame | None) -> DataFrame:
    """The postings with their ``root``, of the shingles that still join several groups."""
    if found is None:
        rooted = posted.withColumn("root", F.col("text_key"))
    else:
        rooted = posted.join(found, posted["text_key"] == found["node"], "left")
        rooted = rooted.select(*posted.columns, F.coalesce("root", "text_key").alias("root"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return stored(rooted.join(mixed.select("h"), "h", "left_semi"), "open")


def centre_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Every member of a shingle with the shingle's centre, where they may be alike."""
    order = F.struct(F.xxhash64("text_key", F.lit(turn)), "text_key", "n", "pos", "root")
    met = F.col("pos") * INDEX <= F.col("n")
    centres = members.filter(met).groupBy("h").agg(F.min(order).alias("c"))
    centres = stored(centres.select("h", "c.text_key", "c.n", "c.pos", "c.root"), "centres")
    return members.alias("x").join(centres.alias("y"), "h").filter((F.col("x.root") != F.col("y.root")) & may_link("x", "y"))


def all_pairs(members: DataFrame) -> DataFrame:
    """Every two members of a shingle of different groups that may be alike, by classes of size."""
    sized = members.withColumn("size", F.length(F.bin("n")))
    looked = sized.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    met = sized.filter(F.col("pos") * INDEX <= F.col("n"))
    smaller = F.struct("y.n", "y.text_key") < F.struct("x.n", "x.text_key")
    apart = F.col("x.root") != F.col("y.root")
    return looked.alias("x").join(met.alias("y"), ["h", "size"]).filter(apart & smaller & may_link("x", "y"))


def links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame | None:
    """``node`` and ``root`` of every text key that has a near copy, or None where none has."""
    rows = keyed(docs, doc_id=doc_id, text=text).select("text_key", "text")
    texts = stored(prefixes(rows), "prefixes")
    posted = stored(shared_postings(texts), "postings")
    most = few * texts.count()
    checked = stored(print_pairs(docs, doc_id=doc_id, text=text), "pairs")
    joined = stored(verified(checked, docs, doc_id=doc_id, text=text), "verified")
    found, turn = None if joined.isEmpty() else stored(components(joined), "roots"), 0
    while True:
        members = open_postings(posted, found)
        groups = members.groupBy("h", "root").agg(F.count("*").cast("double").alias("n"))
        totals = groups.groupBy("h").agg((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)).alias("twice"))
        left = (totals.agg(F.sum("twice")).first()[0] or 0) / 2
        if not left:
            return found
        last = left <= most or turn >= ROUNDS or (turn > 0 and not fresh_links)
        pairs = all_pairs(members) if last else centre_pairs(members, turn)
        x, y = F.col("x.text_key"), F.col("y.text_key")
        pairs = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
        pairs = stored(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        fresh = stored(verified(pairs, docs, doc_id=doc_id, text=text), "verified")
        fresh_links = fresh.count()
        joined, checked = joined.union(fresh), checked.union(pairs)
        if fresh_links:
            found = stored(components(joined), "roots")
        if last:
            return found
        turn += 1


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``root`` and ``component_id``, the smallest id of the group, of every row."""
    rows = keyed(docs, doc_id=doc_id, text=text, keep=False)
    found = links(docs, doc_id=doc_id, text=text)
    if found is None:
        rooted = rows.withColumn("root", F.col("text_key"))
    else:
        rooted = rows.join(found, rows["text_key"] == found["node"], "left")
        rooted = rooted.select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "text_key", "root", "component_id")
