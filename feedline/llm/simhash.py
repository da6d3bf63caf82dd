"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius share at least one.  Fingerprints that meet in a
variant are each paired with the smallest of them, never all with all, and the
pairs are verified.  At most a ball of fingerprints can meet in one variant, and
copies of a text are one fingerprint from the start, so no bucket can be hot.
Where the radius is even, all that meet are within it of each other, so these
pairs connect whatever the pairs of a ball would.

Components come from alternating large-star and small-star steps over the
distinct links.  Each step is written to the shared folder.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows share a component.  Rows without an id belong to the component of
their text; its id is the smallest that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedline.llm.common import LOWER, keyed, slices, stored, utf8

WORDS = 3
RADIUS = 2
SEED = 42
# Text whose shingles, 64 bytes each as bits, are at hand at once.
SLICE = 1 << 20


def fingerprint_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    hashes, digest = [], xxhash.xxh64_intdigest
    for text in texts:
        tokens = text.translate(LOWER).split()
        if len(tokens) >= words:
            shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        else:
            shingles = [b" ".join(tokens)] if tokens else []
        hashes.append(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))
    sizes = np.array([len(h) for h in hashes], np.int64)
    prints = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        bits = np.unpackbits(np.concatenate(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begins = (np.cumsum(sizes) - sizes)[filled]
        sums = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        set_bits = (2 * sums > sizes[filled, None]).astype(np.uint8)
        prints[filled] = np.packbits(set_bits, axis=1).view(">u8").ravel()
    return prints


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text) and ``print``, the fingerprint as a signed long."""
    rows = keyed(docs, doc_id=doc_id, text=text)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            prints = pa.array(fingerprint_of(utf8(part, "text"), words).view(np.int64))
            columns = [part.column("doc_id"), part.column("text_key"), prints]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "print"])

    return rows.mapInArrow(printed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, print long")


def ball(half: int) -> list[int]:
    """Signed masks of at most ``half`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Verified pairs ``a < b`` of distinct fingerprints that connect all within an even ``radius``."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: the ball is half of it")
    distinct = prints.select("print").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = distinct.select("print", F.explode(masks).alias("mask"))
    variants = variants.select(F.col("print").bitwiseXOR(F.col("mask")).alias("variant"), "print")
    met = variants.groupBy("variant").agg(F.min("print").alias("a"), F.collect_set("print").alias("all"))
    pairs = met.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a < b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, for every node of ``edges`` (``a``, ``b``).

    A large star moves a node's larger neighbours to its smallest neighbour, a
    small star the smaller ones; both keep what is connected, and the links
    settle as one star for each component after a logarithmic number of steps.
    """

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))

    def star(adjacent: DataFrame, large: bool) -> DataFrame:
        least = adjacent.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        joined = adjacent.join(least, "u")
        moved = joined.filter("v > u") if large else joined
        pairs = moved.select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
        if not large:
            pairs = pairs.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return pairs.filter("a < b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = state(pairs)
    while before[0]:
        larger = star(both_ways(pairs), large=True)
        smaller = larger.select(F.col("b").alias("u"), F.col("a").alias("v"))
        pairs = stored(star(smaller, large=False), "links")
        after = state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select("a").distinct()
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select("a", "a"))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """``doc_id``, ``text_key``, ``fingerprint`` (16 hexadecimal digits), ``root`` and ``component_id`` of every row.

    ``root`` is the smallest fingerprint of the component and tells components
    apart even where ids are null or repeated.
    """
    prints = stored(fingerprints(docs, doc_id=doc_id, text=text, words=words), "prints")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    found = components(links(prints, radius=radius))
    rooted = firsts.join(found, firsts["print"] == found["node"], "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.select("print", "root").join(least, "root")
    hexadecimal = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(members, "print").select(
        "doc_id", "text_key", hexadecimal.alias("fingerprint"), "root", "component_id"
    )
