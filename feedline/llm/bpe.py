"""Byte-level BPE over whole texts by overlapping chunks.

Texts of at most ``chunk`` characters are encoded where they stand.  A longer
text is cut into chunks that each carry ``overlap`` more characters than they
own.  Chunks are pre-tokenised in parallel; two neighbours agree from the first
pre-token start that both find in the overlap, since what follows a pre-token
start depends on the text after it alone.  Pieces between those places are
encoded apart and put together in order.  Where two neighbours agree nowhere (a
run longer than the overlap), the text from there on is one piece.  A place
counts only if the character before it is not white space, because white space
looks at what follows it.

Null texts are empty.  Rows are independent; equal rows give equal rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from public_tokenizers import PATTERN
from public_tokenizers import path as public_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedline.llm.common import as_batch, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 16
OVERLAP = 1024
# Longest pre-token text that the characters after it can still change.
MARGIN = 8


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str, vocab: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return encoding(vocab).encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def starts_between(text: str, low: int, high: int) -> list[int]:
    """Pre-token starts in ``[low, high)`` that follow a visible character."""
    starts = (m.start() for m in regex.finditer(PATTERN, text))
    return [s for s in starts if low <= s < high and (s == 0 or not text[s - 1].isspace())]


def encode(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    vocab: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id`` and ``ids``: the token ids of each row as little-endian unsigned 32-bit integers."""
    if not MARGIN < overlap < chunk:
        raise ValueError("the overlap must be longer than the margin and shorter than the chunk")
    vocab = vocab or public_path(VOCABULARY)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = [ids_of(t, vocab) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    whole = rows.filter(F.length("text") <= chunk).mapInArrow(short, f"doc_id {kind}, ids binary")
    long = rows.filter(F.length("text") > chunk).withColumn("text_key", F.sha2("text", 256))
    texts = encode_long(long.select("text_key", "text").dropDuplicates(["text_key"]), vocab, chunk, overlap)
    return whole.unionByName(long.select("doc_id", "text_key").join(texts, "text_key").select("doc_id", "ids"))


def encode_long(texts: DataFrame, vocab: str, chunk: int, overlap: int) -> DataFrame:
    """``text_key`` and ``ids`` of long texts, one row for each key."""
    cut_schema = pa.schema([("text_key", pa.string()), ("n", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for key, body in zip(part.column("text_key").to_pylist(), part.column("text").to_pylist(), strict=True):
                for n, at in enumerate(range(0, len(body), chunk)):
                    yield as_batch(cut_schema, [key], [n], [at + chunk >= len(body)], [body[at : at + chunk + overlap]])

    edge_schema = pa.schema([("text_key", pa.string()), ("border", pa.int32()), ("starts", pa.list_(pa.int32()))])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for row in part.to_pylist():
                # The end of the text is a true end; only a cut end hides what follows.
                sure = len(row["text"]) - (0 if row["last"] else MARGIN)
                if row["n"]:
                    found = starts_between(row["text"], 1, min(sure, overlap))
                    yield as_batch(edge_schema, [row["text_key"]], [row["n"]], [found])
                if not row["last"]:
                    # The next chunk owns the rest: its text ends where this one does, or before.
                    found = [s - chunk for s in starts_between(row["text"], chunk + 1, sure)]
                    yield as_batch(edge_schema, [row["text_key"]], [row["n"] + 1], [found])

    chunks = texts.mapInArrow(cut, "text_key string, n int, last boolean, text string")
    chunks = chunks.repartition("text_key", "n")
    found = chunks.mapInArrow(edges, "text_key string, border int, starts array<int>")
    borders = found.groupBy("text_key", "border").agg(
        F.array_min(F.array_intersect(F.min("starts"), F.max("starts"))).alias("at")
    )
    first_bad = borders.filter("at IS NULL").groupBy("text_key").agg(F.min("border").alias("bad"))
    borders = borders.join(first_bad, "text_key", "left").filter("bad IS NULL OR border < bad")
    begins = borders.select("text_key", F.col("border").alias("n"), F.col("at").alias("begin"))
    ends = borders.select("text_key", (F.col("border") - 1).alias("n"), F.col("at").alias("end"))
    own = (
        chunks.join(begins, ["text_key", "n"], "left")
        .join(ends, ["text_key", "n"], "left")
        .join(first_bad, "text_key", "left")
    )
    begin, end = F.coalesce("begin", F.lit(0)), F.coalesce("end", F.lit(0)) + chunk
    own = own.select(
        "text_key",
        F.least("n", F.coalesce(F.col("bad") - 1, "n")).alias("piece"),
        "n",
        F.substring("text", begin + 1, end - begin).alias("text"),
    )
    piece_schema = pa.schema([("text_key", pa.string()), ("piece", pa.int32()), ("ids", pa.binary())])

    def piece(key: tuple, group: pa.Table) -> pa.Table:
        body = "".join(group.sort_by("n").column("text").to_pylist())
        return pa.Table.from_batches([as_batch(piece_schema, [key[0].as_py()], [key[1].as_py()], [ids_of(body, vocab)])])

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        body = b"".join(group.sort_by("piece").column("ids").to_pylist())
        return pa.table({"text_key": pa.array([key[0].as_py()], pa.string()), "ids": pa.array([body], pa.binary())})

    pieces = own.groupBy("text_key", "piece").applyInArrow(piece, "text_key string, piece int, ids binary")
    return pieces.groupBy("text_key").applyInArrow(whole, "text_key string, ids binary")


def decode(encoded: DataFrame, *, vocab: str | None = None) -> DataFrame:
    """The same rows with ``bytes``: the raw bytes of ``ids``, token after token."""
    vocab = vocab or public_path(VOCABULARY)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            bodies = [
                encoding(vocab).decode_bytes(np.frombuffer(ids, "<u4").tolist()) for ids in part.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary())], [*part.schema.names, "bytes"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(joined, f"{names}, bytes binary")


def lengths(docs: DataFrame, *, text: str = "text", vocab: str | None = None) -> DataFrame:
    """``n_tokens`` of each row, without the ids."""
    vocab = vocab or public_path(VOCABULARY)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            sizes = [len(encoding(vocab).encode_to_numpy(t, disallowed_special=())) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(counted, "n_tokens long")
