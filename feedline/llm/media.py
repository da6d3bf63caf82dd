"""Media columns: content-addressed payloads in tar shards.

A text is stored once, as an 8-bit greyscale PNG of fixed width: its UTF-8
bytes, filled up with blanks to whole rows, are the samples.  Images are laid
into tar shards in the shared folder under the SHA-256 of their text; rows carry
digest, shard, offset and length.  Metadata columns come from range reads of the
image header alone; payloads from range reads of the whole image.

A task writes the payloads of its own rows, each once, under shard names of its
own, and only the index that Spark commits names them, so a repeated task leaves
at worst a file nobody refers to.  Payloads never travel: where several tasks
hold copies of a text, the index keeps the first place and the others are unused.

Null texts are empty and are stored as one row of blanks.  Rows are independent
and equal texts share everything but their id.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.llm.common import as_batch, slices, stored, uri, utf8
from feedline.session import new_scratch

WIDTH = 192
SHARD_BYTES = 64 << 20
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Signature, length, type and body of the first chunk.
HEADER_BYTES = 29


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image with one unfiltered row for each ``WIDTH`` bytes."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first bytes of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote, its checksums verified."""
    width, height, _ = png_header(image)
    at, body = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        part = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("the image has filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Average hash: the means of an 8 x 8 grid of equal runs of samples against their median, as 16 hexadecimal digits."""
    samples = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(samples, np.arange(64) * len(samples) // 64, dtype=np.int64)
    sizes = np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    means = cells / sizes
    return np.packbits(means > np.median(means)).tobytes().hex()


INDEX = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "digest string, shard string, offset long, length long"


def write_shards(docs: DataFrame, folder: str, *, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every distinct text below ``folder``; the index is ``digest``, ``shard``, ``offset``, ``length``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base)
        seen: set[bytes] = set()
        out, name, at = None, "", 0
        for part in slices(batches, "text"):
            rows = []
            for body in utf8(part, "text"):
                key = hashlib.sha256(body)
                if key.digest() in seen:
                    continue
                seen.add(key.digest())
                if out is None:
                    name = f"{uuid.uuid4().hex}.tar"
                    out, at = store.open_output_stream(f"{base}/{name}", compression=None), 0
                image = to_png(payload_of(body))
                entry = tarfile.TarInfo(f"{key.hexdigest()}.png")
                entry.size = len(image)
                head = entry.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + image + bytes(-len(image) % 512))
                rows.append((key.hexdigest(), name, at + len(head), len(image)))
                at += len(head) + len(image) + -len(image) % 512
                if at >= shard_bytes:
                    out.write(bytes(1024))
                    out.close()
                    out = None
            if rows:
                yield as_batch(INDEX, *map(list, zip(*rows, strict=True)))
        if out is not None:
            out.write(bytes(1024))
            out.close()

    entries = stored(docs.select(F.col(text).alias("text")).mapInArrow(packed, INDEX_DDL), "media-entries")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return entries.groupBy("digest").agg(place).select("digest", "place.*")


def ranges(index: DataFrame, folder: str, size: int | None, read, schema: pa.Schema, ddl: str) -> DataFrame:
    """``read`` applied to the first ``size`` bytes (all where None) of every entry, shard by shard in offset order."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = []
                for entry in batch.slice(start, 1024).to_pylist():
                    if entry["shard"] != name:
                        if source is not None:
                            source.close()
                        name, source = entry["shard"], store.open_input_file(f"{base}/{entry['shard']}")
                    body = source.read_at(entry["length"] if size is None else min(size, entry["length"]), entry["offset"])
                    rows.append((entry["digest"], *read(body)))
                yield as_batch(schema, *map(list, zip(*rows, strict=True)))
        if source is not None:
            source.close()

    # The index is small for what it stands for: a fixed number of tasks, each with whole shards.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(tasks, "shard").sortWithinPartitions("shard", "offset").mapInArrow(taken, ddl)


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """``digest``, ``width``, ``height``, ``bits`` and ``media_bytes``, by reading the headers alone."""
    schema = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())])
    heads = ranges(index, folder, HEADER_BYTES, png_header, schema, "digest string, width int, height int, bits int")
    return heads.join(index.select("digest", F.col("length").alias("media_bytes")), "digest")


def payloads(index: DataFrame, folder: str) -> DataFrame:
    """``digest`` and what the stored bytes say: sizes, hashes, checksum of the end and feature."""
    schema = pa.schema(
        [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def read(image: bytes) -> tuple:
        body = from_png(image)
        sha = hashlib.sha256
        return (
            len(body),
            sha(body).hexdigest(),
            zlib.crc32(body[-16:]),
            len(image),
            sha(image).hexdigest(),
            feature_of(body),
        )

    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return ranges(index, folder, None, read, schema, ddl)


def media_columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its place in the shards, header metadata and payload columns."""
    spark: SparkSession = docs.sparkSession
    folder = uri(new_scratch(spark, "media"))
    index = write_shards(docs, folder, text=text)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest")
    )
    media = index.join(metadata(index, folder).drop("media_bytes"), "digest").join(payloads(index, folder), "digest")
    return rows.join(media, "digest")
