"""WARC archives: a writer with revisit records and a splittable reader.

The reader gives each task a byte range of an archive.  A task looks for the
gzip magic in its range, accepts a place as the start of a member only if the
bytes there inflate to a WARC header, and from then on goes from member to
member.  It owns the records that start inside its range and reads past its end
to finish the last.  Every record has exactly one owner, and no index is needed.

The writer puts one gzip member for each page.  Of pages with equal payloads of
at least ``min_bytes`` bytes the one with the smallest id is the response; the
others are revisits, which name it and keep the HTTP header but no payload.
Rows that repeat the smallest id with the same payload are all responses; rows
without an id revisit the smallest id there is, or are responses if there is
none.  A task writes an archive under a name of its own, and only the list that
Spark commits names it.

Null payloads are empty.  A null URL leaves the target out.  Ids and URLs are quoted
where they stand in headers.  The reader takes archives of other writers too (one
gzip member for each record): see :func:`parse_record`.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedline.llm.common import as_batch, slices, stored

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 16
# Inflated bytes needed to tell a WARC header.
PROOF = b"WARC/1."


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response, or a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{quote(str(page_id), safe='')}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response"]
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{quote(str(refers_to), safe='')}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is skipped."""
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


FILES = pa.schema([("file", pa.string()), ("bytes", pa.int64())])


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    level: int = 5,
) -> DataFrame:
    """Write every page below ``folder``; ``file`` and ``bytes`` of each archive."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body).alias("digest")
    )
    # Partial minima: a payload that many pages share travels once for each task.
    firsts = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")
    )
    shared = firsts.filter("n > 1").select("digest", "first_id")
    rows = rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to")
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base)
        out, size, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for part in slices(batches, "html"):
            columns = [part.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]
            for page, target, text, refers_to in zip(*columns, strict=True):
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = text.encode()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page, target, payload, base32_sha1(payload), refers_to)) + packer.flush()
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield as_batch(FILES, [name], [size])

    return stored(rows.mapInArrow(written, "file string, bytes long"), "archives")


def members(store: pafs.FileSystem, path: str, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes | None]]:
    """Offset and inflated bytes of the members that start in ``[begin, end)``.

    Where a member cannot be read to its end the bytes are None, and the next
    one is looked for by its magic again.
    """
    with store.open_input_file(path) as source:
        at, known = begin, begin == 0
        data, base = b"", begin  # the bytes at hand and where they start

        def more() -> bool:
            nonlocal data
            got = source.read_at(min(READ_BYTES, size - base - len(data)), base + len(data))
            data += got
            return bool(got)

        while at < end:
            data, base = data[at - base :], at
            if not known:
                found = data.find(MAGIC)
                if found < 0:
                    # The magic may lie across the end of what has been read.
                    keep = min(len(data), len(MAGIC) - 1)
                    at += len(data) - keep
                    data, base = data[len(data) - keep :], at
                    if not more():
                        return
                    continue
                at += found
                if at >= end:
                    return
                data, base = data[found:], at
            unpacker, parts, have, good = zlib.decompressobj(31), [], 0, known
            chunk, reached = data, base + len(data)
            try:
                while True:
                    parts.append(unpacker.decompress(chunk))
                    have += len(parts[-1])
                    if not good and have >= len(PROOF):
                        good = b"".join(parts)[: len(PROOF)] == PROOF
                        if not good:
                            break
                    if unpacker.eof:
                        break
                    chunk = source.read_at(min(READ_BYTES, size - reached), reached)
                    if not chunk:
                        break
                    reached += len(chunk)
            except zlib.error:
                good = False
            if not good or not unpacker.eof:
                if known:
                    yield at, None
                # What was read after the first piece is read again: only a false start does that.
                known, at = False, at + 1
                continue
            known = True
            yield at, b"".join(parts)
            data = unpacker.unused_data
            at = base = reached - len(data)
            if at >= size:
                return


RECORDS = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())]
    + [("target", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
RECORDS_DDL = (
    "file string, offset long, record_type string, record_id string, target string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def whole_number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdecimal() else None


def dechunked(body: bytes) -> bytes | None:
    """The content of a body in chunked transfer coding; None where it is none or is cut short."""
    parts, at = [], 0
    while True:
        line, found, _ = body[at : at + 1024].partition(b"\r\n")
        try:
            size = int(line.split(b";")[0], 16)
        except ValueError:
            return None
        at += len(line) + 2
        if not found or size < 0 or at + size > len(body):
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        at += size + 2


def parse_record(raw: bytes | None) -> tuple:
    """Type, id, target, what it refers to, stated digest, payload size and payload of a record.

    Any kind of WARC 1.0 or 1.1 record; a field it does not state is null.  Blocks
    that are HTTP messages have the body as payload (out of its chunks), others the
    whole block; a revisit has none, its size is the one its header states.  A
    response with fewer bytes than it states, or with others than its SHA-1 says, is
    ``damaged``, as is what has no header.
    """
    head, found, rest = (raw or b"").partition(b"\r\n\r\n")
    named = fields(head)
    kind = named.get("warc-type")
    if not found or kind is None:
        return "damaged", None, None, None, None, None, None
    length = whole_number(named.get("content-length"))
    block = rest if length is None else rest[:length]
    short = length is not None and len(rest) < length
    payload, size = block, len(block)
    if block.startswith(b"HTTP/") or named.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        message = fields(http)
        stated_size = whole_number(message.get("content-length"))
        content = dechunked(body) if message.get("transfer-encoding", "").lower() == "chunked" else None
        payload = body if content is None else content
        size = len(payload) if content is not None or stated_size is None else stated_size
        short = short or len(payload) < size
    algorithm, _, digest = named.get("warc-payload-digest", "").partition(":")
    if kind == "response":
        # Writers differ in whether the digest is that of the chunks or of their content.
        bodies = {payload, body} if block.startswith(b"HTTP/") else {payload}
        checked = algorithm.lower() == "sha1" and len(digest) == 32
        if (short and "warc-truncated" not in named) or (checked and digest.upper() not in map(base32_sha1, bodies)):
            kind = "damaged"
    elif kind == "revisit":
        payload = None
    names = (named.get(n) for n in ("warc-record-id", "warc-target-uri", "warc-refers-to"))
    return kind, *names, digest or None, size, payload


def read_archives(archives: DataFrame, folder: str, *, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """One row for each record of the archives (``file``, ``bytes``), read by byte ranges."""
    parts = archives.filter("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("begin")
    )
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                rows, size = [], 0
                found = members(store, f"{base}/{part['file']}", part["begin"], part["begin"] + range_bytes, part["bytes"])
                for at, raw in found:
                    row = parse_record(raw)
                    rows.append((part["file"], at, *(row if payload else (*row[:-1], None))))
                    size += len(raw or b"") if payload else 0
                    if size > READ_BYTES * 64:
                        yield as_batch(RECORDS, *map(list, zip(*rows, strict=True)))
                        rows, size = [], 0
                if rows:
                    yield as_batch(RECORDS, *map(list, zip(*rows, strict=True)))

    return parts.repartition(tasks, "file", "begin").mapInArrow(read, RECORDS_DDL)


def page_of(column: str, kind: str) -> Column:
    """The page id in a record id; null for a record of another kind of id."""
    found = F.regexp_extract(column, "^<urn:page:(.*)>$", 1)
    return F.when(F.col(column).startswith("<urn:page:"), F.try_url_decode(found)).cast(kind)
