"""Raw feed files: scan, sniffed decompression, streaming pickup, layout."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The schema of Spark's binary file source; a stream has to name it.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Fixed value: the first two bytes of every gzip stream.
_GZIP_MAGIC = b"\x1f\x8b"


_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")


def _text(raw: bytes | None, charset: str | None) -> tuple[str | None, str | None]:
    """Text of a file, gunzipped if it is gzip, and what is wrong with it if it has none."""
    if raw is None:
        return None, "no content"
    try:
        body = gzip.decompress(raw) if bytes(raw[:2]) == _GZIP_MAGIC else bytes(raw)
    except (OSError, EOFError, zlib.error) as bad:
        return None, f"gzip: {bad}"
    declared = _DECLARED.match(body[:200])
    marked = next((name for mark, name in _MARKS if body.startswith(mark)), None)
    name = marked or charset or (declared.group(1).decode() if declared else "utf-8")
    try:
        return body.decode(name).removeprefix("\ufeff"), None
    except (LookupError, UnicodeError) as bad:
        return None, f"charset: {bad}"


@F.arrow_udf(T.StructType([T.StructField("doc", T.StringType()), T.StructField("error", T.StringType())]))
def _decoded(content: pa.Array, charset: pa.Array) -> pa.Array:
    told = [_text(raw.as_py(), name.as_py()) for raw, name in zip(content, charset, strict=True)]
    return pa.array([{"doc": doc, "error": error} for doc, error in told], pa.struct([("doc", pa.string()), ("error", pa.string())]))


def decoded(content: Column, charset: str | None = None) -> Column:
    """``doc`` and ``error`` of a raw feed file; a damaged one has no ``doc``.

    The charset is that of the byte order mark, else the one given, else the
    one its XML declaration names, else UTF-8.
    """
    return _decoded(content, F.lit(charset).cast("string"))


def document_text(content: Column, charset: str | None = None) -> Column:
    """Text of a raw feed file, without a byte order mark; null where it cannot be read (see ``decoded``)."""
    return decoded(content, charset)["doc"]


# Characters of text a Python task holds at once; a longer file is held alone.
SLICE = 4 << 20


def documents(
    raw: DataFrame, keep: tuple[str, ...] = (), charset: str | None = None, content: str = "content"
) -> DataFrame:
    """``keep``, ``doc`` and ``error`` of raw feed files: :func:`decoded` for tables of any size.

    A batch of packed files is many times as large unpacked, so its texts leave
    Python in slices.
    """
    told = [T.StructField("doc", T.StringType()), T.StructField("error", T.StringType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, files = batch.select(list(keep)), batch.column(content)
            start, texts, size = 0, [], 0
            for n in range(batch.num_rows):
                texts.append(_text(files[n].as_py(), charset))
                size += len(texts[-1][0] or "")
                if size >= SLICE or n + 1 == batch.num_rows:
                    found = [pa.array(column, pa.string()) for column in zip(*texts, strict=True)]
                    held = kept.slice(start, len(texts)).columns
                    yield pa.RecordBatch.from_arrays([*held, *found], [*keep, "doc", "error"])
                    start, texts, size = n + 1, [], 0

    schema = T.StructType([*[raw.schema[c] for c in keep], *told])
    return raw.select(*keep, content).mapInArrow(read, schema)


def read_raw(
    spark: SparkSession, path: str | list[str], glob: str | None = None, text: bool = False
) -> DataFrame:
    """One row per stored file: ``path, modificationTime, length, content``.

    Any URI Spark knows works (``file:``, ``s3a:``, ``hdfs:``).  Content is
    only read when selected, so key listings stay cheap.  With ``text`` the
    content column is replaced by the decompressed ``doc``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _with_text(reader.load(path)) if text else reader.load(path)


def stream_raw(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    max_files: int = 10_000,
    text: bool = False,
) -> DataFrame:
    """The streaming form of :func:`read_raw`: each new file once."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(RAW_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _with_text(reader.load(path)) if text else reader.load(path)


def _with_text(raw: DataFrame) -> DataFrame:
    return documents(raw, ("path", "length")).drop("error")


def read_pages(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Captured HTML pages as ``path, html``, one row per file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )


def object_key(source: Column, name: Column) -> Column:
    """Key of a stored object, ``<source>/<file>``; just the file without a source."""
    return F.concat_ws("/", F.nullif(source, F.lit("")), name)


def write_raw(batch: DataFrame, path: str, batch_id: str) -> None:
    """Store one batch of raw objects below its own ``batch_id``.

    A replayed batch replaces only what it wrote itself.
    """
    (
        batch.drop("batch_id")
        .write.mode("overwrite")
        .partitionBy("source")
        .parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    )


def current_objects(raw_zone: DataFrame, key: str = "key", order: str = "batch_id") -> DataFrame:
    """The latest upload of each key, as an overwriting store would hold it."""
    from feedline.operators.dedup import dedup_last

    return dedup_last(raw_zone, [key], [order])
