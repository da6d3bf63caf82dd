"""SentencePiece ids by a table of distinct chunks.

Where no piece of a model holds a white space mark behind another character, no
merge crosses such a place: the normalised text falls into marked words (marks,
then what follows them) that are segmented apart.  Natural text repeats its words,
so every distinct marked word is segmented once, by the library, and the ids are
put back by position: words become codes, codes become runs of ids.

The table belongs to a task and is begun anew when it holds ``TABLE`` bytes, so
memory is bounded and nothing is shuffled.  One table over all documents would
have to send every word of every task and its ids there and back.

Whole texts are normalised by the library; texts longer than ``SEGMENT`` are looked
up in segments that end between marked words.  A model whose pieces cross marks, or
whose normaliser changes a marked word that stands alone, is refused.

Null texts are empty.  Rows are independent; equal rows give equal rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
from public_tokenizers import path as public_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedline.llm.common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SEGMENT = 1 << 20
# Bytes of words and ids after which a task begins a new table.
TABLE = 128 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_BETWEEN = re.compile(f"[^{MARK}](?={MARK})")


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if its marked words can be segmented apart."""
    found = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(found.id_to_piece, range(found.get_piece_size())) if _CROSSING.search(p)]
    if crossing:
        raise ValueError(f"pieces cross white space marks: {crossing[:3]}")
    return found


class ChunkTable:
    """Ids of distinct marked words, each segmented once."""

    def __init__(self, path: str) -> None:
        self.model = processor(path)
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.ends, self.size, self.held = array("i"), array("q", [0]), 0, 0

    def add(self, words: list[str]) -> None:
        """Segment words that are not in the table."""
        # A word's first mark is the one the normaliser puts before any text.
        alone = [w[1:].replace(MARK, " ") for w in words]
        # A single mark stands only at the end of a text and has nothing behind it to keep the prefix.
        single = [n for n, w in enumerate(words) if w == MARK]
        for n in single:
            alone[n] = "a "
        changed = [w for w, t, n in zip(words, alone, self.model.normalize(alone), strict=True) if n != w and t != "a "]
        if changed:
            raise ValueError(f"the normaliser changes words that stand alone: {changed[:3]}")
        found = self.model.encode(alone, num_threads=1)
        for n in single:
            found[n] = found[n][len(self.model.encode("a")) :]
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)), strict=True))
        self.ends.extend(accumulate(map(len, found), initial=self.ends.pop()))
        self.ids.extend(chain.from_iterable(found))
        self.size += 120 * len(words) + 4 * sum(map(len, words)) + 4 * (len(self.ids) - self.held)
        self.held = len(self.ids)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.size > TABLE:
            self.clear()
        self.add([w for w in distinct if w not in self.codes])
        own = np.array([self.codes[w] for w in distinct], np.int64)[coded.indices.to_numpy()]
        ids, ends = np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64)
        begins, sizes = ends[own], ends[own + 1] - ends[own]
        # Position p of the result lies as far behind its word's first id as behind the word's first position.
        shift = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        return ids[np.arange(len(shift)) + shift], sizes


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The normalised text in pieces of about ``size`` that end between marked words."""
    begin = 0
    while begin < len(text):
        cut = _BETWEEN.search(text, begin + size - 1) if begin + size < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[begin:end]
        begin = end


def ids_of(texts: list[str], table: ChunkTable, last: list[int]) -> list[np.ndarray]:
    """Ids of every text, ``last`` put behind them."""
    found, short = [None] * len(texts), []
    end = np.array(last, np.int32)
    for n, text in enumerate(table.model.normalize(texts)):
        if len(text) > SEGMENT:
            parts = [table.lookup(_CHUNK.findall(s))[0] for s in segments(text)]
            found[n] = np.concatenate([*parts, end])
        else:
            short.append((n, _CHUNK.findall(text)))
    ids, sizes = table.lookup([w for _, words in short for w in words])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    for n, words in short:
        found[n] = np.concatenate([ids[ends[at] : ends[at + len(words)]], end])
        at += len(words)
    return found


def encode(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str | None = None, add_eos: bool = True
) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int): the library's ids of each row, with the end id if asked for."""
    model = model or public_path(MODEL)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        last = [table.model.eos_id()] if add_eos else []
        for part in slices(batches, "text"):
            lists = ids_of(part.column("text").to_pylist(), table, last)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return rows.mapInArrow(coded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, *, ids: str = "ids", model: str | None = None) -> DataFrame:
    """The same rows with ``decoded``, the library's text of the ids; null ids have none."""
    model = model or public_path(MODEL)
    if "decoded" in encoded.columns:
        raise ValueError("there is a column decoded already")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(ids).to_pylist()
                texts = [None if x is None else processor(model).decode(x) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"]
                )

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(joined, f"{names}, decoded string")


def distinct_chunks(docs: DataFrame, *, text: str = "text", model: str | None = None) -> DataFrame:
    """``chunk``, ``n`` and ``ids``: every marked word of the texts, how often it stands there, and its ids."""
    model = model or public_path(MODEL)
    counted_schema = pa.schema([("chunk", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for body in processor(model).normalize(part.column("text").to_pylist()):
                for piece in segments(body):
                    tally = pa.array(_CHUNK.findall(piece), pa.string()).value_counts()
                    columns = [tally.field("values"), tally.field("counts")]
                    yield pa.RecordBatch.from_arrays(columns, schema=counted_schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for part in slices(batches, "chunk"):
            ids, sizes = table.lookup(part.column("chunk").to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], ["chunk", "n", "ids"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return words.mapInArrow(coded, "chunk string, n long, ids array<int>")
