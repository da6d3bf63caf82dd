"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents; it labels every byte of a text, and a document's
probabilities are the means over its bytes.

A text is read whole, in spans of ``span`` bytes from which the state starts
anew in both directions, so spans of many documents advance together as one
matrix.  Gates and candidates use ``x / (1 + |x|)``, which costs a fraction of
the exponential forms.

The sample: at most ``per_class`` documents of each label, those with the
smallest text hashes, copies counted once, and ``windows`` windows of each.  Nothing of it depends on
id or source.  Labels are the distinct labels of the training rows.

Null texts and texts without a letter are ``und`` with score 0; so is every text
where no training row has a label.  Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedline.llm.common import slices, utf8

UNKNOWN = "und"
HIDDEN = 8
SPAN = 128
BLOCK = 2048
PER_CLASS = 256
WINDOWS = 8
WINDOW = 64
STEPS = 320
BATCH = 128
RATE = 0.02


@dataclass
class Network:
    """``table``: what each byte adds to update, reset and candidate; ``state``: what the state adds; ``out``, ``bias``: the labeller."""

    labels: list[str]
    table: np.ndarray  # direction, 3, 257, hidden; the last byte is the padding, which is zero
    state: np.ndarray  # direction, 3, hidden, hidden
    out: np.ndarray  # labels, 2 * hidden
    bias: np.ndarray  # labels, 1


def soft(x: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)`` in place of ``x``."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def states(net: Network, way: int, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (time, rows, hidden) of one direction; ``symbols`` is (time, rows), 256 where a row has ended.

    Padding leaves the state at zero, so the backward direction starts at each
    row's true end.
    """
    steps, rows = symbols.shape
    size = net.state.shape[-1]
    tables, weights = net.table[way], net.state[way]
    padded = bool((symbols == 256).any())
    hidden = np.empty((steps, rows, size), np.float32)
    h = np.zeros((rows, size), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        a = [tables[k].take(symbols[t], axis=0) for k in range(3)]
        for k in (0, 1):
            a[k] += h @ weights[k]
        kept = [x.copy() for x in a[:2]] if trace is not None else None
        z, r = soft(a[0]), soft(a[1])
        for g in (z, r):
            g *= 0.5
            g += 0.5
        held = r * h
        a[2] += held @ weights[2]
        b = a[2].copy() if trace is not None else None
        c = soft(a[2])
        new = c - h
        new *= z
        new += h
        if padded:
            new *= (symbols[t] != 256)[:, None]
        if trace is not None:
            trace.append((t, h, kept, z, r, held, b, c))
        h = new
        hidden[t] = h
    return hidden


def probabilities(net: Network, both: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Label probabilities (labels, time * rows) of every position."""
    size = net.state.shape[-1]
    logits = net.out[:, :size] @ both[0].reshape(-1, size).T
    logits += net.out[:, size:] @ both[1].reshape(-1, size).T
    logits += net.bias
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def gradients(net: Network, symbols: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over all positions; ``truth`` has a label number for each row."""
    size, traces = net.state.shape[-1], ([], [])
    both = tuple(states(net, way, symbols, traces[way]) for way in (0, 1))
    error = probabilities(net, both)
    error[np.tile(truth, len(symbols)), np.arange(symbols.size)] -= 1
    error /= symbols.size
    joined = np.concatenate([x.reshape(-1, size) for x in both], axis=1)
    grads = {"out": error @ joined, "bias": error.sum(axis=1, keepdims=True)}
    grads |= {"table": np.zeros_like(net.table), "state": np.zeros_like(net.state)}
    for way in (0, 1):
        down = (error.T @ net.out[:, way * size : (way + 1) * size]).reshape(both[0].shape)
        weights, into, carried = net.state[way], grads["state"][way], 0
        back = np.empty((3, *both[0].shape), np.float32)
        for t, h, (az, ar), z, r, held, b, c in reversed(traces[way]):
            dh = down[t] + carried
            db = dh * z / np.square(1 + np.abs(b))
            dheld = db @ weights[2].T
            dz = dh * (c - h) * 0.5 / np.square(1 + np.abs(az))
            dr = dheld * h * 0.5 / np.square(1 + np.abs(ar))
            carried = dh * (1 - z) + dheld * r + dz @ weights[0].T + dr @ weights[1].T
            into[0] += h.T @ dz
            into[1] += h.T @ dr
            into[2] += held.T @ db
            back[0, t], back[1, t], back[2, t] = dz, dr, db
        order = np.argsort(symbols.ravel(), kind="stable")
        seen, firsts = np.unique(symbols.ravel()[order], return_index=True)
        for k in range(3):
            grads["table"][way, k, seen] = np.add.reduceat(back[k].reshape(-1, size)[order], firsts)
    grads["table"][:, :, 256] = 0
    return grads


def train(windows: list[bytes], truth: list[int], labels: list[str], *, hidden: int = HIDDEN, steps: int = STEPS) -> Network:
    """Fit by Adam on windows of equal length; the random numbers are fixed."""
    random = np.random.default_rng(7)

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    net = Network(
        labels,
        drawn(2, 3, 257, hidden, scale=0.5),
        drawn(2, 3, hidden, hidden, scale=hidden**-0.5),
        drawn(len(labels), 2 * hidden, scale=0.3),
        np.zeros((len(labels), 1), np.float32),
    )
    net.table[:, :, 256] = 0
    symbols = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), -1).astype(np.int64)
    answers = np.array(truth)
    names = ("table", "state", "out", "bias")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        rows = random.integers(0, len(windows), BATCH)
        rate = RATE * (1 - (step - 1) / steps)
        grads = gradients(net, np.ascontiguousarray(symbols[rows].T), answers[rows])
        for n in names:
            first[n] += 0.1 * (grads[n] - first[n])
            second[n] += 0.01 * (np.square(grads[n]) - second[n])
            change = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
            getattr(net, n)[...] -= (rate * change).astype(np.float32)
    return net


def label(net: Network, texts: list[bytes], *, span: int = SPAN) -> np.ndarray:
    """Mean label probabilities (texts, labels) over all bytes of each text; zero where a text is empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = -(-sizes // span)
    owner = np.repeat(np.arange(len(texts)), parts)
    sums = np.zeros((len(texts), len(net.labels)))
    if not len(owner):
        return sums
    begin_part = np.cumsum(parts) - parts
    offset = (np.arange(len(owner)) - begin_part[owner]) * span
    begin = (np.cumsum(sizes) - sizes)[owner] + offset
    length = np.minimum(sizes[owner] - offset, span)
    body = np.append(np.frombuffer(b"".join(texts), np.uint8), np.zeros(span, np.uint8))
    order = np.argsort(-length, kind="stable")  # whole spans first: only the last blocks hold padding
    steps = np.arange(span)[:, None]
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        longest = int(length[rows[0]])
        symbols = body[begin[rows] + steps[:longest]].astype(np.int64)
        inside = steps[:longest] < length[rows]
        symbols[~inside] = 256
        found = probabilities(net, (states(net, 0, symbols), states(net, 1, symbols)))
        if not inside.all():
            found *= inside.ravel()
        np.add.at(sums, owner[rows], found.reshape(len(net.labels), longest, -1).sum(axis=1).T)
    return sums / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, *, text: str, lang: str, per_class: int, windows: int, window: int) -> list[tuple[str, bytes]]:
    """(label, window) pairs of the documents with the smallest text hashes, ``per_class`` for each label at most.

    A first pass counts the distinct texts of each label by their hashes; the
    second drops by hash all but about twice what is wanted before anything is
    sorted.  Copies count once in both, so a label with any text keeps some.  Windows lie
    evenly over the whole text; a shorter text is repeated up to one window.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL")
    body = rows.filter("text IS NOT NULL AND text != ''").withColumn("order", F.xxhash64("text"))
    # One row for each label: as many as the network has outputs.
    counts = body.select("lang", "order").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * per_class + 64) / r["n"]))])
    near = body.filter(F.col("order") / F.lit(2.0**64) + 0.5 <= shares[F.col("lang")]).dropDuplicates(["lang", "order"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= per_class).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, pieces = [], []
            for name, body in zip(part.column("lang").to_pylist(), utf8(part, "text"), strict=True):
                body = body * (-(-window // len(body)))
                for at in sorted({round(x) for x in np.linspace(0, len(body) - window, windows)}):
                    langs.append(name)
                    pieces.append(body[at : at + window])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["lang", "piece"])

    found = chosen.mapInArrow(cut, "lang string, piece binary").collect()
    return sorted((r["lang"], bytes(r["piece"])) for r in found)


def fit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    per_class: int = PER_CLASS,
    windows: int = WINDOWS,
    window: int = WINDOW,
    steps: int = STEPS,
) -> Network | None:
    """The network learned from labelled rows, or None where there are none."""
    pairs = sample(docs, text=text, lang=lang, per_class=per_class, windows=windows, window=window)
    labels = sorted({name for name, _ in pairs})
    if not labels:
        return None
    # Every label weighs the same: the windows of a rare one are repeated.
    by_label = {name: [piece for other, piece in pairs if other == name] for name in labels}
    most = max(map(len, by_label.values()))
    pieces = [(own * (-(-most // len(own))))[:most] for own in by_label.values()]
    truth = np.repeat(np.arange(len(labels)), most).tolist()
    return train([p for own in pieces for p in own], truth, labels, steps=steps)


def predict(docs: DataFrame, net: Network | None, *, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (all columns if None) with ``lang_pred`` and ``score``, the mean probability of that label.

    Both replace columns of that name.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    if net is None:
        return kept.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    body = [] if text in names else [F.col(text)]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in slices(batches, text):
            mean = label(net, utf8(part, text))
            best = mean.argmax(axis=1)
            seen = part.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            found = [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, seen, strict=True)]
            score = np.where(seen, np.minimum(mean[np.arange(len(best)), best], 1.0), 0.0)
            out = [part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"]
            )

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *body, letters)
    return rows.mapInArrow(labelled, f"{ddl}lang_pred string, score double")


def labeller(net: Network):
    """A function of a text column: the likeliest ``label`` and its mean probability ``score``; null is empty.

    Only the text goes to Python, whatever other columns the rows have.
    """

    @F.arrow_udf("label string, score double")
    def labelled(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for part in slices(iter([batch]), "text"):
            mean = label(net, utf8(part, "text"))
            best = mean.argmax(axis=1)
            names += [net.labels[b] for b in best]
            scores.append(np.minimum(mean[np.arange(len(best)), best], 1.0))
        score = np.concatenate(scores) if scores else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["label", "score"])

    return labelled
