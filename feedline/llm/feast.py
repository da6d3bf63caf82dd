"""Whitening by principal components that contour integration finds (FEAST).

Entries become whole numbers ``floor(64 * c) + 1000000``.  Counts, sums and centred
products are exact: tasks multiply whole numbers less the floor of the mean, Spark
adds them as decimals, and what the floor left of the mean is taken off in whole
numbers before the one division.  So the covariance does not depend on the order of
the rows or on retries.  Only it, of the square of the dimension, reaches the driver.

Its largest eigenvalues are found by intervals.  Inertia counts (signs of the pivots
of a symmetric LDL' factorisation of the shifted covariance, by Sylvester's law the
number of eigenvalues below the shift) cut the spectrum into intervals of few
eigenvalues, with no eigenvalue at a cut.  Every interval is a row of a Spark job:
Gauss-Legendre quadrature of complex shifted solves along a circle through its ends
projects a block of vectors onto its eigenspace, Rayleigh-Ritz extracts pairs, and
both are repeated until the residuals are at rounding level.  The number of pairs
must equal the difference of the inertia counts, else the interval is solved again
with a larger block, and at last refused: none is missed.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped.
Where lengths differ, those of the commonest length (the longest of these) are kept.
A component without variance (fewer rows than dimensions, constant entries) has no
whitening and is left out.  Repeated rows count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
# Quadrature points of a half circle, eigenvalues of an interval, rounds of projection.
POINTS = 8
WIDTH = 8
ROUNDS = 20
# Share of the largest eigenvalue below which a component counts as without variance.
LEAST = 1e-13
ROWS = 4096


class Moments(NamedTuple):
    """``n`` rows, exact sums of their entries, and the covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def whole_vectors(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the entries as whole numbers, of the rows that can be used."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    odd = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("c").isNotNull() & (F.size("c") > 0) & ~odd)
    whole = rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    sizes = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    first = sizes.first()
    return whole.filter(F.size("x") == (first["d"] if first else 0))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column of equal lengths as the rows of a matrix."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def exact_products(rows: np.ndarray) -> list[list[int]]:
    """The products of every two columns as whole numbers."""
    high = int(np.abs(rows).max(initial=0))
    if high * high * len(rows) < 1 << 53:
        # Floats add whole numbers below 2^53 without rounding.
        return [[int(v) for v in line] for line in rows.astype(float).T @ rows.astype(float)]
    return (rows.astype(object).T @ rows.astype(object)).tolist()


def moments(whole: DataFrame) -> Moments | None:
    """Exact moments of ``x``, or None without rows."""
    first = whole.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    entries = whole.select(F.posexplode("x").alias("at", "value")).groupBy("at")
    sums = {r["at"]: r for r in entries.agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()}
    n, totals = sums[0]["n"], [int(sums[i]["s"]) for i in range(d)]
    floors = [s // n for s in totals]
    shape = pa.schema([("at", pa.int32()), ("line", pa.list_(pa.decimal128(38, 0)))])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in pieces(batches):
            more = exact_products(matrix(part, "x") - np.array(floors, np.int64))
            held = more if held is None else [[a + b for a, b in zip(u, v, strict=True)] for u, v in zip(held, more, strict=True)]
        if held is not None:
            yield pa.RecordBatch.from_pydict({"at": range(d), "line": held}, schema=shape)

    lines = whole.select("x").mapInArrow(multiplied, "at int, line array<decimal(38,0)>")
    cells = lines.select("at", F.posexplode("line").alias("to", "p")).groupBy("at", "to").agg(F.sum("p").alias("p"))
    covariance = np.zeros((d, d))
    left = [s - n * f for s, f in zip(totals, floors, strict=True)]
    for r in cells.toLocalIterator():
        i, j = r["at"], r["to"]
        covariance[i, j] = (n * int(r["p"]) - left[i] * left[j]) / (n * n)
    return Moments(n, totals, covariance)


def inertia(matrix: np.ndarray) -> int:
    """The number of negative eigenvalues, from the pivots of a symmetric factorisation with complete pivoting."""
    a, below, growth = matrix.copy(), 0, (1 + np.sqrt(17)) / 8
    while len(a):
        size = np.abs(a)
        p, (i, j) = int(size.diagonal().argmax()), np.unravel_index(size.argmax(), size.shape)
        if size[i, j] == 0:
            break
        if size[p, p] >= growth * size[i, j]:
            pivot = [p]
            below += int(a[p, p] < 0)
        else:
            # A two by two pivot whose diagonal is small has one eigenvalue of each sign.
            pivot = [int(i), int(j)]
            below += 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        cross = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(a[np.ix_(pivot, pivot)], cross.T)
        a = (a + a.T) / 2
    return below


def above(covariance: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above the shift."""
    return len(covariance) - inertia(covariance - shift * np.eye(len(covariance)))


def free_cut(covariance: np.ndarray, low: float, high: float, clear: float) -> tuple[float, int] | None:
    """A shift near the middle with no eigenvalue within ``clear`` of it, and the eigenvalues above it."""
    for step in range(1, 32):
        # 1/2, then 1/4 and 3/4, 1/8 and 3/8 and so on: farther from the middle only where it is taken.
        level = step.bit_length()
        share = (2 * (step - (1 << (level - 1))) + 1) / (1 << level)
        shift = low + share * (high - low)
        if shift - low <= clear or high - shift <= clear:
            return None
        count = above(covariance, shift + clear)
        if count == above(covariance, shift - clear):
            return shift, count
    return None


def intervals(covariance: np.ndarray, components: int, width: int = WIDTH) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues in it) from the top that hold at least ``components`` eigenvalues."""
    size = float(np.abs(covariance).sum(axis=1).max())
    if size == 0:
        return []
    floor = LEAST * size
    found: list[tuple[float, float, int]] = []
    stack = [(floor, size * (1 + 1e-6), above(covariance, floor), 0)]
    have = 0
    while stack and have < components:
        low, high, over_low, over_high = stack.pop()
        inside = over_low - over_high
        if inside == 0:
            continue
        # Closer eigenvalues are one cluster, which stays whole.
        clear = max(1e-7 * high, 1e-12 * size)
        cut = free_cut(covariance, low, high, clear) if inside > width and high - low > 64 * clear else None
        if cut is None:
            found.append((low, high, inside))
            have += inside
        else:
            middle, over_middle = cut
            stack += [(low, middle, over_low, over_middle), (middle, high, over_middle, over_high)]
    return found


def project(covariance: np.ndarray, low: float, high: float, vectors: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The vectors' part in the eigenspace of the interval, by quadrature of shifted solves on a circle."""
    nodes, weights = np.polynomial.legendre.leggauss(points)
    middle, radius, one = (low + high) / 2, (high - low) / 2, np.eye(len(covariance))
    total = np.zeros_like(vectors)
    for node, weight in zip(nodes, weights, strict=True):
        turn = np.exp(0.5j * np.pi * (1 - node))
        # The lower half circle is the conjugate of the upper one: twice the real part.
        solved = np.linalg.solve((middle + radius * turn) * one - covariance, vectors.astype(complex))
        total += weight / 2 * (radius * turn * solved).real
    return total


def eigenpairs(covariance: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``count`` eigenvalues of the interval and their unit vectors as columns."""
    d, scale = len(covariance), float(np.abs(covariance).max())
    rounding = d * max(1e-13 * high, 4e-16 * scale)
    for extra in (2, 4, d):
        block = min(d, extra * count + 2)
        vectors, settled = np.random.default_rng(block).standard_normal((d, block)), False
        for _ in range(ROUNDS):
            basis, sizes, _ = np.linalg.svd(project(covariance, low, high, vectors), full_matrices=False)
            basis = basis[:, sizes > sizes[0] * 1e-14] if sizes[0] else basis
            values, small = np.linalg.eigh(basis.T @ covariance @ basis)
            vectors = basis @ small
            inside = (values > low) & (values <= high)
            residual = np.abs(covariance @ vectors - vectors * values).max(axis=0)
            if inside.sum() == count and residual[inside].max() <= rounding:
                if settled:
                    return values[inside], vectors[:, inside]
                # One round more brings the vectors to rounding level as well.
                settled = True
            if vectors.shape[1] < count:
                break
    raise ArithmeticError(f"{count} eigenvalues between {low} and {high} by inertia, not all found")


def components_of(spark: SparkSession, covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above zero, falling, at most ``components``, and their unit vectors as rows."""
    d = len(covariance)
    parts = intervals(covariance, min(components, d))
    if not parts:
        return np.empty(0), np.empty((0, d))
    shape = pa.schema([("value", pa.float64()), ("vector", pa.list_(pa.float64()))])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = eigenpairs(covariance, row["low"], row["high"], row["n"])
                yield pa.RecordBatch.from_pydict({"value": values, "vector": vectors.T.tolist()}, schema=shape)

    jobs = spark.createDataFrame(parts, "low double, high double, n int").repartition(len(parts))
    found = sorted(jobs.mapInArrow(solved, "value double, vector array<double>").collect(), reverse=True)[:components]
    return np.array([r["value"] for r in found]), np.array([r["vector"] for r in found])


def whiten(
    table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32
) -> DataFrame:
    """``vec_id``, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    ``deviation`` is the sum of (n * x - S)^2 over the entries, exact, as
    decimal(38,0); ``identity_error`` the largest entry of the whitened rows'
    covariance less the identity, measured on the rows.
    """
    spark = table.sparkSession
    whole = stored(whole_vectors(table, vec_id=vec_id, vector=vector), "vectors")
    known = moments(whole)
    kind = whole.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if known is None:
        return spark.createDataFrame([], result)
    n, sums, covariance = known
    values, vectors = components_of(spark, covariance, components)
    if not len(values):
        return spark.createDataFrame([], result)
    axes = vectors / np.sqrt(values)[:, None]
    rest = np.array([s % n for s in sums]) / n
    floors = np.array([s // n for s in sums], np.int64)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            x = matrix(part, "x")
            scores = (x - floors - rest) @ axes.T
            off = (x - floors).astype(object) * n - np.array([s % n for s in sums], object)
            deviation = [int(v) for v in (off * off).sum(axis=1)]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values))
            columns = [part.column("vec_id"), pa.array(deviation, pa.decimal128(38, 0))]
            columns.append(pa.ListArray.from_arrays(ends, pa.array(scores.ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "scores"])

    rows = whole.mapInArrow(projected, f"vec_id {kind}, deviation decimal(38,0), scores array<double>")
    rows = stored(rows, "whitened")
    error = float(np.abs(measured_covariance(rows, n, len(values)) - np.eye(len(values))).max())
    shares = F.array(*[F.lit(float(v)) for v in values / covariance.trace()])
    each = rows.select("vec_id", "deviation", F.posexplode("scores").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def measured_covariance(rows: DataFrame, n: int, k: int) -> np.ndarray:
    """Covariance (divisor n) of the ``scores`` of all rows, centred first."""
    means = rows.select(F.posexplode("scores").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()
    centre = np.zeros(k)
    for r in means:
        centre[r["at"]] = r["s"] / n
    shape = pa.schema([("at", pa.int32()), ("line", pa.list_(pa.float64()))])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), False
        for part in pieces(batches):
            off = matrix(part, "scores") - centre
            total, seen = total + off.T @ off, True
        if seen:
            yield pa.RecordBatch.from_pydict({"at": range(k), "line": total.tolist()}, schema=shape)

    lines = rows.select("scores").mapInArrow(multiplied, "at int, line array<double>")
    cells = lines.select("at", F.posexplode("line").alias("to", "p")).groupBy("at", "to").agg(F.sum("p").alias("p"))
    found = np.zeros((k, k))
    for r in cells.toLocalIterator():
        found[r["at"], r["to"]] = r["p"] / n
    return found
