"""Whitening of embeddings by cyclic Jacobi rotations.

Three passes over the vectors: sums, the scatter about the mean they give, and the scatter of what is
whitened.  Each task adds up its own rows as one matrix; the matrices are summed by row in Spark, and what
comes to the driver is one matrix as wide as the vectors.  There symmetric Jacobi rotations, applied to
disjoint pairs at once, make it diagonal, which finds small eigenvalues as exactly as large ones.  The
sorted, scaled eigenvectors (at most ``components`` columns) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finite, main_length, matrix_of

_ROWS = "i int, part array<double>"


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry positive) of a symmetric matrix.

    A sweep is a round-robin tournament: each round rotates disjoint pairs, so all of them at once, and
    every pair meets once.  A pair is at rest when its entry is below the rounding of the mean of its
    diagonal entries (geometric); the sweeps end when all are.
    """
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    rows = np.eye(n)
    eps = np.finfo(float).eps
    floor = eps * eps * np.abs(a).max(initial=0.0)
    seats = np.arange(n + n % 2)

    def turn(side: np.ndarray, p: np.ndarray, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        low, high = side[p], side[q]
        side[p], side[q] = c * low - s * high, s * low + c * high

    for _ in range(sweeps):
        turned = 0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            live = np.abs(apq) > np.maximum(eps * np.sqrt(n * np.abs(app * aqq)), floor)
            if live.any():
                turned += int(live.sum())
                p, q, apq, app, aqq = p[live], q[live], apq[live], app[live], aqq[live]
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(1.0, theta))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                turn(a, p, q, c[:, None], s[:, None])
                a = a.T.copy()  # the same for the columns
                turn(a, p, q, c[:, None], s[:, None])
                turn(rows, p, q, c[:, None], s[:, None])
                a[p, p], a[q, q] = app - t * apq, aqq + t * apq
                a[p, q] = a[q, p] = 0.0
            seats = np.r_[seats[0], np.roll(seats[1:], 1)]
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    vectors = rows.T[:, order]
    if n:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return values[order], vectors


def _scatter(width: int, of):
    """A task's sum of ``z`` (row -1) and of ``z z'`` (a row each), of the vectors ``z = of(x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = of(batch.column(0))
            total += z.T @ z
            first += z.sum(axis=0)
        rows = [first, *total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "part"])

    return run


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The tasks' matrices added up: one of ``width + 1`` rows comes to the driver."""
    cells = parts.select("i", F.posexplode("part").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((width + 1, width))
    for r in cells.collect():
        out[r["i"] + 1, r["j"]] = r["x"]
    return out


def _sums(width: int):
    """A task's exact sums of whole numbers (of at most 2^48) by position, and its number of rows at position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, dtype=object), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                part = matrix_of(batch.column(0).slice(at, 1 << 12), width)
                total, n = total + part.sum(axis=0).astype(object), n + len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array([n, *total.tolist()], pa.decimal128(38, 0))], names=["j", "s"])

    return run


def _deviations(away: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row of whole numbers; null beyond 38 digits."""
    if away.shape[1] * int(np.abs(away).max(initial=0)) ** 2 < 1 << 63:
        return pa.array((away * away).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
    exact = (sum(x * x for x in row) for row in away.tolist())
    return pa.array([x if x < 10**38 else None for x in exact], pa.decimal128(38, 0))


def steps(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Each component as the whole number ``floor(scale * x) + shift``."""
    return F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("long") + F.lit(shift))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Components become whole numbers (:func:`steps`); the fit is over all vectors.  ``deviation`` is the
    exact sum of ``(n * x - S)^2`` as a decimal, null beyond 38 digits.  A direction without any variance (below the rounding of
    the largest) has no whitened values and is left out, so fewer vectors than dimensions give fewer
    components.  Vectors that are null, empty or hold a null or non-finite component take no part, nor do
    those of another length than the most common one.  Rows with a null id take part as any other;
    repeated rows each count and are each returned; equal variances keep the order the rotations leave.
    Components beyond 2^40 in amount are held there.  Other columns are not read.  An empty table gives no
    rows.  The three passes run at once.
    """
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    v = vectors[vector_col].cast("array<double>")
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where(finite(F.col("v")))
    width = main_length(own, "v")
    spark = vectors.sparkSession
    if not width:
        return spark.createDataFrame([], out)
    most = float(1 << 40)
    held = F.transform("v", lambda x: F.least(F.lit(most), F.greatest(F.lit(-most), x)))
    rows = own.where(F.size("v") == width).select("vec_id", steps(held).alias("x"))

    sums = {r["j"]: int(r["s"]) for r in rows.select("x").mapInArrow(_sums(width), "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    n, total = sums[-1], [sums[j] for j in range(width)]
    whole = n * ((64 << 40) + 1_000_000) < 1 << 61  # then n * x - S is a long
    kind = np.int64 if whole else object
    total = np.array(total, dtype=kind)

    def centred(column: pa.Array) -> np.ndarray:
        """``n * x - S``, exact."""
        return matrix_of(column, width).astype(kind) * n - total

    spread = _summed(rows.select("x").mapInArrow(_scatter(width, lambda c: centred(c).astype(np.float64) / n), _ROWS), width)
    values, directions = jacobi(spread[1:] / n)
    keep = min(components, int((values > width * np.finfo(float).eps * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not keep:
        return spark.createDataFrame([], out)
    matrix = spark.sparkContext.broadcast(directions[:, :keep] / np.sqrt(values[:keep]))
    share = values[:keep] / values.sum()

    def white(column: pa.Array) -> np.ndarray:
        return (centred(column).astype(np.float64) / n) @ matrix.value

    made = _summed(rows.select("x").mapInArrow(_scatter(keep, white), _ROWS), keep) / n
    error = float(np.abs(made[1:] - np.outer(made[0], made[0]) - np.eye(keep)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(at, 4096)
                z = white(batch.column(1))
                times = np.repeat(np.arange(len(z)), keep)
                dev = _deviations(centred(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(z))), pa.array(np.full(len(times), n)), dev.take(pa.array(times)), pa.array(z.ravel()), pa.array(np.tile(share, len(z))), pa.array(np.full(len(times), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, out)
