"""Whitening of embeddings by a tall-skinny QR (TSQR); no covariance is formed.

1. Components become whole numbers and equal vectors one row: the fit list.
   Its size and its sums by dimension are exact.
2. Every partition streams its rows, centred by the exact sums, through
   Householder QR and keeps one triangular factor R of d x d numbers.
3. The factors are stacked and factored again in groups of ``fan``, level by
   level, until one is left.
4. Its singular values s give the eigenvalues s^2 / n of the covariance, its
   right singular vectors the components.  Small eigenvalues keep the
   precision that squaring the data would lose.

Public method: Demmel et al., "Communication-optimal parallel and sequential
QR and LU factorizations" (2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise, released
from .vectors import matrix, whole, width_of

_LONG = 2**63 - 1


@dataclass(frozen=True)
class Fit:
    """What the driver holds of a fit: numbers by dimension and by component."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x components, unit columns
    eigenvalues: np.ndarray  # falling
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off exactly, then the fraction, so no digits cancel."""
    mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - mean).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2, exactly."""
    mean = [s // n for s in sums]
    off, rest = x - np.array(mean, np.int64), np.array([s % n for s in sums], np.int64)
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * max(1, x.shape[1]) < 2**62:
        y = n * off - rest
        return (y * y).sum(1).tolist()
    return [sum((n * o - r) ** 2 for o, r in zip(row, rest.tolist(), strict=True)) for row in off.tolist()]


def _packed(scale: float, shift: int, width: int):
    """Vectors as bytes of 64-bit integers, floor(scale * c) + shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(scale * matrix(batch.column(0), width)[1] + shift, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], ["x"])

    return run


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def _sums(width: int):
    """Exact sums of a task's rows: (dimension, sum as text); dimension -1 holds the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            x = _unpacked(batch.column(0))
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # halves that no batch's sum overflows
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high.sum(0), low.sum(0), strict=True)]
        if n:
            rows = [(-1, n), *enumerate(total)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([str(r[1]) for r in rows])], ["dimension", "value"])

    return run


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), "r")


def _factored(n: int, sums: list[int], rows: int = 1024):
    """One R factor of a task's centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                y = centred(_unpacked(batch.column(0).slice(low, rows)), n, sums)
                r = _triangle([y] if r is None else [r, y])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["k", "r"])

    return run


def _merged(width: int):
    """The R factor of a group of R factors; k is the group's number."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table["k"].to_pylist(), table["r"].to_pylist(), strict=True))
        r = _triangle([np.frombuffer(b, np.float64).reshape(-1, width) for _, b in ordered])
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _gram(n: int, sums: list[int], project: np.ndarray):
    """Sums, and sums of products, of a task's whitened rows as one row of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = project.shape[1]
        total, rows = np.zeros((k + 1, k)), 0
        for batch in batches:
            w = centred(_unpacked(batch.column(0)), n, sums) @ project
            total[0] += w.sum(0)
            total[1:] += w.T @ w
            rows += len(w)
        if rows:
            at = np.arange(total.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    return run


def _tree(factors: DataFrame, width: int, fan: int) -> np.ndarray:
    """The R factor of all rows; a level's table goes when the next is written."""
    left = factors.count()
    while left > 1:
        ranked = factors.withColumn("group", F.floor(F.col("k") / fan).cast("long"))
        merged = materialise(ranked.groupBy("group").applyInArrow(_merged(width), "k long, r binary"), "factors")
        discard(factors)
        factors, left = merged, merged.count()
    row = factors.first()
    discard(factors)
    return np.frombuffer(bytes(row.r), np.float64).reshape(-1, width)


def fit(vectors: DataFrame, components: int, scale: float, shift: int, vector_col: str, width: int, fan: int = 16) -> Fit | None:
    """The fit over the different usable vectors; None without any.

    Components are those of the largest eigenvalues, at most ``components``,
    and only such as stand above rounding (singular values over d * 2^-52 of
    the largest): along others the vectors do not differ.
    """
    packed = vectors.select(vector_col).mapInArrow(released(_packed(scale, shift, width)), "x binary")
    distinct = materialise(packed.distinct(), "distinct")
    parts = distinct.mapInArrow(released(_sums(width)), "dimension int, value string")
    got = {r.dimension: int(r.value) for r in parts.groupBy("dimension").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()}
    if not got:
        return None
    n, sums = got[-1], [got[d] for d in range(width)]
    factors = materialise(distinct.mapInArrow(released(_factored(n, sums)), "k long, r binary"), "factors")
    s, right = np.linalg.svd(_tree(factors, width, fan), full_matrices=False)[1:]
    eigenvalues = s**2 / n
    kept = [k for k in range(min(components, len(s))) if s[k] > s[0] * width * 2.0**-52]
    unit, trace = right[kept].T, float(eigenvalues.sum())
    error = 0.0
    if kept:
        project = unit / np.sqrt(eigenvalues[kept])
        cells = distinct.mapInArrow(released(_gram(n, sums, project)), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros((len(kept) + 1) * len(kept))
        for r in cells:  # components * (components + 1) numbers
            total[r["at"]] = r["value"]
        total = total.reshape(-1, len(kept)) / n
        error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(len(kept))).max())
    discard(distinct)
    return Fit(n, sums, unit, eigenvalues[kept], trace, error)


def _whitened(model: Fit, scale: float, shift: int, width: int, block: int = 2048):
    k = len(model.eigenvalues)
    project = model.components / np.sqrt(model.eigenvalues)
    share = model.eigenvalues / model.trace if k else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, c = matrix(batch.column(1), width)
            for low in range(0, len(at), block):
                x = whole(scale * c[low : low + block] + shift, np.int64)
                ids = batch.column(0).take(pa.array(np.repeat(at[low : low + block], k)))
                exact = [v if v <= _LONG else None for v in deviations(x, model.n, model.sums)]
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n)),
                    pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array((model.centred(x) @ project).ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(x) * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(
    vectors: DataFrame,
    components: int = 16,
    scale: float = 64.0,
    shift: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    fan: int = 16,
) -> DataFrame:
    """``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` per usable row and component.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  Components become x = floor(scale * c) + shift in 64 bits
    (beyond that range its ends); shorter vectors count as ending in zeros.
    Equal vectors count once in the fit, and each of their rows is returned;
    rows that share an id or have none are rows of their own.  Vectors that
    all agree leave no component and so no rows, as does an empty table;
    fewer than ``components`` come out where the vectors do not spread in as
    many directions.  A deviation that no bigint holds is null.  Of equal
    eigenvalues any basis may come first, the same for all rows.  Other
    columns are not read.

    The driver holds the sums, one triangular factor and the components: d * d
    numbers at any number of rows.  Of the data only the different vectors are
    shuffled, once; equal ones meet before.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = dict(base.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = width_of(base, "v")
    model = fit(base, components, scale, shift, "v", width, fan) if width else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return base.mapInArrow(released(_whitened(model, scale, shift, width)), schema).withColumnRenamed("id", id_col)
