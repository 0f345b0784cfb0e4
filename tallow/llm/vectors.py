"""Vectors in Arrow batches: which rows take part, and their components as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def width_of(vectors: DataFrame, vector_col: str) -> int:
    """The length of the longest vector; 0 for none."""
    return max(0, vectors.agg(F.max(F.size(F.col(vector_col)))).first()[0] or 0)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are neither null nor hold null or non-finite components, and those rows as doubles.

    Shorter vectors end in zeros up to ``width``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)[there].astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    if len(lengths) and (lengths == width).all():
        out = values.reshape(len(there), width)
    else:
        out = np.zeros((len(there), width))
        out[np.arange(width) < lengths[:, None]] = values
    good = np.isfinite(out).all(1)
    return there[good], out[good]


def whole(x: np.ndarray, kind: type = np.int32) -> np.ndarray:
    """floor(x) as integers; beyond the type's range they are its ends."""
    ends = np.iinfo(kind)
    low, high = float(ends.min), float(np.nextafter(float(ends.max), 0)) if kind is np.int64 else float(ends.max)
    return np.clip(np.floor(x), low, high).astype(kind)
