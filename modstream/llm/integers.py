"""Vectors of whole numbers: scaled, floored, and read from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this, sums of products are exact in double precision; from LONG on those of any such vectors may not fit into a long.
EXACT, LONG = 2.0**53, 2.0**60


def floored(embedding: Column, scale: int = 256) -> Column:
    """floor(``scale`` * x) of each component x as double; null for a vector that is null or holds null or non-finite components."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of long components of a column of vectors of one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), len(flat) // max(1, len(column)))


def largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b`` as long; ValueError if they may not fit."""
    most = largest(a) * largest(b) * max(1, a.shape[1])
    if most >= LONG:
        raise ValueError("components are too large for inner products in a long")
    if most >= EXACT:
        return a @ b.T
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c`` as long; ValueError if they may not fit."""
    if (largest(x) + largest(c)) ** 2 * max(1, x.shape[1]) >= LONG:
        raise ValueError("components are too large for squared distances in a long")
    return (x * x).sum(1)[:, None] - 2 * products(x, c) + (c * c).sum(1)[None, :]
