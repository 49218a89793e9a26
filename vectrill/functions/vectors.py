"""Vector arithmetic as Column builders (JVM-side, double precision) and as numpy for batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    # The outer transform binds the norm, which would be worked out for every component otherwise.
    bound = F.transform(F.array(norm(v)), lambda n: F.transform(_c(v), lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))
    return F.get(bound, F.lit(0))


def cosine_distance(a, b) -> Column:
    """``1 - cosine``; not clamped, 1 if a side is zero."""
    n = norm(a) * norm(b)
    return F.lit(1.0) - dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def is_finite(v) -> Column:
    return F.forall(_c(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def round5(x: Column) -> Column:
    """Five decimal places, without a negative zero."""
    return F.round(x, 5) + F.lit(0.0)


def l2_normalize(matrix) -> np.ndarray:
    """Rows scaled to length 1 as float32; zero rows stay zero, one row may be given flat."""
    m = np.asarray(matrix, np.float32)
    m = m[None, :] if m.ndim == 1 else m
    if m.ndim != 2:
        raise ValueError("expected one or two dimensions")
    n = np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    return (m / np.where(n == 0, 1.0, n)).astype(np.float32)


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix, without a Python object for each number."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))
