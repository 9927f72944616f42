"""What the operators on embeddings share: which rows take part, and their vectors as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector as doubles, or null where it is null or holds a null, an infinity or a NaN."""
    v = vector.cast("array<double>")
    limit = F.lit(float("inf"))
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == limit), F.lit(True)))
    return F.when(v.isNotNull() & ~bad, v)


def width(vectors: DataFrame, vector: str = "vector") -> int:
    """The longest vector's length, 1 at least; shorter ones count as filled up with zeros."""
    return max(1, vectors.agg(F.max(F.size(vector))).first()[0] or 0)


def matrix(vectors, columns: int) -> np.ndarray:
    """Rows of doubles from a pandas column of lists."""
    out = np.zeros((len(vectors), columns))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def scaled(x: np.ndarray, times: float) -> np.ndarray:
    """floor(times * x) as int64; what lies beyond 2 ** 62 counts as 2 ** 62."""
    limit = float(1 << 62)
    return np.clip(np.floor(times * x), -limit, limit).astype(np.int64)
