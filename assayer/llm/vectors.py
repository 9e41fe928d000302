"""Vectors in Arrow columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only; an empty one does."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def width(df: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 without any."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) doubles of a list column without nulls; shorter vectors are followed by zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out
