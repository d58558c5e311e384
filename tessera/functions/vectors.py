"""Vector functions over array columns, and numpy forms for Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector or unequal lengths."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column as a float64 matrix."""
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True) if m.size else np.ones((len(m), 1))
    return m / np.where(length > 0, length, 1)
