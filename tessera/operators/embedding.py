"""Embedding seams: a provider turns texts into vectors in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import unit

Embedder = Callable[[list[str]], np.ndarray]
DIMENSIONS = 1024


@lru_cache(maxsize=200_000)
def _hashed(word: str) -> tuple[int, float]:
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:4], "big"), 1.0 if h[4] & 1 else -1.0


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Bag of words by signed MD5 hashing, unit length; an empty text gives the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
        hashed = [_hashed(w) for ws in words for w in ws]
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        slot = row * dimensions + np.fromiter((h % dimensions for h, _ in hashed), np.int64, len(hashed))
        sums = np.bincount(slot, np.fromiter((s for _, s in hashed), np.float64, len(hashed)), len(texts) * dimensions)
        return unit(sums.reshape(len(texts), dimensions)).astype(np.float32)

    return embed


def embedded(rows: DataFrame, embedder: Embedder, dimensions: int = DIMENSIONS, text: str = "text", batch_size: int = 512) -> DataFrame:
    """All columns and ``vector``; a null text has a null vector.  A wrong vector size is an error."""
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[np.ndarray | None] = []
            for at in range(0, len(s), batch_size):
                some = s.iloc[at : at + batch_size]
                made = embedder(some.fillna("").tolist())
                if made.shape != (len(some), dimensions):
                    raise ValueError(f"the embedder gave {made.shape}, not {(len(some), dimensions)}")
                out += [v if t is not None else None for v, t in zip(made, some, strict=True)]
            yield pd.Series(out, dtype=object)

    return rows.withColumn("vector", vectors(F.col(text)))
