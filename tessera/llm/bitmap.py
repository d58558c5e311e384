"""Membership bitmaps of bounded size: a broadcast that thins rows before an exact join.

A bitmap never replaces the join: it has false positives and no false negatives, and when the key set outgrows it, it
only thins less.  Its size follows the counted keys, 16 bits a key, between 128 KB and ``2**MOST`` bits (16 MB), so up to
8 million keys at most one row in 16 passes by chance; beyond 134 million keys it hardly thins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the number of bits, at least and at most.
LEAST, MOST = 20, 27


def size_for(n: int) -> int:
    """log2 of the bits for n keys."""
    return min(max((16 * max(n, 1) - 1).bit_length(), LEAST), MOST)


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap of a 64-bit column of a stored table: bits are OR-ed per 64-bit slot in Spark, so at most 2**(MOST-6) rows,
    two million, reach the driver."""
    bits = size_for(keys.count())
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    rows = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("bit"))
        .groupBy("slot")
        .agg(F.bit_or("bit").alias("word"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return out


def contains(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Vectorised probe of int64 keys."""
    slot = keys & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def probe(bitmap: np.ndarray, column: Column) -> Column:
    """The same probe as a Boolean column; only the key travels to Python."""
    shared = bitmap

    @F.pandas_udf("boolean")
    def inside(keys):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(contains(shared, keys.fillna(0).to_numpy(np.int64)))

    return inside(column)
