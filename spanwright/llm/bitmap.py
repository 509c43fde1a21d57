"""A bitmap of 64-bit keys that any worker can hold: lets all of them pass and few others.

Its size follows the number of keys up to MOST_BITS (32 MB), so what is broadcast is bounded; past
that it lets more through, which costs shuffle but never changes a result (a join decides).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
_SEGMENT = 15  # bits of one bitmap that Spark's bitmap functions build


def build(keys: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(bits, bitmap) over the top bits of a long column."""
    n = keys.count()
    bits = min(MOST_BITS, max(_SEGMENT + 1, (16 * n).bit_length()))
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    parts = keys.select(F.shiftright(at, _SEGMENT).alias("segment"), at.bitwiseAND(F.lit((1 << _SEGMENT) - 1)).alias("place"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    size = 1 << _SEGMENT >> 3
    for row in parts.groupBy("segment").agg(F.expr("bitmap_construct_agg(place)").alias("map")).toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["map"], np.uint8)
    return bits, out


def passes(keys: np.ndarray, filter_: tuple[int, np.ndarray]) -> np.ndarray:
    """Which of the uint64 keys may be in the bitmap."""
    bits, data = filter_
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
