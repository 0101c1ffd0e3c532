"""A bitmap of fixed size over 64-bit hashes, built by Spark and given to every task.

It answers "perhaps" or "no". Operators use it only where "perhaps" for everything would
still give the same result, so a full bitmap costs time, never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release


def build(hashes: DataFrame, bits: int, column: str = "h") -> np.ndarray:
    """Two bits for each hash, at its first and its second ``bits`` bits. At most 2^(bits - 6) rows reach the driver."""
    h = F.col(column)
    second = F.shiftrightunsigned(h, 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1))
    place = F.col("place")
    places = hashes.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), second)).alias("place"))
    words = places.select(F.shiftrightunsigned(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    release(hashes.sparkSession)
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit hash may be in the set."""
    bits = len(bitmap).bit_length() + 5

    def marked(place: np.ndarray) -> np.ndarray:
        return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    return marked(hashes >> np.uint64(64 - bits)) & marked((hashes >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1))
