"""Bitmaps of hashes, small enough to broadcast: what can't match is left out before it is a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: as the number of keys asks for, between these (128 KB and 16 MB).
BITS = (20, 27)
#: Bits of the hashes, whose highest ones are the places in the bitmap.
WIDTH = 62


def held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the bitmap's."""
    slot = h >> (WIDTH - (len(bitmap) * 8 - 1).bit_length())
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def broadcast_bitmap(keys: DataFrame, *columns: str) -> Broadcast:
    """A bitmap of all hashes in some columns of longs (WIDTH bits each, evenly spread).

    It is made by tasks, one word for each 64 places, and has BITS[1] bits at most: beyond some ten million keys it
    holds nearly all, so callers join what it lets pass, and what is right never depends on it.
    """
    bits = min(max((256 * keys.count()).bit_length(), BITS[0]), BITS[1])
    slots = keys.select(F.explode(F.array(*columns)).alias("h")).select(F.shiftright("h", WIDTH - bits).alias("slot"))
    words = slots.selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, CAST(slot & 63 AS INT)) AS b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.int64)
    bitmap[got["w"].to_numpy()] = got["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))


def hash_place(key: str) -> Column:
    """A hash of WIDTH bits of one column."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - WIDTH)


def may_hold(bitmap: Broadcast, key: str) -> Column:
    """Whether a bitmap of ``hash_place`` may hold a row's key; only the hashes pass Python."""

    @F.arrow_udf("boolean")
    def there(h: pa.Array) -> pa.Array:
        return pa.array(held(bitmap.value, h.to_numpy(zero_copy_only=False)))

    return there(hash_place(key))
