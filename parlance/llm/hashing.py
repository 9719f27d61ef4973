"""Vectorised hashes of byte ranges and words, and bitmaps of hashes that are small enough to broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a broadcast bitmap: as the number of keys asks for, between these (8 KB and 16 MB).
BITS = (16, 27)
#: Random values of the bytes.
VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).view(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def digest(data: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(data)


def longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two arrays of longs."""
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def each_bytes(column):
    """The values of an Arrow column of bytes or strings; null is empty."""
    for x in column:
        buffer = x.as_buffer()
        yield buffer.to_pybytes() if buffer is not None else b""


def _power_tables(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses modulo 2**64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def spread(low: np.ndarray) -> np.ndarray:
    """Least hashes are small numbers; this deals them out over all, so that filters and shuffles can use them."""
    low = (low ^ low >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return low ^ low >> np.uint64(32)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ranges of values, whatever their place, by prefix sums modulo 2**64."""
    powers, inverses = _power_tables(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * inverses[start])


def word_bounds(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between bytes that are marked as parting them."""
    edges = np.flatnonzero(np.diff(np.r_[False, ~parts, False].view(np.int8)))
    return edges[::2], edges[1::2]


def hit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h.view(np.uint64) >> np.uint64(64 - (len(bitmap) * 8 - 1).bit_length())
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def broadcast_bitmap(df: DataFrame, column: str):
    """A broadcast bitmap of the values of a column of random longs; its size is bounded by BITS.

    A bitmap only spares shuffles what can't match: beyond some ten million keys it passes more,
    and what is right never depends on it.
    """
    bits = min(max((32 * df.count()).bit_length(), BITS[0]), BITS[1])
    slots = df.select(F.shiftrightunsigned(column, 64 - bits).alias("slot"))
    words = slots.selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, CAST(slot & 63 AS INT)) AS b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.int64)
    bitmap[got["w"].to_numpy()] = got["b"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))
