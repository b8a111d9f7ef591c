"""The 32-bit string hash that key-to-shard maps of older data use, as a pandas function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: Shifts after the rest of one, two or three bytes, and of the last rounds.
_TAIL = {1: (10, 1), 2: (11, 17), 3: (16, 11)}
_LAST = ((3, 5), (4, 17), (25, 6))


def super_fast_hash(data: bytes) -> int:
    """Hsieh's public hash: two 16-bit halves a round, the rest by its length, then avalanche."""
    n = len(data)
    if not n:
        return 0
    h, rest = n, n & 3
    sign = lambda b: b - 256 if b > 127 else b
    for at in range(0, n - rest, 4):
        low, high = data[at] | data[at + 1] << 8, data[at + 2] | data[at + 3] << 8
        h = (h + low) & _MASK
        h = (h << 16 ^ (high << 11 ^ h)) & _MASK
        h = (h + (h >> 11)) & _MASK
    tail = data[n - rest :]
    if rest:
        h = (h + (tail[0] | tail[1] << 8 if rest > 1 else sign(tail[0]))) & _MASK
        left, right = _TAIL[rest]
        h ^= (h << left) & _MASK
        if rest == 3:
            h ^= (sign(tail[2]) << 18) & _MASK
        h = (h + (h >> right)) & _MASK
    for left, right in _LAST:
        h ^= (h << left) & _MASK
        h = (h + (h >> right)) & _MASK
    return h


def hash_many(texts: list[bytes]) -> np.ndarray:
    """super_fast_hash of many texts: those of one length are the rows of a byte matrix, and a round takes a column of all."""
    out = np.zeros(len(texts), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join(texts[k] for k in rows), np.uint8).reshape(len(rows), n)
        wide, sign, rest = raw.astype(np.uint32), raw.view(np.int8).astype(np.int32).view(np.uint32), int(n) & 3
        h = np.full(len(rows), n & _MASK, np.uint32)
        pair = lambda at: wide[:, at] | wide[:, at + 1] << np.uint32(8)  # noqa: B023, E731
        stir = lambda h, left, right: (x := h ^ h << np.uint32(left)) + (x >> np.uint32(right))
        for at in range(0, int(n) - rest, 4):
            h = h + pair(at)
            h = h << np.uint32(16) ^ (pair(at + 2) << np.uint32(11) ^ h)
            h = h + (h >> np.uint32(11))
        if rest:
            left, right = _TAIL[rest]
            h = h + (pair(int(n) - rest) if rest > 1 else sign[:, -1])
            h ^= h << np.uint32(left)
            if rest == 3:
                h ^= sign[:, -1] << np.uint32(18)
            h = h + (h >> np.uint32(right))
        for left, right in _LAST:
            h = stir(h, left, right)
        out[rows] = h
    return out


def _hash(values: pd.Series) -> pd.Series:
    given = values.notna().to_numpy()
    out = np.zeros(len(values))
    out[given] = hash_many([v.encode() for v in values[given]])
    return pd.Series(out).where(given).astype("Int64")


def compatible_hash(s: Column) -> Column:
    """super_fast_hash of a string; use xxhash64 where old placements need not be met."""
    return F.pandas_udf(_hash, "long")(s)
