"""Hashes of the words of whole Arrow text columns, computed on byte arrays.

A word is a run without the bytes 0x20 and 0x09-0x0D, A-Z lower-cased. Its hash is a
polynomial in an odd base over random 64-bit values of its bytes, modulo 2^64, taken
from prefix sums, so a column of texts costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_RNG = np.random.default_rng(0x5EED)
_BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads entropy over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word; starts: bytes where a text begins (words end there)."""
    solid = ~_WHITE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, solid
    before[starts[starts < len(data)]] = False
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = solid, False
    after = after[1:].copy()
    ends = starts[(starts > 0) & (starts <= len(data))] - 1
    after[ends] = False
    return np.flatnonzero(solid & ~before[:-1]), np.flatnonzero(solid & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, past-last byte of each word, words of each text) for texts that begin at starts, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(starts), np.int64)
    power, inverse = _powers_to(len(data) + 1)
    first, last = _spans(data, starts)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * inverse[first])
    edges = np.searchsorted(first, np.append(starts, len(data)))
    return hashes, first, last, np.diff(edges)


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) for the bytes of texts that begin at starts, in order."""
    hashes, _, _, counts = hash_spans(data, starts)
    return hashes, counts


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text of about CHUNK bytes, cut at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            white = np.flatnonzero(_WHITE[data[end : end + CHUNK]])
            if len(white):
                end += int(white[0])
                break
            end = min(len(data), end + CHUNK)
        yield data[at:end]
        at = end


def columns_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts in them) of a string column; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words of each row) for runs of rows of about CHUNK bytes together."""
    data, at = columns_bytes(texts)
    row = 0
    while row < len(texts):
        if at[row + 1] - at[row] > CHUNK:
            own = np.concatenate([hash_words(p, np.zeros(1, np.int64))[0] for p in _parts(data[at[row] : at[row + 1]])])
            yield row, own, np.array([len(own)])
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, *hash_words(data[at[row] : at[end]], at[row:end] - at[row])
        row = end
