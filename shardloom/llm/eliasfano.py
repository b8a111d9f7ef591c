"""Elias-Fano lists, packed integers and the files that hold them, on numpy arrays.

A non-decreasing list of n numbers below u takes about 2 + log2(u / n) bits a number: the
low bits of each are packed, the high bits are a unary bit string. All operations take
arrays of queries. Files are read by memory map where the folder is a local path.
"""

from __future__ import annotations

import json
import uuid

import numpy as np

from .common import split_fs

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POP = _BITS.sum(axis=1).astype(np.uint8)
_SELECT = np.zeros((256, 9), np.uint8)
for _b in range(256):
    _at = np.flatnonzero(_BITS[_b])
    _SELECT[_b, : len(_at)] = _at
#: Numbers packed at a time, a multiple of 64.
PART = 1 << 18
#: A one in each byte, and each byte's top bit.
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of width bits (0 to 64), one after the other, in 64-bit words."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, np.uint64)
    for lo in range(0, n if width else 0, PART):  # a part begins with a word
        own = values[lo : lo + PART].astype(np.uint64)
        bit = np.arange(lo, lo + len(own), dtype=np.uint64) * np.uint64(width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        np.bitwise_or.at(out, word, own << shift)
        over = shift + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, own[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The packed numbers with the given indexes."""
    if not width:
        return np.zeros(len(at), np.uint64)
    if width <= 57:  # with the bits before it in its first byte, a number lies in the eight bytes from there
        every = np.ndarray(max(1, words.nbytes - 7), np.uint64, words, strides=(1,))
        bit = at.astype(np.int64) * width
        out = every[bit >> 3]
        out >>= (bit & 7).view(np.uint64)
        out &= np.uint64((1 << width) - 1)
        return out
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    both = low | high
    return both if width == 64 else both & np.uint64((1 << width) - 1)


class EliasFano:
    """arrays: low (packed), high (bits), ones (set bits before each word of high)."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        size = (int(places[-1]) if n else 0) + 2
        raw = np.zeros((size + 63) // 64 * 8 + 8, np.uint8)
        flags = np.zeros(len(raw) * 8, bool)
        flags[places.astype(np.int64)] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(_POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64))[:-1]]).astype(np.int64)
        mask = np.uint64((1 << bits) - 1)
        return EliasFano(n, bits, pack(values & mask, bits), high, ones)

    def _in_word(self, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit with each rank, by sums over the bytes inside the word."""
        x = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
        sums = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
        k = rank.astype(np.uint64)
        shift = np.bitwise_count(((k * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
        before = ((sums << np.uint64(8)) >> shift) & np.uint64(255)
        return (shift + _SELECT[(words >> shift) & np.uint64(255), k - before]).astype(np.int64)

    def _one(self, at: np.ndarray) -> np.ndarray:
        """Place of the set bit of high with each rank."""
        word = np.searchsorted(self.ones, at, "right") - 1
        return word * 64 + self._in_word(self.high[word], at - self.ones[word])

    def _at(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | unpack(self.low, self.low_bits, at)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Numbers with the given indexes."""
        at = at.astype(np.int64)
        return self._at(at, self._one(at))

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers with the given indexes, and those after them: the next set bit is in the same word, mostly."""
        at = at.astype(np.int64)
        place = self._one(at)
        rest = self.high[place >> 6] >> (place & 63).astype(np.uint64) >> np.uint64(1)
        after = place + 1 + np.bitwise_count(~rest & (rest - np.uint64(1)))
        far = np.flatnonzero(rest == 0)
        after[far] = self._one(at[far] + 1)
        return self._at(at, place), self._at(at + 1, after)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th clear bit of high, from 0."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(zeros, k, "right") - 1
        return word * 64 + self._in_word(~self.high[word], k - zeros[word])

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: successor search among the numbers with its high bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = len(self.high) * 64 - self.n - 1  # there are so many clear bits
        at = np.flatnonzero((high >= 0) & (high < last))
        high = high[at]
        lo = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - high + 1, 0)
        hi = self._zero(high) - high
        low = values[at] & np.uint64((1 << self.low_bits) - 1)
        end = hi.copy()
        lo = lower_bound(lambda i: unpack(self.low, self.low_bits, i), lo, hi, low)
        hit = lo < end
        hit[hit] = unpack(self.low, self.low_bits, lo[hit]) == low[hit]
        out[at[hit]] = lo[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.n": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @staticmethod
    def read(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(x) for x in arrays[f"{name}.n"])
        return EliasFano(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


def lower_bound(get, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First index in [lo, hi) whose number is at least the wanted one, else hi; all ranges at once."""
    lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64)
    open_ = np.flatnonzero(lo < hi)
    a, n, w = lo[open_], (hi - lo)[open_], wanted[open_]
    while len(open_):  # n numbers are left from a on
        half = n >> 1
        mid = a + half
        less = get(mid) < w
        np.copyto(a, mid + 1, where=less)
        n -= less
        n -= half
        np.copyto(n, half, where=~less)
        on = np.flatnonzero(n)
        if len(on) < len(n):
            lo[open_] = a
            open_, a, n, w = open_[on], a[on], n[on], w[on]
    return lo


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file below folder; returns its URL. A task attempt never reuses a name."""
    fs, path = split_fs(folder)
    fs.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.bin"
    head, at = {}, 0
    for key, a in arrays.items():
        head[key] = (str(a.dtype), len(a), at)
        at += (a.nbytes + 63) // 64 * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with fs.open_output_stream(f"{path}/{file}", compression=None) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 64))
    return f"{folder}/{file}"


def load(url: str) -> dict[str, np.ndarray]:
    """Arrays of a file: mapped if its file system is local, else read. Also "mapped", which of the two, and its "bytes"."""
    from pyarrow.fs import LocalFileSystem

    fs, path = split_fs(url)
    if isinstance(fs, LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    out: dict = {"mapped": isinstance(fs, LocalFileSystem), "bytes": len(data)}
    for key, (kind, n, at) in head.items():
        at += 8 + size
        out[key] = np.frombuffer(data, kind, n, at) if n else np.zeros(0, kind)
    return out
