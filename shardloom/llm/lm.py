"""Language-model scoring with an Elias-Fano n-gram trie.

The trie lies in files in the shared folder.
 1. words: by slices of the hash range, an Elias-Fano list of hashes, and exact counts; a
    word's id is its rank among all hashes;
 2. bigrams: for each word an Elias-Fano pointer to its successors, whose ids are packed in
    order, with quantised probabilities;
 3. trigrams: the same below bigrams. A successor c of (a, b) is named by its place among
    the successors of b, so its number is small.
Levels 2 and 3 are cut into pieces of about equal tokens, ranges of (context, successor): a
context that alone has more is cut by successors. A lookup searches the successors of its
context. Counts are exact and over all training rows. Each level is counted in one pass:
tasks sum n-grams in memory and send sorted blocks, which are merged by piece. All n-grams
are kept, from count 1 on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, crc_sql, documents, work_root
from .eliasfano import EliasFano, load, lower_bound, pack, save, unpack
from .words import hashed

#: Taken from the count of each n-gram, and given to unseen successors.
DISCOUNT = 0.9
#: Weight of a context's lower order beside its count: seen contexts of few tokens say little.
SMOOTH = 1.0
#: Text bytes whose tokens make a piece, as long as there are fewer than MOST pieces; entries that a task sums before it sends them.
PIECE_BYTES, MOST, TASK_ENTRIES = 24 << 20, 1 << 18, 1 << 21
#: Text bytes of a token, to turn bytes into tokens; bytes of files that a worker keeps where they cannot be mapped.
TOKEN_BYTES, KEPT_BYTES = 6, 512 << 20
#: Tokens looked up together: so many for each piece of a level (a piece costs calls, however few n-grams it is asked for), and at most.
PIECE_TOKENS, RUN_TOKENS = 1 << 14, 1 << 20
#: Bits of a key of context and successor; a level with wider ones is counted in several passes over ranges of contexts.
KEY_BITS = 63
#: Probabilities are kept as -log10, rounded up to this part.
QUANTUM = 1 / 4096
END = np.uint64(0x2545F4914F6CDD1D)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(-np.log10(np.clip(p, 1e-15, 1.0)) / QUANTUM), 65535).astype(np.uint16)


def logs(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * -QUANTUM


@dataclass
class Pieces:
    """Pieces of a level, in order. Piece s begins at successor sub[s] of context ctx[s] and has the ranks from offset[s] on.

    parent: the file of the level above that has its contexts. A context that is cut has pieces of its own.
    """

    ctx: np.ndarray
    sub: np.ndarray
    parent: np.ndarray
    contexts: int
    offset: np.ndarray | None = None

    def __post_init__(self):
        last = np.append(self.ctx[1:], self.contexts)
        self.split = np.unique(self.ctx[self.ctx == last])
        self.size = np.where(np.isin(self.ctx, self.split), 1, last - self.ctx)

    def of(self, ctx: np.ndarray, sub: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.ctx, ctx, "right") - 1
        if len(self.split):
            cut = np.flatnonzero(np.isin(ctx, self.split))
            for at, c in _groups(ctx[cut]):
                first = int(np.searchsorted(self.ctx, c))
                own = self.sub[first : int(out[cut[at[0]]]) + 1]
                out[cut[at]] = first + np.searchsorted(own, sub[cut[at]], "right") - 1
        return out

    def of_rank(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offset, rank, "right") - 1


@dataclass
class Grams:
    """Distinct words, bigrams and trigrams of a run of texts, in the order of their keys, and where each token has them.

    prior: the bigram that ends at the token before; -1 at a text's first token.
    """

    ids: np.ndarray
    counts: np.ndarray
    word: np.ndarray
    before: np.ndarray
    after: np.ndarray
    times: np.ndarray
    pair: np.ndarray
    prior: np.ndarray


class Trie:
    """Levels of all files, opened when first used. meta: level 1's segments and offsets, Pieces and files by level."""

    def __init__(self, meta: dict):
        self.segments, self.total, self.offsets = meta["segments"], meta["total"], np.array(meta["offsets"])
        self.files, self.pieces = meta["files"], meta["pieces"]
        self._open: dict[tuple[int, int], dict] = {}
        self.vocabulary = int(self.offsets[-1])
        self.width = max(1, self.vocabulary.bit_length())

    def level(self, n: int, segment: int) -> dict:
        key = (n, segment)
        if key not in self._open:
            a = load(self.files[n][segment])
            a["list"] = EliasFano.read(a, "list")
            self._open[key] = a
            read = [k for k, v in self._open.items() if not v["mapped"]]
            while len(read) > 1 and sum(self._open[k]["bytes"] for k in read) > KEPT_BYTES:
                del self._open[read.pop(0)]
        return self._open[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of words."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for at, s in _groups(segment_of(hashes, self.segments)):
            level = self.level(1, s)
            found = level["list"].find(hashes[at])
            ok = found >= 0
            ids[at[ok]] = found[ok] + self.offsets[s]
            counts[at[ok]] = level["count"][found[ok]]
        return ids, counts

    def grams(self, tokens: np.ndarray, starts: np.ndarray) -> Grams:
        """tokens: hashes with END after each text; starts: first tokens of texts, before which END is taken to stand."""
        keys, word = np.unique(tokens, return_inverse=True)
        ids, counts = self.words(keys)
        prior = np.roll(word, 1)
        prior[starts] = np.searchsorted(keys, END)
        both, pair, times = np.unique(prior * len(keys) + word, return_inverse=True, return_counts=True)
        last = np.roll(pair, 1)
        last[starts] = -1
        return Grams(ids, counts, word, both // len(keys), both % len(keys), times, pair, last)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for at, s in _groups(np.searchsorted(self.offsets, ids, "right") - 1):
            out[at] = self.level(1, s)["count"][ids[at] - self.offsets[s]]
        return out

    def find(self, n: int, ctx: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank in level n or -1, place among the successors of the context, log10 probability) of contexts with successors; negative ones are not found."""
        rank, place, p = np.full(len(ctx), -1, np.int64), np.full(len(ctx), -1, np.int64), np.zeros(len(ctx))
        known, pieces = np.flatnonzero((ctx >= 0) & (sub >= 0)), self.pieces[n]
        for at, s in _groups(pieces.of(ctx[known], sub[known])):
            at, level = known[at], self.level(n, s)
            own = ctx[at] - pieces.ctx[s]
            new = np.ones(len(own), bool)  # queries come by context, mostly
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own, back = own[new], np.cumsum(new) - 1
            begin, end = (x.astype(np.int64)[back] for x in level["list"].pairs(own))
            width = int(level["wide"][0])
            wanted = sub[at].astype(np.uint64)
            get = lambda i: unpack(level["ids"], width, i)  # noqa: B023, E731
            found = lower_bound(get, begin, end, wanted)
            hit = np.flatnonzero(found < end)
            hit = hit[get(found[hit]) == wanted[hit]]
            at, found = at[hit], found[hit]
            rank[at] = found + pieces.offset[s]
            # in a piece of a cut context, the places begin in its first piece
            first = pieces.offset[s] - pieces.offset[int(np.searchsorted(pieces.ctx, pieces.ctx[s]))]
            place[at] = found - begin[hit] + first
            p[at] = logs(level["p"][found])
        return rank, place, p

    def first_rank(self, n: int, ctx: np.ndarray) -> np.ndarray:
        """Rank in level n of each context's first successor."""
        out, pieces = np.zeros(len(ctx), np.int64), self.pieces[n]
        for at, s in _groups(pieces.of(ctx, np.zeros(len(ctx), np.int64))):
            out[at] = self.level(n, s)["list"].get(ctx[at] - pieces.ctx[s]).astype(np.int64) + pieces.offset[s]
        return out

    def of_rank(self, n: int, rank: np.ndarray, what: str) -> np.ndarray:
        """Probabilities (p) or successors (ids) of n-grams by rank."""
        out, pieces = np.zeros(len(rank), np.float64 if what == "p" else np.int64), self.pieces[n]
        for at, s in _groups(pieces.of_rank(rank)):
            level, own = self.level(n, s), rank[at] - pieces.offset[s]
            out[at] = logs(level["p"][own]) if what == "p" else unpack(level["ids"], int(level["wide"][0]), own)
        return out

    def left(self, n: int, ctx: np.ndarray) -> np.ndarray:
        """log10 of the mass that contexts leave to lower orders; 0 for negative ones."""
        out, pieces = np.zeros(len(ctx)), self.pieces[n]
        known = np.flatnonzero(ctx >= 0)
        for at, s in _groups(pieces.of(ctx[known], np.zeros(len(known), np.int64))):
            at = known[at]
            out[at] = logs(self.level(n, s)["back"][ctx[at] - pieces.ctx[s]])
        return out

    def first(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words by their counts."""
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.vocabulary + 1)))

    def bigrams(self, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.find(2, g.ids[g.before], g.ids[g.after])

    def trigrams(self, g: Grams, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens that have one, which, its context's rank, its successor's place) of distinct trigrams whose bigrams are known."""
        at = np.flatnonzero(g.prior >= 0)
        at = at[(rank[g.prior[at]] >= 0) & (rank[g.pair[at]] >= 0)]
        keys, which = np.unique(g.prior[at] * len(rank) + g.pair[at], return_inverse=True)
        return at, which, rank[keys // len(rank)], place[keys % len(rank)]

    def score(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token (base log10, model log10, known) of token hashes, END after each text; starts: first tokens of texts."""
        g = self.grams(hashes, starts)
        base = self.first(g.counts)
        rank, place, p = self.bigrams(g)
        pairs = np.where(rank >= 0, p, base[g.after] + self.left(2, g.ids)[g.before])
        model = pairs[g.pair]
        below = np.flatnonzero(g.prior >= 0)
        used = np.zeros(len(rank), bool)
        used[g.prior[below]] = True
        model[below] += self.left(3, np.where(used, rank, -1))[g.prior[below]]
        at, which, ctx, sub = self.trigrams(g, rank, place)
        found, _, p = self.find(3, ctx, sub)
        hit = found >= 0
        model[at[hit[which]]] = p[which[hit[which]]]
        return base[g.word], model, (g.counts > 0)[g.word]


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Segments are equal slices of the hash range, so ids by segment and rank keep the order of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _groups(values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(indexes, value) for each distinct value."""
    if not len(values):
        return
    order = np.argsort(values, kind="stable")
    v = values[order]
    for part in np.split(order, np.flatnonzero(v[1:] != v[:-1]) + 1):
        yield part, int(values[part[0]])


def _with_end(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with END after each text, first token of each text)."""
    ends = np.cumsum(counts)
    tokens = np.insert(words, ends, END)
    return tokens, np.concatenate([[0], (ends + np.arange(1, len(ends) + 1))[:-1]]).astype(np.int64)


def _runs(texts: pa.Array, pieces: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, words of each row) for runs of whole rows, which have more tokens where levels have more pieces."""
    wanted = min(PIECE_TOKENS * pieces, RUN_TOKENS)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for _, words, counts in hashed(texts):
        parts.append((words, counts))
        size += len(words) + len(counts)
        if size >= wanted:
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            parts, size = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Sums:
    """Sums counts by key, sending blocks by segment when there are many keys. Keys keep the order of segments."""

    def __init__(self, segment_of_keys):
        self.segment_of_keys = segment_of_keys
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: sorted and distinct."""
        if len(keys):
            self.parts.append((keys, counts))
            self.size += len(keys)
            if self.size > 2 * TASK_ENTRIES:
                self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [summed(self.parts)]
            self.size = len(self.parts[0][0])

    def blocks(self, end: bool) -> Iterator[pa.RecordBatch]:
        if self.size > TASK_ENTRIES or end:
            self.merge()
        if self.parts and (end or self.size > TASK_ENTRIES):
            (keys, counts), self.parts, self.size = self.parts[0], [], 0
            for at, s in _groups(self.segment_of_keys(keys)):
                for lo in range(0, len(at), 1 << 17):
                    part = slice(at[lo], at[min(len(at), lo + (1 << 17)) - 1] + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([encode(keys[part], counts[part])], pa.binary())], names=["segment", "block"])


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted (keys, counts) of several."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as an Elias-Fano list, counts packed in the width of the largest."""
    e, width = EliasFano.of(keys), int(counts.max()).bit_length()
    low, packed = e.low.tobytes(), pack(counts, width).tobytes()
    return np.array([e.n, e.low_bits, width, len(low), len(packed)], np.int64).tobytes() + low + packed + e.high.tobytes()


def decode(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, low_bits, width, a, b = (int(x) for x in np.frombuffer(block, np.int64, 5))
    low, packed = np.frombuffer(block, np.uint64, a // 8, 40), np.frombuffer(block, np.uint64, b // 8, 40 + a)
    high = np.frombuffer(block, np.uint8, -1, 40 + a + b)
    places = np.flatnonzero(np.unpackbits(high, bitorder="little"))
    at = np.arange(n, dtype=np.int64)
    return ((places - at).astype(np.uint64) << np.uint64(low_bits)) | unpack(low, low_bits, at), unpack(packed, width, at).astype(np.int64)


def _cuts(weights: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """(first context of each piece, its weight if it is one context of more than target, else 0)."""
    if not len(weights):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heavy = weights > target
    light = np.where(heavy, 0, weights)
    group = (np.cumsum(light) - light) // target
    begins = np.ones(len(weights), bool)
    begins[1:] = heavy[1:] | heavy[:-1] | (group[1:] != group[:-1])
    at = np.flatnonzero(begins)
    return at, np.where(heavy, weights, 0)[at]


_RESULT = "segment int, n long, total long, file string, starts array<long>, heavy array<long>"


def _result(segment: int, n: int, total: int, file: str, cuts) -> pa.RecordBatch:
    starts, heavy = (pa.array([x.tolist()], pa.list_(pa.int64())) for x in cuts)
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([file], pa.string()), starts, heavy], names=["segment", "n", "total", "file", "starts", "heavy"])


_NO_CUTS = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merged(blocks: DataFrame, segments: list[int], build) -> dict[int, dict]:
    """Blocks by segment, each summed and handed to build(segment, keys, counts) -> (n, total, file, cuts); empty segments too."""
    every = blocks.sparkSession.range(segments[0], segments[-1] + 1).select(F.col("id").cast("int").alias("segment"), F.lit(None).cast("binary").alias("block"))
    dealt = blocks.unionByName(every).repartitionById(len(segments), F.col("segment") - segments[0])

    def run(batches):
        now, parts = None, []

        def done():
            return _result(now, *build(now, *(summed(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))))

        for batch in batches:
            for segment, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, parts = segment, []
                if block.is_valid:
                    parts.append(decode(block.as_py()))
                    if len(parts) >= 16:  # keep the sum, not the parts
                        parts = [summed(parts)]
        if now is not None:
            yield done()

    return {int(r["segment"]): r.asDict() for r in dealt.mapInArrow(run, _RESULT).collect()}


def _counted(texts: DataFrame, keys_of, segment_of_keys, pieces: int) -> DataFrame:
    """Blocks of the keys, sorted and distinct, and counts that keys_of(tokens, starts) gives for all texts. pieces: of the levels that it looks into."""

    def run(batches):
        sums = _Sums(segment_of_keys)
        for batch in batches:
            for words, counts in _runs(batch.column(0), pieces):
                sums.add(*keys_of(*_with_end(words, counts)))
                yield from sums.blocks(False)
        yield from sums.blocks(True)

    return texts.mapInArrow(run, "segment int, block binary")


def _pieces(above: dict[int, dict], offset: np.ndarray, target: int, successors) -> Pieces:
    """Pieces below a level whose files are above; successors(contexts): how many the cut ones can have at most."""
    ctx, sub, parent = [], [], []
    for s in sorted(above):
        for start, weight in zip(above[s]["starts"], above[s]["heavy"], strict=True):
            parts = -(-weight // target) if weight else 1
            cuts = sorted({k * successors(offset[s] + start) // parts for k in range(parts)}) if parts > 1 else [0]
            ctx += [offset[s] + start] * len(cuts)
            sub += cuts
            parent += [s] * len(cuts)
    if not ctx:
        ctx, sub, parent = [0], [0], [0]
    return Pieces(np.array(ctx, np.int64), np.array(sub, np.int64), np.array(parent, np.int64), int(offset[-1]))


def _finish(trie: Trie, n: int, s: int, folder: str, ctx: np.ndarray, sub: np.ndarray, counts: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> str:
    """Write piece s of level n. total, distinct: tokens and successors of its contexts, in all pieces."""
    left = 1 - (total - DISCOUNT * distinct) / (total + SMOOTH)
    p = np.zeros(len(counts), np.uint16)
    for lo in range(0, len(counts), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        own, c = ctx[part], sub[part]
        if n == 2:
            lower = trie.first(trie.counts(c))
        else:  # the bigram below (a, b, c) is the one at c's place among the successors of b
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            b, where = np.unique(trie.of_rank(2, trie.pieces[3].ctx[s] + own[new], "ids"), return_inverse=True)
            lower = trie.of_rank(2, np.repeat(trie.first_rank(2, b)[where], np.diff(np.append(new, len(own)))) + c, "p")
        p[part] = quantise((counts[part] - DISCOUNT) / (total[own] + SMOOTH) + left[own] * 10**lower)
    pointers = np.searchsorted(ctx, np.arange(len(total) + 1))
    wide = max(1, int(sub.max(initial=0)).bit_length())
    arrays = EliasFano.of(pointers).arrays("list") | {"ids": pack(sub, wide), "wide": np.array([wide]), "p": p, "back": quantise(np.clip(left, 1e-12, 1.0))}
    return save(folder, f"level{n}-{s}", arrays)


def _level(spark, texts: DataFrame, meta: dict, n: int, folder: str, above: dict[int, dict], target: int) -> dict[int, dict]:
    """Count, smooth and write level n (2 or 3) below the files above; adds it to meta."""
    offset = np.array(meta["offsets"]) if n == 2 else meta["pieces"][2].offset
    pieces = _pieces(above, offset, target, lambda ctx: meta["offsets"][-1] if n == 2 else _successors(_trie(meta), ctx))
    width = max(1, int(meta["offsets"][-1]).bit_length())
    done: dict[int, dict] = {}
    meta = {**meta, "pieces": {**meta["pieces"], n: pieces}}

    def keys_of(tokens, starts, base, end):
        """Keys of the n-grams with contexts from base to end; packed in 64 bits, the context above the successor."""
        trie = _trie(meta)
        g = trie.grams(tokens, starts)
        if n == 2:
            ctx, sub, times = g.ids[g.before], g.ids[g.after], g.times
        else:
            _, which, ctx, sub = trie.trigrams(g, *trie.bigrams(g)[:2])
            times = np.bincount(which, minlength=len(ctx))
        ok = (ctx >= base) & (ctx < end) & (sub >= 0)
        if not ok.all():
            ctx, sub, times = ctx[ok], sub[ok], times[ok]
        return (ctx - base).astype(np.uint64) << np.uint64(width) | sub.astype(np.uint64), times

    def parts_of(keys):
        return (keys >> np.uint64(width)).astype(np.int64), (keys & np.uint64((1 << width) - 1)).astype(np.int64)

    def pass_of(first: int, last: int) -> dict[int, dict]:
        base = int(pieces.ctx[first])
        end = int(pieces.ctx[last] + pieces.size[last])

        def build(s, keys, counts):
            ctx, sub = parts_of(keys)
            ctx = ctx + base - pieces.ctx[s]
            cuts = _cuts(counts, target) if n == 2 else _NO_CUTS
            if pieces.ctx[s] in pieces.split:
                return len(keys), int(counts.sum()), save(folder, f"counts{n}-{s}", {"sub": sub, "counts": counts}), cuts
            size = int(pieces.size[s])
            total, distinct = np.bincount(ctx, counts, size), np.bincount(ctx, minlength=size)
            return len(keys), int(counts.sum()), _finish(_trie(meta), n, s, folder, ctx, sub, counts, total, distinct), cuts

        def piece_of(keys):
            ctx, sub = parts_of(keys)
            return pieces.of(ctx + base, sub)

        return _merged(_counted(texts, lambda tokens, starts: keys_of(tokens, starts, base, end), piece_of, most_pieces(meta)), list(range(first, last + 1)), build)

    first = 0
    while first < len(pieces.ctx):  # one pass, unless keys do not fit in 64 bits
        last = int(np.searchsorted(pieces.ctx + pieces.size, pieces.ctx[first] + (1 << max(0, KEY_BITS - width)), "right")) - 1
        done |= pass_of(first, max(first, last))
        first = max(first, last) + 1

    # contexts in several pieces: their sums are known now
    cut = {s: int(pieces.ctx[s]) for s in done if pieces.ctx[s] in pieces.split}
    sums = {c: [sum(done[s][k] for s in cut if cut[s] == c) for k in ("total", "n")] for c in set(cut.values())}
    pieces.offset = np.concatenate([[0], np.cumsum([done[s]["n"] for s in sorted(done)])]).astype(np.int64)
    if cut:
        raw = spark.createDataFrame([(s, done[s]["file"], *sums[c]) for s, c in cut.items()], "segment int, file string, total long, n long").repartition(len(cut))

        def finish(batches):
            for batch in batches:
                for s, file, total, distinct in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    a = load(file)
                    counts = a["counts"]
                    yield _result(s, len(counts), int(counts.sum()), _finish(_trie(meta), n, s, folder, np.zeros(len(counts), np.int64), a["sub"], counts, np.array([total]), np.array([distinct])), _NO_CUTS)

        for r in raw.mapInArrow(finish, _RESULT).collect():
            done[int(r["segment"])]["file"] = r["file"]
    meta["files"][n] = [done[s]["file"] for s in sorted(done)]
    return meta, done


def _successors(trie: Trie, bigram: int) -> int:
    """How many successors the last word of a bigram, given by rank, has."""
    b = trie.of_rank(2, np.array([bigram]), "ids")
    first, end = (int(trie.first_rank(2, b + k)[0]) if int(b[0]) + k < trie.vocabulary else int(trie.pieces[2].offset[-1]) for k in (0, 1))
    return max(1, end - first)


def train(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> dict:
    """Count, smooth and write the trie of all rows that are not held out; returns its meta data (a few numbers a piece)."""
    texts = docs.where(crc_mod(id_col, 10) != 0).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    piece_bytes = max(piece_bytes, -(-size // MOST))
    segments, target = max(8, -(-size // piece_bytes)), max(1, piece_bytes // TOKEN_BYTES)

    def words(tokens, starts):
        return np.unique(tokens, return_counts=True)

    def build(segment, keys, counts):
        return len(keys), int(counts.sum()), save(folder, f"words-{segment}", EliasFano.of(keys).arrays("list") | {"count": counts}), _cuts(counts, target)

    done = _merged(_counted(texts, words, lambda keys: segment_of(keys, segments), 0), list(range(segments)), build)
    offsets = [0, *np.cumsum([done[s]["n"] for s in range(segments)]).tolist()]
    meta = {"segments": segments, "files": {1: [done[s]["file"] for s in range(segments)]}, "pieces": {}, "total": sum(done[s]["total"] for s in range(segments)), "offsets": offsets}
    for n in (2, 3):
        meta, done = _level(docs.sparkSession, texts, meta, n, folder, done, target)
    return meta


def most_pieces(meta: dict) -> int:
    """Pieces of the level with most of them, of those that have files."""
    return max(len(f) for f in meta["files"].values())


_tries: dict[tuple, Trie] = {}


def _trie(meta: dict) -> Trie:
    """One open trie for each set of files in a worker; older ones are closed."""
    key = tuple((n, f[0]) for n, f in sorted(meta["files"].items()))
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(meta)
    _tries[key].pieces = meta["pieces"]
    return _tries[key]


def score_texts(docs: DataFrame, meta: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Defined cases: null and empty texts are one end token; a text of any length is read whole, in
    parts; null ids are passed on; repeated rows give repeated results; without training rows all
    tokens are unknown and scores are 0; other columns are ignored.
    """
    kind, total = docs.schema[id_col].dataType.simpleString(), meta["total"]

    def run(batches):
        trie = _trie(meta)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for words, counts in _runs(batch.column(2), most_pieces(meta)):
                tokens, starts = _with_end(words, counts)
                base, model, known = trie.score(tokens, starts)
                for c, v in zip(cols, (counts + 1, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(model, starts)), strict=True):
                    c.append(v)
            n, k, b, s = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(np.full(len(n), total), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, 10) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_texts(docs, train(docs, f"{work_root(spark)}/lm"))


def lm_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


BASE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {crc_sql("doc_id::VARCHAR")} % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ' ') AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c)::BIGINT AS total, count(*) AS distinct_tokens FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, total AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (distinct_tokens + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out, total
"""
