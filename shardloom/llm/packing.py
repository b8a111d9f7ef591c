"""Packing of token sequences by minimum bin slack.

Every document is cut into full windows and one remainder. The remainders' lengths
are few (below the window), so their histogram is the whole packing problem: a
bitset subset-sum program picks the multiset of remaining lengths that fills a
window closest to its capacity, backtracking gives the count of each length, and
the multiset is used as often as the counts allow. The plan has a size that depends
on the window alone, not on the corpus; rows find their place in it by the rank of
a piece among those of its length.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

WINDOW = 1024
#: Vocabulary files by name in public_tokenizers, or paths: the tokenizer and the same vocabulary as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 0

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _path(name: str) -> str:
    import os

    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _fast(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(_path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=4)
def _plain(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_path(tokenizer))


@functools.lru_cache(maxsize=4)
def _added(tokenizer: str) -> re.Pattern:
    """What finds the tokenizer's added tokens, such as the end of text, written out in a text."""
    names = [t.content for t in _plain(tokenizer).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, names)) or r"(?!)")


def token_ids(text: str, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> np.ndarray:
    """Ids as unsigned 32-bit numbers: those of the tokenizer file, without added special tokens.

    With ranks, the same vocabulary's faster implementation is used, save on texts with added tokens, which
    it does not know, and on those for which its regular expressions run out of stack (a ValueError).
    """
    if ranks is not None and not _added(tokenizer).search(text):
        try:
            return _fast(ranks).encode_to_numpy(text, disallowed_special=())
        except ValueError:
            pass
    return np.array(_plain(tokenizer).encode(text, add_special_tokens=False).ids, "<u4")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is at most capacity and nearest to it.

    Bit s of the program's state tells that the lengths seen so far can sum to s; states
    are kept per length, so that the counts can be traced back from the best sum.
    """
    mask, state, states = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        states.append((length, state))
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            state |= (state << (take * length)) & mask
            left, step = left - take, step * 2
        if state >> capacity & 1:
            break
    total, chosen = state.bit_length() - 1, {}
    for length, before in reversed(states):
        n = 0
        while not before >> (total - n * length) & 1:
            n += 1
        if n:
            chosen[length] = n
            total -= n * length
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many windows are filled by it), using every piece once."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = fill({k: v for k, v in rest.items() if v}, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        left = {k: v for k, v in ((k, v - times * chosen.get(k, 0)) for k, v in left.items()) if v}
    return out


def places(planned: list[tuple[dict[int, int], int]], first: int) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces of that length in a window, first sequence, offset in it)."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    for chosen, times in planned:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut(docs: DataFrame, id_col: str, text_col: str, window: int, tokenizer: str, ranks: str | None) -> DataFrame:
    """Pieces of all documents, each with its rank among those of its length in its task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", tokenizer, ranks), [END_ID]).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """Deal all tokens to sequences of at most window tokens; one row per piece (_PLACED).

    A document's ids are its text's and then END_ID. Sequence ids are gapless from 0, and
    so are the offsets in a sequence.

    Defined cases: null and empty texts have the end id alone; null ids are passed on;
    repeated rows are separate documents; an empty table gives an empty result; a text of
    any length is cut into full windows; other columns are ignored.
    """
    pieces = materialise(cut(docs, id_col, text_col, window, tokenizer, ranks), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = total.pop(window, 0)
    table = places(plan(total, window), full)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            for n in np.unique(length[length < window]):
                at, t = np.flatnonzero(length == n), table[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                own = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + own // row[:, 1]
                offset[at] = row[:, 3] + own % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, _PLACED)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def packing_law(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: documents packed, pieces that do not follow on in their document, and sequences that are too long or have gaps."""
    rows = materialise(op1_packing(spark, sf_dir), "pack-law")
    in_document = Window.partitionBy("doc_id").orderBy("start")
    pieces = rows.withColumn("end", F.col("start") + F.col("length")).withColumn("before", F.coalesce(F.lag("end").over(in_document), F.lit(0)))
    docs = pieces.groupBy("doc_id").agg(F.count_if(F.col("before") != F.col("start")).alias("cuts"), (F.max("end") - F.max("doc_tokens")).alias("rest"))
    sums = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    bad = F.count_if((F.col("n") != F.col("end")) | (F.col("n") > WINDOW)).alias("bad_sequences")
    one = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("cuts") > 0) | (F.col("rest") != 0)).alias("bad_documents"))
    return one.crossJoin(sums.agg(bad, (F.max("sequence_id") + 1 - F.count(F.lit(1))).alias("missing_sequences")))


LAW_SQL = "SELECT count(*)::BIGINT AS n_documents, 0::BIGINT AS bad_documents, 0::BIGINT AS bad_sequences, 0::BIGINT AS missing_sequences FROM documents"
