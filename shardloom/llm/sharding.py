"""Histogram-sort sharding by exact bytes, with DataFrame operations only.

Rows are ordered by (hash of the text, id, row). The splitters of that order are found
by counting exact bytes below candidate boundaries: each round probes a fixed
number of boundaries inside the intervals that still hold a splitter and keeps
the probe nearest to its target, until the error is within the tolerance. Only the
histograms (a bounded number of rows) reach the driver. The rows move once, when
they get their slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Probes of one interval and round.
BITS = 12
#: Accepted distance of a splitter from its target, as a part of a shard.
TOLERANCE = 0.002
#: Rows per slot-numbering task.
SLOT_ROWS = 200_000
#: Columns of the order: hash of the text, id, number of the row in the written keys.
KEY = ("h", "d", "u")
LOW = -(1 << 63)


def _bits(lo: int, hi: int) -> tuple[int, int]:
    """(first number, bits) of the smallest aligned interval that holds lo to hi, which are signed 64-bit numbers."""
    bits = 64 if (lo < 0) != (hi < 0) else (lo ^ hi).bit_length()
    return (lo >> bits) << bits if bits < 64 else LOW, bits


def _among(part: DataFrame, columns: tuple[str, ...], heads: list[tuple[int, ...]]) -> DataFrame:
    """Rows whose first columns have one of a few combinations of values."""
    return part.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(columns, head, strict=False)]) for head in heads]))


def _find_splitters(keyed: DataFrame, shards: int, total: int, tolerance: float) -> list[tuple[int, ...]]:
    """Boundaries of the order by KEY: rows whose key is not below a boundary, a tuple of the key's first columns, are above it.

    A column is searched by halves of powers of two: each round counts exact bytes in 2^BITS equal slices of
    the intervals that still hold a splitter. Where one value holds more than a splitter may be off, the next
    column of the key goes on inside it; the last one tells all rows apart.
    """
    allowed = tolerance * total / shards
    done: dict[int, tuple[int, ...]] = {}
    #: splitter -> (values of the columns before, bytes below them)
    todo: dict[int, tuple[tuple[int, ...], int]] = {j: ((), 0) for j in range(1, shards)}
    for depth, column in enumerate(KEY):
        if not todo:
            break
        heads = sorted({head for head, _ in todo.values()})
        part = _among(keyed, KEY, heads) if depth else keyed
        if depth:
            ends = part.groupBy(*KEY[:depth]).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
            span = {tuple(int(r[c]) for c in KEY[:depth]): _bits(int(r["lo"]), int(r["hi"])) for r in ends}
        else:
            span = {(): (LOW, 64)}
        #: splitter -> (values before, first number and bits of its interval, bytes below)
        open_ = {j: (head, *span[head], below) for j, (head, below) in todo.items()}
        todo = {}
        while open_:
            intervals = sorted({x[:3] for x in open_.values()})
            probe = F.lit(None).cast("long")
            for n, (head, base, bits) in enumerate(intervals):
                shift = max(0, bits - BITS)
                inside = F.col(column).between(F.lit(base), F.lit(base + (1 << bits) - 1))
                for c, v in zip(KEY, head, strict=False):
                    inside = inside & (F.col(c) == F.lit(v))
                probe = F.when(inside, F.lit(n << BITS + 1) + F.shiftright(column, shift) - F.lit(base >> shift)).otherwise(probe)
            found: dict[int, dict[int, int]] = {n: {} for n in range(len(intervals))}
            for r in part.select(probe.alias("p"), "size").where("p is not null").groupBy("p").agg(F.sum("size").alias("b")).collect():
                found[int(r["p"]) >> BITS + 1][int(r["p"]) & (1 << BITS + 1) - 1] = int(r["b"])
            later = {}
            for j, (head, base, bits, below) in open_.items():
                shift, target, seen = max(0, bits - BITS), total * j / shards, below
                for p, b in sorted(found[intervals.index((head, base, bits))].items()):
                    first = base + (p << shift)
                    after = first + (1 << shift)  # past the last number: no row of this head is above
                    if seen + b > target:
                        if target - seen <= allowed:
                            done[j] = (*head, first)
                        elif seen + b - target <= allowed:
                            done[j] = (*head, after)
                        elif shift:
                            later[j] = (head, first, shift, seen)
                        elif depth + 1 < len(KEY):
                            todo[j] = ((*head, first), seen)
                        else:  # one row: the nearer side
                            done[j] = (*head, after if seen + b - target < target - seen else first)
                        break
                    seen += b
                else:
                    done[j] = (*head, base + (1 << bits))
            open_ = later
    return [done[j] for j in sorted(done)]


def _above(boundary: tuple[int, ...], columns: tuple[str, ...] = KEY) -> Column:
    value, column = boundary[0], F.col(columns[0])
    if len(boundary) > 1:
        return (column > F.lit(value)) | ((column == F.lit(value)) & _above(boundary[1:], columns[1:]))
    return column >= F.lit(value) if value < -LOW else F.lit(False)


def _shard_of(splitters: list[tuple[int, ...]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(_above(s), 1).otherwise(0) for s in splitters], F.lit(0))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Deal rows to shards of near equal bytes; one row out per row in.

    Returns id_col, size, text_crc32, shard, slot. A row's size is its text's UTF-8
    bytes plus 1. Equal texts are neighbours in the order, so a group of them is cut
    only where a boundary must fall inside it. Slots are gapless from 0 in each shard.

    Defined cases: a null text has size 1 and crc32 0, and sorts with the empty text; a
    null id sorts as the smallest long; rows that repeat text and id are cut only where a
    boundary must fall inside them; a text longer than a shard makes its shard larger, as
    rows are whole; an empty table gives an empty result; columns other than the two named
    are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("d"),
            F.monotonically_increasing_id().alias("u"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-keys",
    )
    whole = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    splitters = _find_splitters(keyed, shards, int(whole["b"]), tolerance) if whole["b"] else []
    parts = max(1, -(-int(whole["n"]) // SLOT_ROWS)) * 8
    placed = keyed.select("id", *KEY, "size", "text_crc32", _shard_of(splitters).cast("int").alias("shard"), F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy(*KEY)
    ranked = placed.withColumn("r", F.row_number().over(within).cast("long"))
    return ranked.join(offsets, ["shard", "part"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("r") - 1).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_sizes(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: rows and bytes in all, whether each shard's slots are gapless, and whether each shard is near its share.

    A shard may be off by its two splitters, each by the tolerance or by the longest row.
    """
    rows = op9_sharding(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("longest"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    whole = shards.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.max("longest").alias("longest"), F.count_if((F.col("first") != 0) | (F.col("last") != F.col("n") - 1)).alias("gaps"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    share = F.col("n_bytes") / 16
    slack = 2 * (TOLERANCE * share + F.col("longest"))
    return whole.select("n_rows", "n_bytes", "gaps", ((F.col("least") >= share - slack) & (F.col("most") <= share + slack)).alias("near_share"))


SIZES_SQL = "SELECT count(*)::BIGINT AS n_rows, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, 0::BIGINT AS gaps, true AS near_share FROM documents"
