"""MinHash near-duplicate classes with exact verification.

1. One pass over the texts gives each row a fingerprint of its whole word sequence, the
   size of its shingle set, and many minima of universal hashes over that set.
2. Rows of equal fingerprints are one class; only its representative goes on.
3. Bands of minima put representatives in buckets. Every bucket names its smallest member
   as hub, and members are compared with hubs first: signatures, then full sets. Pairs that
   components already join are not compared again.
4. What is left, members of one bucket in different components, is compared in blocks of
   bounded rows and bytes. First the blocks hold signatures only, and name the rows that
   some pair's signatures allow to be linked; then the same blocks get these rows' texts and
   verify the pairs, best ones first, unless links found there already join them. A pair is
   looked at in the first band it shares only. So no pair goes unseen, and a block emits
   rows or links, never its pairs.
5. Components are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, sized
from .components import components
from .words import hashed, mix

SHINGLE = 5
#: Links have at least this Jaccard similarity, in hundredths.
PERCENT = 85
#: Minima of a signature, and the chance at most that a pair at the wanted similarity shares no band, or agrees in too few places.
MINIMA, MISSED = 120, 1e-5
#: Members of one comparing task's hub; of one side of a block, rows and bytes of text.
HUB_ROWS, BLOCK_ROWS, BLOCK_BYTES = 256, 1024, 16 << 20
#: Pairs, and rows of blocks, are broadcast to the texts up to so many; beyond, both sides are dealt by id.
PAIR_ROWS = 200_000

_RNG = np.random.default_rng(0xD0C5)
_A = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_Q = _RNG.integers(0, 1 << 61, SHINGLE, np.uint64) * np.uint64(8) + np.uint64(3)
_SALT = _RNG.integers(1, 1 << 63, SHINGLE + 1, np.uint64)
_ROW_KEYS = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shape(percent: int) -> tuple[int, int]:
    """(rows of a band, least places in which signatures agree) for links of that similarity: the strictest with MISSED."""
    p = percent / 100
    fits = [r for r in range(1, MINIMA + 1) if MINIMA % r == 0 and (1 - p**r) ** (MINIMA // r) <= MISSED]
    least, tail = 0, 0.0
    while (tail := tail + math.comb(MINIMA, least) * p**least * (1 - p) ** (MINIMA - least)) <= MISSED:
        least += 1
    return max(fits, default=1), least


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    total = np.full(n - k + 1, _SALT[k], np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _Q[i]
    return np.unique(mix(total))


def minima(distinct: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash over the set; its high 32 bits."""
    best = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 1024):
        best = np.minimum(best, (distinct[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    keys = (signature.astype(np.uint64) * _ROW_KEYS).reshape(-1, rows).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(len(keys), dtype=np.uint64)).view(np.int64)


def describe(docs: DataFrame, id_col: str, text_col: str, rows: int, size: int = SHINGLE) -> DataFrame:
    """(id, bytes, fp, n, bands, sig) per row; bands and sig are null without shingles."""
    schema = pa.schema([("id", pa.int64()), ("bytes", pa.int64()), ("fp", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, counts in hashed(batch.column(2)):
                seen: dict[bytes, tuple] = {}
                cols: list[list] = [[], [], [], []]
                ends = np.cumsum(counts)
                for end, n in zip(ends, counts, strict=True):
                    own = words[end - n : end]
                    fp = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    if fp not in seen:
                        s = shingles(own, size)
                        sig = minima(s) if n else None
                        seen[fp] = (fp, len(s), None, None) if sig is None else (fp, len(s), band_keys(sig, rows), sig.tobytes())
                    for c, v in zip(cols, seen[fp], strict=True):
                        c.append(v)
                arrays = [*(batch.column(k)[row : row + len(counts)] for k in (0, 1)), *(pa.array(c, t) for c, t in zip(cols, schema.types[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(F.col(text_col).cast("string")).cast("long").alias("bytes"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, bytes long, fp binary, n long, bands array<long>, sig binary")


def _similar(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least so many places. An id with several texts has several signatures."""
    sig = nodes.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _table(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have the wanted similarity.

    Rows are dealt by (a, part) with a's text first, so a task holds the set of a and one of a
    member at a time; a hub with many members has many parts.
    """
    pairs = materialise(pairs.distinct(), "near-pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("parts"))
    parts = materialise(parts, "near-parts")
    texts = texts.select("id", "text")
    hubs = texts.join(sized(parts, PAIR_ROWS), parts["a"] == texts["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    sides = materialise(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b"), "near-sides")
    members = texts.join(sized(sides, PAIR_ROWS), sides["b"] == texts["id"]).select("a", "part", "b", "text")
    rows = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        now, hubs = None, []
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for row, words, counts in hashed(batch.column(3)):
                ends = np.cumsum(counts)
                for k, (end, n) in enumerate(zip(ends, counts, strict=True), row):
                    own = shingles(words[end - n : end], size)
                    if b[k] is None:  # more than one where texts repeat an id
                        now, hubs = a[k], [*(hubs if now == a[k] else []), own]
                    elif any(_alike(own, hub, percent) for hub in hubs):
                        out.append((a[k], b[k]))
            yield _table(out)

    return materialise(rows.mapInArrow(run, "a long, b long").distinct(), "near-links")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least percent hundredths of their union in common."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[place] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _blocks(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows, each sent once to every block (band, key, i, j) and side of it where it stands.

    Strays, members outside the component of their bucket's hub, meet all members: they stand in
    side 1 of ga blocks, and every member in side 2 of gs blocks.
    """
    own, other = lambda g: F.pmod(F.xxhash64("id"), F.col(g)).cast("int"), lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    left = F.when(F.col("stray"), F.transform(other("ga"), lambda j: F.struct(own("gs").alias("i"), j.alias("j"), F.lit(1).alias("side"))))
    right = F.transform(other("gs"), lambda i: F.struct(i.alias("i"), own("ga").alias("j"), F.lit(2).alias("side")))
    at = F.explode(F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int,side:int>>")), right))
    dealt = rows.select(*cols, at.alias("p")).select(*cols, "p.i", "p.j", "p.side")
    return dealt.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "id", "side")


def _by_block(batches, names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """((band, key, i, j), rows) of sorted Arrow batches."""
    now, block = None, []
    for batch in batches:
        for values in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
            row = dict(zip(names, values, strict=True))
            at = (row["band"], row["key"], row["i"], row["j"])
            if at != now and block:
                yield now, block
                block = []
            now = at
            block.append(row)
    if block:
        yield now, block


def _allowed(band: int, block: list[dict], width: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of side 1, rows of side 2, places that agree) of pairs in different components whose signatures allow a link.

    Pairs with the hub were compared before, pairs that share an earlier band belong to its bucket, and
    of two strays the smaller one stands in side 1.
    """
    ids, comps = (np.array([r[k] for r in block], np.int64) for k in ("id", "comp"))
    hubs, side = np.array([r["hub"] for r in block], np.int64), np.array([r["side"] for r in block])
    sigs = np.frombuffer(b"".join(r["sig"] for r in block), np.uint32).reshape(len(block), -1)
    stray = np.array([r["stray"] for r in block])
    others = np.flatnonzero((side == 2) & (ids != hubs))
    for a in np.flatnonzero((side == 1) & (ids != hubs)):
        at = others[(comps[others] != comps[a]) & (~stray[others] | (ids[others] > ids[a]))]
        same = sigs[at] == sigs[a]
        agree = same.sum(axis=1)
        near = np.flatnonzero(agree >= least)
        near = near[same[near].reshape(len(near), sigs.shape[1] // width, width).all(axis=2).argmax(axis=1) == band]
        if len(near):
            yield int(a), at[near], agree[near]


def _block_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame | None:
    """Links (a, b) between members of one bucket in different components; None if there are no such members."""
    width, least = shape(percent)
    stray = F.col("comp") != F.col("hub_comp")
    placed = materialise(members.join(nodes.groupBy("id").agg(F.max("bytes").alias("bytes")), "id").withColumn("stray", stray), "near-placed")
    parts = lambda n, b: F.ceil(F.greatest(n / BLOCK_ROWS, b / BLOCK_BYTES)).cast("int")
    counts = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_if("stray").alias("s"), F.sum(F.when(F.col("stray"), F.col("bytes"))).alias("sb")).where("s > 0")
    counts = materialise(counts.select("band", "key", parts(F.col("s"), F.col("sb")).alias("gs"), parts(F.col("n"), F.col("b")).alias("ga")), "near-blocks")
    if counts.isEmpty():
        return None
    rows = materialise(placed.join(counts, ["band", "key"]).select("band", "key", "hub", "id", "comp", "stray", "gs", "ga"), "near-block-rows")
    at, own = ["band", "key", "i", "j"], ["band", "key", "hub", "id", "comp", "stray", "sig"]

    def name(batches):
        for (band, key, i, j), block in _by_block(batches, [*own, "i", "j", "side"]):
            found = set()
            for a, others, _ in _allowed(band, block, width, least):
                found |= {a, *others.tolist()}
            cols = zip(*[(band, key, i, j, block[k]["side"], block[k]["id"]) for k in sorted(found)], strict=True) if found else [[]] * 6
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*at, "side", "id"])

    sigs = nodes.select("id", "sig")
    named = _blocks(rows.join(sigs, "id"), own).mapInArrow(name, "band int, key long, i int, j int, side int, id long")
    named = materialise(named.distinct(), "near-named")
    if named.isEmpty():
        return None
    wanted = materialise(named.join(rows.select("band", "key", "id", "hub", "comp", "stray"), ["band", "key", "id"]).select(*at, "side", "id", "hub", "comp", "stray"), "near-wanted")
    whole = texts.select("id", "text").join(sized(wanted, PAIR_ROWS), "id").join(sigs, "id")
    dealt = whole.repartition(*at).sortWithinPartitions(*at, "id", "side")

    def links(band: int, block: list[dict]) -> list[tuple[int, int]]:
        sets = []
        for r in block:
            (_, words, _), *_ = hashed(pa.array([r.pop("text")], pa.string()))
            sets.append(shingles(words, size))
        pairs = sorted((-int(n), a, int(b)) for a, others, agree in _allowed(band, block, width, least) for b, n in zip(others, agree, strict=True))
        root = {r["comp"]: r["comp"] for r in block}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for _, a, b in pairs:
            x, y = top(block[a]["comp"]), top(block[b]["comp"])
            if x != y and _alike(sets[a], sets[b], percent):
                root[max(x, y)] = min(x, y)
                out.append((block[a]["id"], block[b]["id"]))
        return out

    def run(batches):
        for (band, *_), block in _by_block(batches, [*own, "i", "j", "side", "text"]):
            yield _table(links(band, block))

    return materialise(dealt.select(*own, "i", "j", "side", "text").mapInArrow(run, "a long, b long"), "near-block-links")


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) of all nodes after joining the components (id, comp) in nodes by links, written, between them."""
    if links.isEmpty():
        return nodes
    comp = nodes.select("id", "comp")
    ends = links.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    roots = components(ends, "ca", "cb")
    return materialise(comp.join(roots, comp["comp"] == roots["node"], "left").select("id", F.coalesce("root", "comp").alias("comp")), "near-comps")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Links are pairs of shingle sets with at least percent hundredths in common; a component's id
    is the smallest id in it, and that document is kept.

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing;
    fewer words than a shingle has are one shingle; a row with a null id is linked with
    nothing and kept; rows that repeat an id are one document: it has all links of their texts,
    and they share a component; a text of any length is hashed whole, in parts; equal texts and
    equally similar ones are all linked; an empty table gives an empty result; columns other than
    the two named are ignored. Shingles are compared by 64-bit hashes, whole texts by 128 bits.
    """
    width, least = shape(percent)
    rows = materialise(describe(docs, id_col, text_col, width, size), "near-rows")
    real = rows.where("n > 0 and id is not null")
    classes = materialise(real.groupBy("fp").agg(F.min("id").alias("rep")), "near-classes")
    nodes = real.join(classes.select(F.col("fp").alias("cfp"), "rep"), (F.col("id") == F.col("rep")) & (F.col("fp") == F.col("cfp")), "left_semi")
    nodes = materialise(nodes.select("id", "bytes", "sig", "bands").dropDuplicates(["id", "sig"]), "near-nodes")
    banded = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = materialise(banded.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", "hub"), "near-hubs")
    members = materialise(banded.join(hubs, ["band", "key"]), "near-members")
    involved = materialise(members.select("id").distinct(), "near-involved")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(sized(involved), "id", "left_semi")
    several = materialise(real.select("id", "fp").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("id"), "near-several")
    if not real.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "text"])
    texts = materialise(texts, "near-texts")

    comps = materialise(nodes.select("id", F.col("id").alias("comp")).distinct(), "near-comps")
    if not several.isEmpty():  # the classes of one id's texts are one component
        reps = real.join(several, "id", "left_semi").select("id", "fp").distinct().join(classes, "fp").select("id", "rep")
        comps = _joined(comps, materialise(reps.join(reps.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")), "near-same-id"))
    # members with the smallest of their hubs; then with all hubs in other components; then within buckets
    pairs = members.where("id <> hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a"))
    comps = _joined(comps, _verified(_similar(pairs, nodes, least), texts, percent, size))
    own, hub = comps.select("id", "comp"), comps.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
    first = pairs.select("a", "b")
    apart = members.where("id <> hub").select("id", "hub").distinct().join(own, "id").join(hub, "hub").where("comp <> hub_comp")
    apart = apart.select(F.col("hub").alias("a"), F.col("id").alias("b")).join(first, ["a", "b"], "left_anti")
    comps = _joined(comps, _verified(_similar(materialise(apart, "near-apart"), nodes, least), texts, percent, size))
    own, hub = comps.select("id", "comp"), comps.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
    found = _block_links(members.join(own, "id").join(hub, "hub"), nodes, texts, percent, size)
    if found is not None:
        comps = _joined(comps, found)

    final = materialise(classes.join(comps.withColumnRenamed("id", "rep"), "rep").select(F.col("fp").alias("cfp"), F.col("comp")), "near-final")
    out = rows.join(final, (F.col("fp") == F.col("cfp")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"), F.coalesce(F.col("comp") == F.col("id"), F.lit(True)).alias("kept"))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle; for small tables.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ 	-
]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + least({SHINGLE}, len(ws)) - 1], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least({SHINGLE}, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.id = w.doc_id
"""
