"""Benchmark decontamination by a prefix-filtered containment join of word shingles.

A benchmark item is a set of windows of consecutive words; equal windows of all items are
one. A window is a sequence of short shingles at known offsets, and a text contains it if
all of them are there at those offsets. Shingles are ordered by rarity, that is by how
often the benchmark has their words, and the rarest one of a window is its necessary
prefix. Only prefixes are joined to the documents, in one pass over the texts. Positions
and lengths bound the window; the survivors carry the words around them, and are verified
word by word. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let, materialise

#: Fixed values of the task: word pattern and window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words in a shingle; shorter items are one shingle.
SHINGLE = 4
#: Prefixes that one pass over the texts looks for: 8 bytes each, broadcast. More of them take more passes.
PASS_PREFIXES = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _token(words: Column, at: Column, k: int) -> Column:
    """64-bit hash of the k words at a place; it finds candidates only."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + n) for n in range(k)])


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(wid, len, k, t, j, win) of each distinct window, with its prefix t at word j; and (wid, item) of those that hold it.

    A shingle's rarity is the sum of the logarithms of its words' counts in the benchmark. Ties go by
    the hash, so that neighbouring windows share a prefix, and then to the first place.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    rows = materialise(rows, "decon-items")
    size = F.least(F.lit(window), F.size("w"))
    held = rows.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda a: F.slice("w", a + 1, size))).alias("win")).distinct()
    held = materialise(held, "decon-held")
    wins = held.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), F.size("win").alias("len"), F.least(F.lit(shingle), F.size("win")).alias("k"), "win")
    wins = materialise(wins, "decon-windows")
    often = rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.log(F.count(F.lit(1)) + 1.0).alias("often"))
    token = lambda j: reduce(lambda other, k: F.when(F.col("k") == k, _token(F.col("win"), j, k)).otherwise(other), range(1, shingle + 1), F.lit(None).cast("long"))
    weights = wins.select("wid", F.posexplode("win").alias("at", "word")).join(often, "word").groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("at", "often"))).alias("ws"))
    rarity = lambda j: F.aggregate(F.slice("ws", j + 1, F.col("k")), F.lit(0.0), lambda a, x: a + x["often"])
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.col("len") - F.col("k")), lambda j: F.struct(F.round(rarity(j), 6).alias("r"), token(j).alias("t"), j.alias("j"))))
    ranked = wins.join(weights, "wid").select("wid", "len", "k", "win", best.alias("b"))
    ranked = materialise(ranked.select("wid", "len", "k", F.col("b.t").alias("t"), F.col("b.j").alias("j"), "win"), "decon-prefixes")
    named = held.where("item is not null").join(wins.select("wid", "win"), "win").select("wid", "item")
    return ranked, materialise(named, "decon-named")


def places(docs: DataFrame, id_col: str, text_col: str, prefixes: DataFrame) -> DataFrame:
    """(uid, id, n_words, pos, t, first, around): places of prefixes with the words around them; and a row with pos -1 for each document.

    around holds the words from place first on that any window with a prefix of that size at pos
    could hold. The texts stay where they are: prefixes are broadcast, in blocks of PASS_PREFIXES. Only
    where there are several blocks are the texts written first, so that all passes number them alike.
    """
    bounds = {int(r["k"]): (int(r["before"]), int(r["after"])) for r in prefixes.groupBy("k").agg(F.max("j").alias("before"), F.max(F.col("len") - F.col("j")).alias("after")).collect()}
    known = materialise(prefixes.select("t").distinct(), "decon-known")
    passes = max(1, -(-known.count() // PASS_PREFIXES))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = (rows if passes == 1 else materialise(rows, "decon-texts")).select("uid", "id", words_of(F.col("text")).alias("w"))

    def tokens(w: Column) -> Column:
        none = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("t")))
        ends = lambda k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), _token(w, i, k).alias("t")))
        of = lambda k: F.when(F.size(w) >= k, ends(k)).otherwise(F.array().cast("array<struct<pos:int,k:int,t:bigint>>"))
        return F.struct(w.alias("w"), F.size(w).cast("long").alias("n_words"), F.concat(none, *[of(k) for k in sorted(bounds)]).alias("p"))

    rows = rows.select("uid", "id", let(F.col("w"), tokens).alias("x")).select("uid", "id", F.col("x.n_words").alias("n_words"), F.col("x.w").alias("w"), F.inline("x.p"))
    by_k = lambda n: reduce(lambda other, k: F.when(F.col("k") == k, F.lit(bounds[k][n])).otherwise(other), bounds, F.lit(0))
    first = F.greatest(F.lit(0), F.col("pos") - by_k(0))
    around = F.when(F.col("pos") >= 0, F.slice("w", first + 1, F.col("pos") - first + by_k(1)))
    out = None
    for n in range(passes):
        block = known if passes == 1 else known.where(F.pmod("t", F.lit(passes)) == n)
        found = rows.join(F.broadcast(block.select(F.col("t").alias("known"))), F.col("t") == F.col("known"), "left").where(F.col("known").isNotNull() | ((F.col("pos") < 0) & F.lit(n == 0)))
        found = materialise(found.select("uid", "id", "n_words", "pos", "t", first.alias("first"), around.alias("around")), "decon-places")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated, longest.

    n_hit counts the words inside any occurrence of an item's window; contaminated
    means that they are at least a twentieth of the words; longest is the number of words
    of the longest window that occurs.

    Defined cases: null, empty and wordless texts have no words and are never
    contaminated; such items have no windows; a null id is passed on, a null item id
    hits but is not listed; repeated rows are counted on their own, repeated items
    once; empty tables give no hits or no rows; a text of any length is read whole, in time
    in proportion to its words; other columns of either table are ignored. Results are exact:
    hashes find candidates only.
    """
    prefixes, named = windows_of(items, item_col, item_text_col, window, shingle)
    found = places(docs, id_col, text_col, prefixes)
    # candidates: the window begins j words before its prefix and ends in the text; then all its words are compared
    start = F.col("pos") - F.col("j")
    at = found.where("pos >= 0").join(prefixes, "t").where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    hit = at.where(F.slice("around", start - F.col("first") + 1, F.col("len")) == F.col("win")).select("uid", "wid", "len", start.alias("start"))
    hit = materialise(hit.distinct(), "decon-hits")
    span = F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)
    words = hit.select("uid", F.explode(span).alias("at")).distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_hit"))
    # documents with the same windows, such as copies, name the same items, which are listed once
    sets = hit.groupBy("uid").agg(F.array_sort(F.collect_set("wid")).alias("wids"), F.max("len").cast("long").alias("longest"))
    sets = materialise(sets.withColumn("key", F.sha2(F.array_join("wids", ","), 256)), "decon-sets")
    each = sets.dropDuplicates(["key"]).select("key", F.explode("wids").alias("wid"))
    listed = each.join(named, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = materialise(listed.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "decon-listed")
    out = found.where("pos = -1").select("uid", "id", "n_words").join(words, "uid", "left").join(sets.drop("wids"), "uid", "left").join(listed, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("longest")


def _sql_words(table: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM {table}"


ORACLE_SQL = rf"""
WITH d AS ({_sql_words("documents", "doc_id")}), i AS ({_sql_words("benchmark", "item_id")}),
iw AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS n, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS a FROM i WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[a : a + n - 1], ' ') AS t FROM iw),
ns AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, ns WHERE len(ws) >= n),
dg AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS t FROM dw),
h AS (SELECT doc_id, item_id, p, dg.n AS n FROM dg JOIN g ON g.n = dg.n AND g.t = dg.t),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + unnest(range(0, n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""
