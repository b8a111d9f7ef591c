"""Accumulators, table primitives, lookups and shard runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import log_bucket, scale_to, tile_of
from ..operators import accumulators as acc
from ..operators import dense, joins
from ..operators.sharding import by_domain, by_mod, by_string_hash, longest_first
from ..operators.table import KeyedTable, TableSpec
from ..sources.files import strided
from . import render
from .driver import Snapshots, run_one, run_range, scratch
from .registry import Queries, table

_q = Queries()
QUERIES, ORACLES = _q.functions, _q.sql
mod8 = lambda key: (lambda n: by_mod(key, n))


@_q.add("acc_min", "SELECT l_suppkey, min(l_quantity) AS v FROM lineitem GROUP BY 1")
def acc_min(spark, d):
    return KeyedTable.of(TableSpec(("l_suppkey",), {"v": acc.MIN}), table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("v"))).df


@_q.add("acc_max", "SELECT l_suppkey, max(l_quantity) AS v FROM lineitem GROUP BY 1")
def acc_max(spark, d):
    return KeyedTable.of(TableSpec(("l_suppkey",), {"v": acc.MAX}), table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("v"))).df


@_q.add("acc_sum", "SELECT l_suppkey, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY 1")
def acc_sum(spark, d):
    t = KeyedTable.of(TableSpec(("l_suppkey",), {"v": acc.SUM}), table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("v")))
    return t.pmap({"v": F.round("v", 4)}).df


@_q.add("acc_count", "SELECT l_suppkey, count(*)::BIGINT AS v FROM lineitem GROUP BY 1")
def acc_count(spark, d):
    return KeyedTable.of(TableSpec(("l_suppkey",), {"v": acc.COUNT}), table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("v"))).df


@_q.add("acc_replace", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS v FROM events GROUP BY 1")
def acc_replace(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("v"), F.struct("ts", "event_id").alias("at"))
    return KeyedTable.of(TableSpec(("user_id",), {"v": acc.REPLACE}, order="at"), rows).df.select("user_id", "v")


@_q.add("acc_string_minmax", "SELECT o_custkey, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY 1")
def acc_string_minmax(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("lo"), F.col("o_orderpriority").alias("hi"))
    return KeyedTable.of(TableSpec(("o_custkey",), {"lo": acc.MIN, "hi": acc.MAX}), rows).df


@_q.add("acc_string_concat", "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS v FROM nation GROUP BY 1")
def acc_string_concat(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("v"), "n_nationkey")
    return KeyedTable.of(TableSpec(("n_regionkey",), {"v": acc.CONCAT}, order="n_nationkey"), rows).df.select("n_regionkey", "v")


@_q.add("acc_set_union", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS v FROM events GROUP BY 1")
def acc_set_union(spark, d):
    t = KeyedTable.of(TableSpec(("user_id",), {"v": acc.SET_UNION}), table(spark, d, "events").select("user_id", F.col("event_type").alias("v")))
    return t.df.select("user_id", F.array_join("v", ",").alias("v"))


@_q.add("acc_list_append", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def acc_list_append(spark, d):
    t = KeyedTable.of(TableSpec(("o_custkey",), {"v": acc.LIST_APPEND}), table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("v")))
    return t.df.select("o_custkey", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


@_q.add("acc_vector_sum", "SELECT label, pos, round(sum(x), 4) AS v FROM (SELECT label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def acc_vector_sum(spark, d):
    return acc.vector_sum(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "pos", F.round("total", 4).alias("v"))


@_q.add(
    "acc_sum_retract",
    "SELECT user_id, round(sum(v), 4) AS v FROM (SELECT user_id, value AS v FROM events UNION ALL SELECT user_id, -value FROM events WHERE event_type = 'error') GROUP BY 1",
)
def acc_sum_retract(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("v"), "event_type")
    t = KeyedTable.of(TableSpec(("user_id",), {"v": acc.SUM}), rows)
    return t.update(rows.where("event_type = 'error'").select("user_id", (-F.col("v")).alias("v"))).pmap({"v": F.round("v", 4)}).df


@_q.add("acc_user_udaf", "SELECT user_id, count(*) FILTER (value > 100)::DOUBLE AS v FROM events GROUP BY 1")
def acc_user_udaf(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("value") > 100).cast("double").alias("v"))
    return acc.fold_by_key(rows, ["user_id"], "v", lambda a, b: a + b)


@_q.add("apply_updates", "SELECT o_custkey, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM orders GROUP BY 1")
def apply_updates(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(1).alias("n"), F.col("o_totalprice").alias("total"), F.col("o_totalprice").alias("top"))
    spec = TableSpec(("o_custkey",), {"n": acc.COUNT, "total": acc.SUM, "top": acc.MAX})
    t = KeyedTable.of(spec, rows.where("o_orderkey % 2 = 0")).update(rows.where("o_orderkey % 2 = 1"))
    return t.pmap({"total": F.round("total", 2)}).df


@_q.add("update_set_union", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS v FROM events GROUP BY 1")
def update_set_union(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("v"), "event_id")
    t = KeyedTable.of(TableSpec(("user_id",), {"v": acc.SET_UNION}), rows.where("event_id % 3 = 0"))
    t = t.update(rows.where("event_id % 3 = 1")).update(rows.where("event_id % 3 = 2"))
    return t.df.select("user_id", F.array_join("v", ",").alias("v"))


@_q.add("update_list_append", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS v, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def update_list_append(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("v"), F.lit(1).alias("n"))
    t = KeyedTable.of(TableSpec(("o_custkey",), {"v": acc.LIST_APPEND, "n": acc.COUNT}), rows.where("v % 2 = 0")).update(rows.where("v % 2 = 1"))
    return t.df.select("o_custkey", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"), "n")


@_q.add("table_get", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 UNION ALL SELECT c_custkey, o_custkey, o_totalprice FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def table_get(spark, d):
    spec = TableSpec(("o_orderkey",), {"o_custkey": acc.MAX, "o_totalprice": acc.MAX})
    orders = KeyedTable(spec, table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    one = orders.get(7)
    one = spark.createDataFrame([(7, one["o_custkey"], one["o_totalprice"])] if one else [], orders.df.schema)
    return one.unionByName(orders.lookup(keys))


@_q.add("lookup_default", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def lookup_default(spark, d):
    counts = KeyedTable.of(TableSpec(("c_custkey",), {"n": acc.COUNT}), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("n")))
    return counts.lookup(table(spark, d, "customer").select("c_custkey"), {"n": 0})


@_q.add("fk_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def fk_lookup(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(joins.sized(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


_ORDERS = TableSpec(("o_orderkey",), {"o_totalprice": acc.MAX})


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))


@_q.add("table_contains", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def table_contains(spark, d):
    lines = KeyedTable(TableSpec(("o_orderkey",), {}), _lines(spark, d))
    return lines.contains(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@_q.add("table_not_contains", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def table_not_contains(spark, d):
    lines = KeyedTable(TableSpec(("o_orderkey",), {}), _lines(spark, d))
    return lines.absent(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@_q.add("table_put", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 1.5::DOUBLE ELSE p_retailprice END AS v FROM part")
def table_put(spark, d):
    t = KeyedTable(TableSpec(("p_partkey",), {"v": acc.REPLACE}), table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")))
    return t.put(t.df.where("p_partkey % 10 = 0").select("p_partkey", F.lit(1.5).alias("v"))).df


@_q.add("table_remove", "SELECT p_partkey, p_retailprice AS v FROM part WHERE p_partkey % 10 <> 0")
def table_remove(spark, d):
    t = KeyedTable(TableSpec(("p_partkey",), {"v": acc.REPLACE}), table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")))
    return t.remove(t.df.where("p_partkey % 10 = 0")).df


def _customers(spark, d):
    spec = TableSpec(("c_custkey",), {"c_name": acc.MAX, "c_acctbal": acc.MAX}, shards=8, shard=mod8("c_custkey"))
    return KeyedTable(spec, table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))


@_q.add("table_clear_shard", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 8 <> 3")
def table_clear_shard(spark, d):
    return _customers(spark, d).clear(3).df


@_q.add("table_scan_shard", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 8 = 2")
def table_scan_shard(spark, d):
    return _customers(spark, d).scan(2)


@_q.add("shard_of_key", "SELECT o_orderkey, (o_orderkey % 8)::INT AS shard FROM orders")
def shard_of_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", by_mod("o_orderkey", 8).alias("shard"))


@_q.add("shard_sizes", "SELECT (o_orderkey % 8)::INT AS shard, count(*)::BIGINT AS entries FROM orders GROUP BY 1")
def shard_sizes(spark, d):
    return KeyedTable(TableSpec(("o_orderkey",), {}, shard=mod8("o_orderkey")), table(spark, d, "orders")).shard_sizes()


@_q.add("iterator_first_n", "SELECT shard, c_custkey, r::INT AS row FROM (SELECT (c_custkey % 8)::INT AS shard, c_custkey, row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY c_custkey) AS r FROM customer) WHERE r <= 5")
def iterator_first_n(spark, d):
    return _customers(spark, d).first(5).select("shard", "c_custkey", "row")


@_q.add("pmap_update_in_place", "SELECT p_partkey, round(p_retailprice * 1.1::DOUBLE, 4) AS v FROM part")
def pmap_update_in_place(spark, d):
    t = KeyedTable(TableSpec(("p_partkey",), {"v": acc.REPLACE}), table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")))
    return t.pmap({"v": F.round(F.col("v") * 1.1, 4)}).df


@_q.add("pmap_multi_bind", "SELECT o_orderkey, round(o_totalprice - q, 4) AS v FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def pmap_multi_bind(spark, d):
    orders = KeyedTable(TableSpec(("o_orderkey",), {"v": acc.MAX}), table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")))
    lines = KeyedTable.of(TableSpec(("o_orderkey",), {"q": acc.SUM}), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("q")))
    return orders.pmap({"v": F.round(F.col("v") - F.col("lines_q"), 4)}, {"lines": lines}).df


def _by_shard(df):
    shard = by_mod("s_suppkey", 4)
    return df.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


_BY_SHARD = "SELECT (s_suppkey % 4)::INT AS shard, count(*)::BIGINT AS n, round(sum(s_acctbal), 2) AS total FROM supplier {} GROUP BY 1"


@_q.add("run_one_shard", _BY_SHARD.format("WHERE s_suppkey % 4 = 0"))
def run_one_shard(spark, d):
    return _by_shard(run_one(table(spark, d, "supplier"), by_mod("s_suppkey", 4)))


@_q.add("run_all_shards", _BY_SHARD.format(""))
def run_all_shards(spark, d):
    return _by_shard(table(spark, d, "supplier"))


@_q.add("run_range_shards", _BY_SHARD.format("WHERE s_suppkey % 4 IN (1, 3)"))
def run_range_shards(spark, d):
    return _by_shard(run_range(table(spark, d, "supplier"), by_mod("s_suppkey", 4), [1, 3]))


@_q.add("map_shards", _BY_SHARD.format(""))
def map_shards(spark, d):
    import pandas as pd

    t = KeyedTable(TableSpec(("s_suppkey",), {"s_acctbal": acc.MAX}, shards=4, shard=mod8("s_suppkey")), table(spark, d, "supplier").select("s_suppkey", "s_acctbal"))
    return t.map_shards(lambda s, pdf: pd.DataFrame({"shard": [s], "n": [len(pdf)], "total": [round(float(pdf["s_acctbal"].sum()), 2)]}), "shard int, n long, total double")


@_q.add("map_shards_setup", _BY_SHARD.format(""))
def map_shards_setup(spark, d):
    """The same by a kernel that is set up once for each shard."""
    import pandas as pd

    t = KeyedTable(TableSpec(("s_suppkey",), {"s_acctbal": acc.MAX}, shards=4, shard=mod8("s_suppkey")), table(spark, d, "supplier").select("s_suppkey", "s_acctbal"))
    add = lambda own, s, pdf: pd.DataFrame({"shard": [own["shard"]], "n": [len(pdf)], "total": [round(float(pdf["s_acctbal"].sum()), 2)]})
    return t.map_shards(add, "shard int, n long, total double", setup=lambda shard: {"shard": shard})


@_q.add("strided_generate", "SELECT (i % 8)::INT AS shard, count(*)::BIGINT AS n, sum(i)::BIGINT AS total FROM range(0, 1000) t(i) GROUP BY 1")
def strided_generate(spark, d):
    return strided(spark, 1000, 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


@_q.add("dense_blocks", "SELECT p_partkey - p_partkey % 500 AS block, count(*)::BIGINT AS entries, sum(p_size)::BIGINT AS total, max(p_partkey % 500)::BIGINT AS last_place FROM part GROUP BY 1")
def dense_blocks(spark, d):
    return dense.block_sums(table(spark, d, "part"), "p_partkey", "p_size")


@_q.add(
    "dense_accumulate",
    "SELECT k AS key, CASE WHEN m < 0 THEN m ELSE 0 END AS v FROM (SELECT b.block + o AS k, min(s_acctbal) AS m FROM (SELECT DISTINCT s_suppkey - s_suppkey % 16 AS block FROM supplier) b, range(0, 16) r(o) LEFT JOIN supplier ON s_suppkey = b.block + o GROUP BY 1)",
)
def dense_accumulate(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v"))
    return dense.accumulate(rows, "key", "v", acc.MIN, 16)


@_q.add(
    "dense_grid_fill",
    "SELECT a, b, round(coalesce(t, 0.0::DOUBLE), 4) AS total FROM (SELECT unnest(range(0, max(l_suppkey) + 2)) AS a FROM lineitem), (SELECT y::BIGINT AS b FROM range(1, 9) r(y)) LEFT JOIN (SELECT l_suppkey AS i, l_linenumber AS j, sum(l_quantity) AS t FROM lineitem GROUP BY 1, 2) ON i = a AND j = b",
)
def dense_grid_fill(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), "l_quantity")
    last = int(rows.agg(F.max("a")).first()[0] or 0)
    return dense.grid(rows, ("a", 0, last + 1), ("b", 1, 8), F.col("l_quantity")).withColumn("total", F.round("total", 4))


#: Spheres of the frame (x, y, z, radius, brightness), in units of its height.
_SPHERES = ((0.5, 0.5, 0.0, 0.375, 1.0), (0.875, 0.375, 0.25, 0.25, 0.75), (1.25, 0.75, -0.125, 0.1875, 0.5))


@_q.add(
    "trace_frame",
    "WITH p AS (SELECT r, c, (c + 0.5::DOUBLE) / 48 AS x, (r + 0.5::DOUBLE) / 48 AS y FROM range(0, 48) a(r), range(0, 64) b(c)), s(sx, sy, sz, sr, sb) AS (VALUES "
    + ", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in s) + ")" for s in _SPHERES)
    + "), h AS (SELECT r, c, sqrt(sr * sr - (x - sx) * (x - sx) - (y - sy) * (y - sy)) AS up, sz, sr, sb FROM p, s WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) < sr * sr),"
    " v AS (SELECT r, c, arg_max(floor(up / sr * sb * 255), sz + up)::INT AS v FROM h GROUP BY 1, 2) SELECT p.r AS \"row\", p.c AS col, coalesce(v, 0)::INT AS v FROM p LEFT JOIN v ON v.r = p.r AND v.c = p.c",
)
def trace_frame(spark, d):
    return render.trace_frame(spark, 48, 64, 16, _SPHERES)


@_q.add("dense_tiles", "SELECT p_partkey - p_partkey % 16 AS tile_a, p_size - p_size % 16 AS tile_b, count(*)::BIGINT AS n, sum((p_partkey % 16) * 16 + p_size % 16)::BIGINT AS places FROM part GROUP BY 1, 2")
def dense_tiles(spark, d):
    a, b, place = tile_of(F.col("p_partkey"), F.col("p_size"), 16)
    rows = table(spark, d, "part").select(a.alias("tile_a"), b.alias("tile_b"), place.alias("p"))
    return rows.groupBy("tile_a", "tile_b").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("places"))


@_q.add("log_histogram", "SELECT CASE WHEN value < 1e-9 THEN 0 ELSE 1 + floor(ln(value / 1e-9::DOUBLE + 1.1::DOUBLE) / ln(1.1::DOUBLE)) END::BIGINT AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1")
def log_histogram(spark, d):
    return table(spark, d, "events").groupBy(log_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_q.add("stats_merge", "SELECT event_type, count(*)::BIGINT AS calls, round(sum(value), 4) AS total, max(value) AS longest FROM events GROUP BY 1")
def stats_merge(spark, d):
    """Statistics of three workers, each of its own events, merged."""
    events = table(spark, d, "events")
    parts = [acc.stats_of(events.where(F.pmod("event_id", F.lit(3)) == n), ["event_type"], "value") for n in range(3)]
    return acc.merge_stats(*parts, keys=["event_type"]).select("event_type", "calls", F.round("total", 4).alias("total"), "longest")


@_q.add("method_stats", "SELECT event_type, count(*)::BIGINT AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def method_stats(spark, d):
    return acc.merge_stats(acc.stats_of(table(spark, d, "events"), ["event_type"], "value"), keys=["event_type"]).select("event_type", "calls", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@_q.add("minmax_scale", "SELECT p_partkey, floor((p_retailprice - lo) / (hi - lo) * 255)::INT AS v FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def minmax_scale(spark, d):
    part = table(spark, d, "part")
    ends = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return part.crossJoin(F.broadcast(ends)).select("p_partkey", scale_to(F.col("p_retailprice"), F.col("lo"), F.col("hi")).alias("v"))


@_q.add("checkpoint_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def checkpoint_roundtrip(spark, d):
    snaps = Snapshots(spark, scratch(spark, "snapshots"))
    snaps.save({"customer": _customers(spark, d).clear().df}, {"step": 0})
    snaps.save({"customer": _customers(spark, d).df}, {"step": 1})
    tables, variables = snaps.restore()
    return tables["customer"].where(F.lit(variables["step"] == 1))


@_q.add("domain_shard", "SELECT lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) AS domain, count(*)::BIGINT AS pages, 1::BIGINT AS shards, true AS inside FROM pages GROUP BY 1")
def domain_shard(spark, d):
    """Pages of each domain, in how many shards they lie, and whether these are shards that exist."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/:?#]*)", 1))
    rows = table(spark, d, "pages").select(host.alias("domain"), by_domain(F.concat_ws(" ", host, "url"), 16).alias("shard"))
    counts = rows.groupBy("domain", "shard").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("domain").agg(F.sum("n").alias("pages"), F.count("shard").alias("shards"), F.min(F.col("shard").between(0, 15)).alias("inside"))


_M = 0xFFFFFFFF
#: The compatible hash of ASCII texts: rounds over pairs of 16-bit halves, the rest by its length, three last rounds.
_HASH = f"""WITH b AS (SELECT c_custkey, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT) AS b FROM customer),
r AS (SELECT c_custkey, b, len(b) AS n, len(b) % 4 AS rest, list_reduce(list_prepend(len(b)::BIGINT, list_transform(range(0, len(b) // 4), lambda k: b[4 * k + 1] + b[4 * k + 2] * 256 + b[4 * k + 3] * 65536 + b[4 * k + 4] * 16777216)),
  lambda h, v: list_reduce([h, 0, 1, 2]::BIGINT[], lambda x, k: CASE k WHEN 0 THEN (x + (v & 65535)) & {_M} WHEN 1 THEN xor((x << 16) & {_M}, xor(((v >> 16) << 11) & {_M}, x)) ELSE (x + (x >> 11)) & {_M} END)) AS h FROM b),
t AS (SELECT c_custkey, list_reduce([h, 0, 1, 2]::BIGINT[], lambda x, k: CASE
  WHEN rest = 0 THEN x
  WHEN k = 0 THEN (x + CASE WHEN rest = 1 THEN b[n] ELSE b[n - rest + 1] + b[n - rest + 2] * 256 END) & {_M}
  WHEN k = 1 THEN xor(xor(x, (x << [10, 11, 16][rest]) & {_M}), CASE WHEN rest = 3 THEN b[n] * 262144 ELSE 0 END)
  ELSE (x + (x >> [1, 17, 11][rest])) & {_M} END) AS h FROM r),
f AS (SELECT c_custkey, list_reduce([h, 0, 1, 2, 3, 4, 5]::BIGINT[], lambda x, k: CASE WHEN k % 2 = 0 THEN xor(x, (x << [3, 4, 25][k // 2 + 1]) & {_M}) ELSE (x + (x >> [5, 17, 6][k // 2 + 1])) & {_M} END) AS h FROM t)
SELECT c_custkey, (h % 8)::INT AS shard FROM f"""


@_q.add("superfasthash", _HASH)
def superfasthash(spark, d):
    return table(spark, d, "customer").select("c_custkey", by_string_hash(F.col("c_name"), 8).alias("shard"))


@_q.add(
    "lpt_assignment",
    """WITH RECURSIVE s AS (SELECT shard, n, row_number() OVER (ORDER BY n DESC, shard) AS r FROM (SELECT (l_suppkey % 32)::INT AS shard, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)),
t AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0]::DOUBLE[] AS loads, -1 AS shard, -1 AS worker, 0::DOUBLE AS size
UNION ALL SELECT s.r, list_transform([1, 2, 3, 4], lambda k: loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN s.n ELSE 0 END), s.shard, list_position(loads, list_min(loads)) - 1, s.n FROM t JOIN s ON s.r = t.r + 1)
SELECT shard, worker::INT AS worker, size FROM t WHERE r > 0""",
)
def lpt_assignment(spark, d):
    sizes = {int(r["shard"]): float(r["entries"]) for r in KeyedTable(TableSpec(("l_suppkey",), {}, shards=32, shard=mod8("l_suppkey")), table(spark, d, "lineitem")).shard_sizes().collect()}
    return spark.createDataFrame(sorted((s, w, sizes[s]) for s, w in longest_first(sizes, 4).items()), "shard int, worker int, size double")
