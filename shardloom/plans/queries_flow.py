"""Graph, learning, sorting, streaming and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import scale_to
from ..operators import joins, ordering
from ..operators.accumulators import COUNT, MAX, SUM
from ..operators.table import KeyedTable, TableSpec
from ..sources.files import random_digraph, site_graph
from ..streaming.accumulate import accumulate, file_stream, merge_into
from . import graph, learning
from .driver import scratch
from .registry import Queries, table

_q = Queries()
QUERIES, ORACLES = _q.functions, _q.sql


def _bipartite(lines: DataFrame) -> DataFrame:
    """Both directions of supplier 2 s and part 2 p + 1."""
    s, p = (F.col("l_suppkey") * 2), (F.col("l_partkey") * 2 + 1)
    return lines.select(F.explode(F.array(F.struct(s.alias("src"), p.alias("dst")), F.struct(p.alias("src"), s.alias("dst")))).alias("e")).select("e.src", "e.dst")


def _rank_sql(steps: int) -> str:
    parts = [
        "WITH e AS MATERIALIZED (SELECT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem UNION ALL SELECT 2 * l_partkey + 1, 2 * l_suppkey FROM lineitem)",
        "g AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY 1)",
        "r1 AS MATERIALIZED (SELECT src AS node, 0.2::DOUBLE AS rank FROM g)",
    ]
    for k in range(2, steps + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT node, sum(rank) AS rank FROM (SELECT src AS node, 0.2::DOUBLE AS rank FROM g UNION ALL SELECT dst, 0.8::DOUBLE * rank / degree FROM e JOIN g USING (src) JOIN r{k - 1} ON node = src) GROUP BY 1)")
    return ", ".join(parts) + f" SELECT node, round(rank, 6) AS rank FROM r{steps}"


@_q.add("pagerank", _rank_sql(4))
def pagerank(spark, d):
    return graph.page_rank(_bipartite(table(spark, d, "lineitem")), 4).select("node", F.round("rank", 6).alias("rank"))


@_q.add("pagerank_10", _rank_sql(10))
def pagerank_10(spark, d):
    return graph.page_rank(_bipartite(table(spark, d, "lineitem")), 10).select("node", F.round("rank", 6).alias("rank"))


@_q.add("pagerank_dense", _rank_sql(4).replace("r1 AS MATERIALIZED (SELECT src AS node, 0.2::DOUBLE AS rank FROM g)", "r1 AS MATERIALIZED (SELECT unnest(range(0, max(src) + 1)) AS node, 0.2::DOUBLE AS rank FROM g)").replace("SELECT src AS node, 0.2::DOUBLE AS rank FROM g UNION ALL", "SELECT node, 0.2::DOUBLE AS rank FROM r1 UNION ALL"))
def pagerank_dense(spark, d):
    """Ranks of all numbers up to the largest page, as a dense table holds them."""
    edges = _bipartite(table(spark, d, "lineitem"))
    last = int(edges.agg(F.max("src")).first()[0] or 0)
    return graph.page_rank(edges, 4, pages=last + 1).select("node", F.round("rank", 6).alias("rank"))


def _hops_sql(steps: int) -> str:
    parts = [
        "WITH e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem UNION ALL SELECT 2 * l_partkey + 1, 2 * l_suppkey FROM lineitem))",
        "n AS MATERIALIZED (SELECT DISTINCT src AS node FROM e)",
        "h0 AS MATERIALIZED (SELECT node, CASE WHEN node = 0 THEN 0 ELSE 1000 END AS h FROM n)",
    ]
    for k in range(1, steps + 1):
        parts.append(f"h{k} AS MATERIALIZED (SELECT node, min(h) AS h FROM (SELECT * FROM h{k - 1} UNION ALL SELECT dst, h + 1 FROM e JOIN h{k - 1} ON node = src) GROUP BY 1)")
    return ", ".join(parts) + f" SELECT node, CASE WHEN h >= 1000 THEN -1 ELSE h END::BIGINT AS hops FROM h{steps}"


@_q.add("sssp", _hops_sql(20))
def sssp(spark, d):
    return graph.hops(_bipartite(table(spark, d, "lineitem")), 0)


def _points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("embedding")[0].cast("double") * 5).alias("x"), (F.col("embedding")[1].cast("double") * 5).alias("y"))


def _assigned(spark, d):
    points = _points(spark, d)
    return learning.kmeans_assign(points, points.where("vec_id < 5").select(F.col("vec_id").alias("centre"), "x", "y"), ["x", "y"], "vec_id")


_KMEANS = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS x, embedding[2]::DOUBLE * 5 AS y FROM embeddings),
c AS (SELECT vec_id AS centre, x AS cx, y AS cy FROM p WHERE vec_id < 5),
a AS (SELECT vec_id, x, y, arg_min(centre, row(d2, centre)) FILTER (d2 < 2) AS nearest FROM (SELECT *, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM p, c) GROUP BY 1, 2, 3)
"""


_KMEANS_STEPS = """WITH p AS MATERIALIZED (SELECT vec_id, embedding[1]::DOUBLE * 5 AS x, embedding[2]::DOUBLE * 5 AS y FROM embeddings),
c0 AS MATERIALIZED (SELECT vec_id AS centre, x AS cx, y AS cy FROM p WHERE vec_id < 5),
a0 AS (SELECT vec_id, x, y, arg_min(centre, row(d2, centre)) FILTER (d2 < 2) AS nearest FROM (SELECT *, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM p, c0) GROUP BY 1, 2, 3),
c1 AS MATERIALIZED (SELECT nearest AS centre, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM a0 WHERE nearest IS NOT NULL GROUP BY 1),
a1 AS (SELECT vec_id, x, y, arg_min(centre, row(d2, centre)) FILTER (d2 < 2) AS nearest FROM (SELECT *, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM p, c1) GROUP BY 1, 2, 3)
SELECT nearest AS centre, round(avg(x), 6) + 0 AS x, round(avg(y), 6) + 0 AS y FROM a1 WHERE nearest IS NOT NULL GROUP BY 1"""


@_q.add("kmeans_assign", _KMEANS + "SELECT vec_id, coalesce(nearest, -1) AS nearest FROM a")
def kmeans_assign(spark, d):
    return _assigned(spark, d).select("vec_id", F.coalesce("nearest", F.lit(-1)).alias("nearest"))


@_q.add("kmeans_update", _KMEANS + "SELECT nearest AS centre, round(sum(x) * 5 / (SELECT count(*) FROM p), 6) + 0 AS x, round(sum(y) * 5 / (SELECT count(*) FROM p), 6) + 0 AS y FROM a WHERE nearest IS NOT NULL GROUP BY 1")
def kmeans_update(spark, d):
    n = table(spark, d, "embeddings").count()
    out = learning.kmeans_update(_assigned(spark, d), ["x", "y"], 5, n)
    return out.select("centre", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@_q.add("kmeans_mean", _KMEANS + "SELECT nearest AS centre, round(avg(x), 6) + 0 AS x, round(avg(y), 6) + 0 AS y FROM a WHERE nearest IS NOT NULL GROUP BY 1")
def kmeans_mean(spark, d):
    out = learning.kmeans_update(_assigned(spark, d), ["x", "y"], 5, 1, "mean")
    return out.select("centre", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


_SCRAMBLE = "(xor({0}, {0} >> 13))".format("(xor({0}, {0} >> 15) * 747796405 % 2147483648)").replace("{0}", "((({x}) % 2147483648 + {s} * 40503) * 1103515245 % 2147483648)")
_UNIT = "(" + _SCRAMBLE + " / 2147483648.0::DOUBLE)"


@_q.add(
    "kmeans_reseed",
    f"""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS x, embedding[2]::DOUBLE * 5 AS y FROM embeddings),
n AS (SELECT row_number() OVER (ORDER BY {_SCRAMBLE.format(x="vec_id", s=1)}, vec_id) - 1 AS centre, x, y FROM p)
SELECT vec_id AS centre, x, y FROM p WHERE vec_id BETWEEN 2 AND 4 UNION ALL SELECT centre, x, y FROM n WHERE centre < 2""",
)
def kmeans_reseed(spark, d):
    points = _points(spark, d)
    centres = points.where("vec_id < 5").select(F.col("vec_id").alias("centre"), *[F.when(F.col("vec_id") < 2, 0.0).otherwise(F.col(a)).alias(a) for a in ("x", "y")])
    return learning.kmeans_reseed(centres, points, ["x", "y"], "vec_id")


@_q.add(
    "matmul",
    "WITH m AS (SELECT vec_id AS k, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) + 0 AS v FROM m a JOIN m b USING (k) GROUP BY 1, 2",
)
def matmul(spark, d):
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "v")).select("k", "i", F.col("v").cast("double").alias("v"))
    return joins.block_product(m, m.select("k", F.col("i").alias("j"), "v")).select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


@_q.add("isort", "SELECT (o_orderkey % 16)::INT AS bucket, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_totalprice, o_orderkey)::INT AS r FROM orders")
def isort(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ranked = ordering.ranked_in_buckets(rows, F.pmod("o_orderkey", F.lit(16)).cast("int"), "o_totalprice", "o_orderkey")
    return ranked.select("bucket", "o_orderkey", F.col("rank").cast("int").alias("r"))


@_q.add(
    "isort_generated",
    """WITH RECURSIVE k AS (SELECT 0::BIGINT AS i, (314159625::HUGEINT * 1220703125 % 140737488355328)::HUGEINT AS x UNION ALL SELECT i + 1, x * 1220703125 % 140737488355328 FROM k WHERE i < 4999),
b AS (SELECT i, (x % 4294967296)::BIGINT AS key FROM k)
SELECT (key % 65536)::INT AS bucket, i, key, row_number() OVER (PARTITION BY key % 65536 ORDER BY key, i)::BIGINT AS rank FROM b""",
)
def isort_generated(spark, d):
    """The benchmark's own keys, dealt to buckets by their low bits and sorted inside."""
    keys = ordering.lehmer_keys(spark, 5000)
    return ordering.ranked_in_buckets(keys, F.pmod("key", F.lit(1 << ordering.BUCKET_BITS)).cast("int"), "key", "i")


def _particles(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[((F.col("embedding")[k].cast("double") + 1) * 10).alias(a) for k, a in enumerate("xyz")])


_PAIRS = """WITH p AS (SELECT vec_id, (embedding[1]::DOUBLE + 1) * 10 AS x, (embedding[2]::DOUBLE + 1) * 10 AS y, (embedding[3]::DOUBLE + 1) * 10 AS z FROM embeddings),
n AS (SELECT a.vec_id, b.vec_id AS other, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a, p b WHERE d2 BETWEEN 1e-8 AND 1)
"""


@_q.add("grid_neighbors", _PAIRS + "SELECT vec_id, count(*)::BIGINT AS n, round(sum(d2), 4) AS total FROM n GROUP BY 1")
def grid_neighbors(spark, d):
    pairs = joins.neighbours(_particles(spark, d), "vec_id", ["x", "y", "z"])
    return pairs.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("total"))


@_q.add(
    "nbody_forces",
    _PAIRS + "SELECT p.vec_id, round(coalesce(sum(dx / d2), 0), 4) + 0 AS fx, round(coalesce(sum(dy / d2), 0), 4) + 0 AS fy, round(coalesce(sum(dz / d2), 0), 4) + 0 AS fz FROM p LEFT JOIN n ON n.vec_id = p.vec_id GROUP BY 1",
)
def nbody_forces(spark, d):
    f = learning.forces(_particles(spark, d), "vec_id", ["x", "y", "z"])
    return f.select("vec_id", *[(F.round(f"f_{a}", 4) + 0.0).alias(f"f{a}") for a in "xyz"])


@_q.add(
    "nbody_step",
    _PAIRS
    + ", f AS (SELECT p.vec_id, x + coalesce(sum(dx / d2), 0) * 1e-6::DOUBLE AS x, y + coalesce(sum(dy / d2), 0) * 1e-6::DOUBLE AS y, z + coalesce(sum(dz / d2), 0) * 1e-6::DOUBLE AS z FROM p LEFT JOIN n ON n.vec_id = p.vec_id GROUP BY p.vec_id, p.x, p.y, p.z) "
    "SELECT round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, vec_id FROM f WHERE x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 20 AND z BETWEEN 0 AND 20",
)
def nbody_step(spark, d):
    out = learning.particle_step(_particles(spark, d), "vec_id", ["x", "y", "z"])
    return out.select(*[F.round(a, 5).alias(a) for a in "xyz"], "vec_id")


_WEIGHTS = [[0.0] + [((k % 5) - 2) * 0.5 for k in range(64)]]


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.when(F.col("label") % 2 == 1, 0.9).otherwise(0.1).alias("t"), learning.forward(F.col("embedding"), _WEIGHTS)[0].alias("o"))


_MLP = """WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
o AS (SELECT vec_id, CASE WHEN label % 2 = 1 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS t, 1 / (1 + exp(-sum(v * ((k % 5) - 2) * 0.5::DOUBLE))) AS o FROM x GROUP BY vec_id, label)
"""


@_q.add("mlp_forward", _MLP + "SELECT vec_id, round(o, 6) AS o FROM o")
def mlp_forward(spark, d):
    return _scored(spark, d).select("vec_id", F.round("o", 6).alias("o"))


@_q.add("classifier_eval", _MLP + "SELECT count(*)::BIGINT AS n, count(*) FILTER ((o > 0.5) = (t > 0.5))::BIGINT AS correct, round(avg(0.5::DOUBLE * (t - o) * (t - o)), 6) AS error FROM o")
def classifier_eval(spark, d):
    return learning.evaluate(_scored(spark, d), F.col("o"), F.col("t")).select("n", "correct", F.round("error", 6).alias("error"))


@_q.add("mlp_train_epoch")
def mlp_train_epoch(spark, d):
    import numpy as np

    e = table(spark, d, "embeddings").select("embedding", F.when(F.col("label") % 2 == 1, 0.9).otherwise(0.1).alias("t"))
    rng = np.random.default_rng(1)
    layers = [rng.standard_normal((65, 16)) * 0.1, rng.standard_normal((17, 1)) * 0.1]
    momentum, errors = [np.zeros_like(w) for w in layers], []
    for _ in range(3):
        layers, momentum, error = learning.train_epoch(e, "embedding", "t", layers, momentum)
        errors.append(error)
    return spark.createDataFrame(list(enumerate(errors)), "epoch int, error double")


@_q.add("sort_last_active", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 20")
def sort_last_active(spark, d):
    t = KeyedTable.of(TableSpec(("user_id",), {"last": MAX}), table(spark, d, "events").select("user_id", F.col("ts").alias("last")))
    return ordering.top(t.df, 20, F.desc("last"), "user_id")


@_q.add("politeness_gate", "SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts >= b + INTERVAL 3600 SECOND")
def politeness_gate(spark, d):
    return joins.spaced(table(spark, d, "events"), "user_id", "ts", 3600, "event_id").select("event_id", "user_id")


@_q.add(
    "politeness_exact",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT event_id, user_id, r, ts AS last, true AS ok FROM o WHERE r = 1
UNION ALL SELECT o.event_id, o.user_id, o.r, CASE WHEN o.ts >= w.last + INTERVAL 3600 SECOND THEN o.ts ELSE w.last END, o.ts >= w.last + INTERVAL 3600 SECOND FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
SELECT event_id, user_id FROM w WHERE ok""",
)
def politeness_exact(spark, d):
    return joins.polite(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600, "event_id").select("event_id", "user_id")


@_q.add("stream_accumulate", "SELECT user_id, count(*)::BIGINT AS n, max(value) AS top FROM events GROUP BY 1")
def stream_accumulate(spark, d):
    like = table(spark, d, "events")
    stream = file_stream(spark, f"{d}/events*.parquet", like)
    return accumulate(stream.select("user_id", F.lit(1).alias("n"), F.col("value").alias("top")), TableSpec(("user_id",), {"n": COUNT, "top": MAX}))


@_q.add("stream_merge", "SELECT user_id, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY 1")
def stream_merge(spark, d):
    like = table(spark, d, "events")
    spec = TableSpec(("user_id",), {"total": SUM, "top": MAX})
    rows = file_stream(spark, f"{d}/events*.parquet", like).select("user_id", F.col("value").alias("total"), F.col("value").alias("top"))
    empty = KeyedTable(spec, like.select("user_id", F.col("value").alias("total"), F.col("value").alias("top")).limit(0))
    at = scratch(spark, "merge")
    return merge_into(rows, empty, at, f"{at}-log").pmap({"total": F.round("total", 4)}).df


_GRAPH = f"""WITH g AS (SELECT page, n, page * 15 + n AS link, floor({_UNIT.format(x="page", s=1)} * {_UNIT.format(x="page", s=1)} * {_UNIT.format(x="page", s=1)} * 20)::BIGINT AS site FROM range(0, 2000) a(page), range(0, 15) b(n)),
e AS (SELECT site, CASE WHEN {_UNIT.format(x="link", s=2)} < 0.9::DOUBLE THEN site ELSE floor({_UNIT.format(x="link", s=3)} * {_UNIT.format(x="link", s=3)} * {_UNIT.format(x="link", s=3)} * 20)::BIGINT END AS other, floor({_UNIT.format(x="link", s=4)} * 2000)::BIGINT AS target FROM g)
SELECT site, count(*)::BIGINT AS links, count(*) FILTER (site = other)::BIGINT AS inside, sum(target)::BIGINT AS targets FROM e GROUP BY 1"""


@_q.add("graph_generate", _GRAPH)
def graph_generate(spark, d):
    return site_graph(spark, 2000).groupBy("site").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("site") == F.col("target_site")).alias("inside"), F.sum("target").alias("targets"))


@_q.add("digraph_generate", f"""SELECT source, {_SCRAMBLE.format(x="source * 4 + n", s=1)} % 1000 AS target FROM range(0, 1000) a(source), range(0, 4) b(n)""")
def digraph_generate(spark, d):
    return random_digraph(spark, 1000)


@_q.add("rescale_counts", "SELECT user_id, floor((n - lo) / (hi - lo) * 255)::INT AS v FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM events GROUP BY user_id))")
def rescale_counts(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return counts.crossJoin(F.broadcast(ends)).select("user_id", scale_to(F.col("n"), F.col("lo"), F.col("hi")).alias("v"))


@_q.add(
    "image_upsample",
    "WITH x AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, (k // 8 * 2 + a) * 16 + k % 8 * 2 + b AS pos, v FROM x, (SELECT i::INT AS a FROM range(0, 2) r(i)), (SELECT i::INT AS b FROM range(0, 2) r(i))",
)
def image_upsample(spark, d):
    from ..functions.numeric import upsample

    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(upsample(F.col("embedding"), 8)).alias("pos", "v"))
    return rows.select("vec_id", "pos", F.col("v").cast("double").alias("v"))


@_q.add("weights_roundtrip", "SELECT layer::INT AS layer, i::INT AS i, j::INT AS j, ((layer * 7 + i * 3 + j) % 11) / 4.0::DOUBLE AS w FROM range(0, 2) a(layer), range(0, 5) b(i), range(0, 4) c(j) WHERE layer = 0 OR j = 0")
def weights_roundtrip(spark, d):
    import numpy as np

    layers = [np.array([[((n * 7 + i * 3 + j) % 11) / 4.0 for j in range(4 if n == 0 else 1)] for i in range(5)]) for n in range(2)]
    at = scratch(spark, "weights")
    learning.layer_rows(spark, layers).write.parquet(at)
    back = learning.layers_of(spark.read.parquet(at))
    return learning.layer_rows(spark, back)


@_q.add("weight_picture", "SELECT (k // 8)::INT AS \"row\", (k % 8)::INT AS col, floor(((k * 5 % 11) / 4.0::DOUBLE - 0) / (2.5::DOUBLE - 0) * 255)::INT AS v FROM range(0, 64) r(k)")
def weight_picture(spark, d):
    """A hidden unit's 64 input weights as a picture of 8 by 8."""
    import numpy as np

    from . import render

    layers = [np.array([[9.0]] + [[(k * 5 % 11) / 4.0] for k in range(64)])]
    return render.weight_picture(learning.layer_rows(spark, layers), 0, 0, 8)


@_q.add("kmeans_iterated", _KMEANS_STEPS)
def kmeans_iterated(spark, d):
    """Two rounds from the first five points, by the mean."""
    points = _points(spark, d)
    centres = points.where("vec_id < 5").select(F.col("vec_id").alias("centre"), "x", "y")
    for _ in range(2):
        assigned = learning.kmeans_assign(points, centres, ["x", "y"], "vec_id")
        centres = learning.kmeans_update(assigned, ["x", "y"], 5, 1, "mean").select("centre", *[F.round(a, 9).alias(a) for a in "xy"])
    return centres.select("centre", *[(F.round(a, 6) + 0.0).alias(a) for a in "xy"])


@_q.add("process_pipe", "SELECT upper(r_name) AS line FROM region")
def process_pipe(spark, d):
    from ..sources.files import through_process

    return through_process(table(spark, d, "region"), "r_name", ["tr", "a-z", "A-Z"])


@_q.add("powerlaw_sites", "SELECT 20::BIGINT AS sites, true AS falling")
def powerlaw_sites(spark, d):
    """Pages by twentieths of the sites: the first has most, the last fewest."""
    sizes = site_graph(spark, 4000, links=1, sites=20).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.agg(F.count(F.lit(1)).alias("sites"), (F.max_by("n", -F.col("site")) > F.max_by("n", "site")).alias("falling"))
    return ends
