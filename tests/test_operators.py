import random
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.functions import hashing, numeric, text
from shardloom.operators import accumulators as acc
from shardloom.operators import dense, joins, ordering
from shardloom.operators.sharding import by_mod, longest_first
from shardloom.operators.table import KeyedTable, Registry, TableSpec
from shardloom.plans import crawl, graph, learning
from shardloom.plans.driver import ShardedState, Snapshots, Stats, cut, iterate
from shardloom.sources import files


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("s,want", [("", []), ("a", ["a"]), ("a b", ["a", "b"]), ("a  b", ["a", "", "b"]), (" a", ["", "a"]), ("a ", ["a"]), ("a  ", ["a", ""]), ("  ", ["", ""])])
def test_split(spark, s, want):
    assert col(spark, s, lambda v: text.split_chars(v, " ")) == want


def test_strip(spark):
    assert col(spark, "\t  abc def;\x0b \n", text.strip) == "abc def;"


@pytest.mark.parametrize("s,want", [("", 0), ("a", 291415938), ("ab", 1366002500), ("abc", 3535673738), ("abcd", 3671636187), ("hello world", 2794219650)])
def test_string_hash(s, want):
    assert hashing.super_fast_hash(s.encode()) == want


@pytest.mark.parametrize("v,want", [(0.0, 0), (1e-10, 0), (1e-9, 8), (1e-6, 73), (0.5, 211), (1.0, 218), (100.0, 266)])
def test_log_bucket(spark, v, want):
    assert col(spark, v, numeric.log_bucket, "double") == want


@pytest.mark.parametrize("v", [2e-9, 1e-6, 0.5, 77.0])
def test_bucket_value_and_bar(spark, v):
    """A value lies between the beginnings of its bucket and the next but one; bars are parts of the width."""
    row = spark.createDataFrame([(v,)], "v double").select(numeric.bucket_value(numeric.log_bucket(F.col("v"))), numeric.bucket_value(numeric.log_bucket(F.col("v")) + 2), numeric.bar_length(F.lit(3), F.lit(4))).first()
    assert row[0] - 2e-9 <= v * 1.1 and v <= row[1] and row[2] == 60


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k int, v array<double>")
    assert {r["k"]: r["total"] for r in acc.vectors(acc.vector_sum(df, ["k"], "v"), ["k"]).collect()} == {1: [4.0, 6.0], 2: [5.0, 6.0]}


@pytest.mark.parametrize("h,want", [("www.foo.co.uk", "foo.co.uk"), ("a.www.foo.com", "foo.com"), ("a.b.c.ck", "b.c.ck"), ("localhost", "localhost"), ("foo.com", "foo.com")])
def test_registered_domain(spark, h, want):
    assert col(spark, h, lambda v: text.registered_domain(v, ["com", "co.uk", "*.ck"])) == want


@pytest.mark.parametrize("target,want", [("/a#x", "http://h.com/a"), ("b", "http://h.com/p/b"), ("http://o.com/c", "http://o.com/c"), ("//o.com/d", "http://o.com/d"), ("?q=1", "http://h.com/p/i?q=1"), ("#f", "http://h.com/p/i?z")])
def test_join_url(spark, target, want):
    assert col(spark, target, lambda v: text.join_url(F.lit("http://h.com/p/i?z"), v)) == want


def test_robots(spark):
    assert col(spark, "User-agent: *\nDisallow: /a*\nDisallow:/b \nDisallow: /a\nDisallow:\n", text.robots_rules) == ["/a", "/b"]


def test_many_hashes():
    rng = random.Random(4)
    texts = [rng.randbytes(rng.randint(0, 23)) for _ in range(400)] + [b"", b"\xff", b"\x80\xff\xfe"]
    assert hashing.hash_many(texts).tolist() == [hashing.super_fast_hash(t) for t in texts]


def test_sorting_keys(spark):
    keys = [r["key"] for r in ordering.lehmer_keys(spark, 3).orderBy("i").collect()]
    assert keys == [3286280765, 410418305, 413559317] and [k & 0xFFFF for k in keys] == [43581, 31873, 27157]
    x, want = ordering.SEED, []
    for _ in range(3000):
        x = x * 5**13 % 2**47
        want.append(x & 0xFFFFFFFF)
    assert [r["key"] for r in ordering.lehmer_keys(spark, 3000).orderBy("i").collect()] == want


def test_ranks_in_buckets(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 40)) for k in range(500)]
    got = ordering.ranked_in_buckets(spark.createDataFrame(rows, "k long, v long"), F.when(F.col("k") < 400, 0).otherwise(1), "v", "k").collect()
    for bucket in (0, 1):
        own = sorted((v, k) for k, v in rows if (k >= 400) == bucket)
        assert [(r["v"], r["k"]) for r in sorted((r for r in got if r["bucket"] == bucket), key=lambda r: r["rank"])] == own


UPDATES = [(1, 5, 0), (1, 3, 1), (2, 7, 2), (1, 4, 3)]


@pytest.mark.parametrize("rule,want", [(acc.MIN, {1: 3, 2: 7}), (acc.MAX, {1: 5, 2: 7}), (acc.SUM, {1: 12, 2: 7}), (acc.REPLACE, {1: 4, 2: 7}), (acc.COUNT, {1: 3, 2: 1}), (acc.LIST_APPEND, {1: [3, 4, 5], 2: [7]}), (acc.SET_UNION, {1: [3, 4, 5], 2: [7]})])
def test_accumulators_in_any_order(spark, rule, want):
    rows = list(UPDATES)
    random.Random(rule.name).shuffle(rows)
    t = KeyedTable.of(TableSpec(("k",), {"v": rule}, order="o" if rule.ordered else None), spark.createDataFrame(rows, "k int, v int, o int"))
    assert {r["k"]: r["v"] for r in t.df.collect()} == want


@pytest.mark.parametrize("rule,want", [(acc.SET_UNION, {1: [3, 4, 5], 2: [7, 9], 3: [1]}), (acc.LIST_APPEND, {1: [3, 4, 4, 5], 2: [7, 9], 3: [1, 1]}), (acc.COUNT, {1: 4, 2: 2, 3: 2})])
def test_updates_of_sets_lists_and_counts(spark, rule, want):
    """Raw updates merge into what a table holds, over several rounds."""
    t = KeyedTable.of(TableSpec(("k",), {"v": rule}), spark.createDataFrame([(1, 5), (1, 4), (2, 7)], "k int, v int"))
    t = t.update(spark.createDataFrame([(1, 3), (3, 1), (3, 1)], "k int, v int")).update(spark.createDataFrame([(1, 4), (2, 9)], "k int, v int"))
    assert {r["k"]: r["v"] for r in t.df.collect()} == want


def test_folds_by_key(spark):
    rows = [(k % 3, float(k)) for k in range(1, 40)] + [(1, None), (None, 2.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    got = {r["k"]: r["v"] for r in acc.fold_by_key(df, ["k"], "v", lambda a, b: max(a, b)).collect()}
    assert got == {0: 39.0, 1: 37.0, 2: 38.0, None: 2.0}
    assert {r["k"]: r["v"] for r in acc.fold_by_key(df, ["k"], "v", np.add).collect()} == {k: sum(v for q, v in rows if q == k and v is not None) for k in (0, 1, 2, None)}


def test_kernel_instances_are_made_once():
    from shardloom.operators import table

    made = []
    for _ in range(3):
        assert table.instance("kernel", 2, lambda s: made.append(s) or f"for {s}") == "for 2"
    assert made == [2]


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    centres = [(k, rng.random(), rng.random()) for k in range(40)] + [(40, 0.5, 0.5), (41, 0.5, 0.5)]
    points = [(k, rng.random(), rng.random()) for k in range(60)] + [(60, 0.5, 0.5)]
    monkeypatch.setattr(joins, "CENTRES", 9)
    got = joins.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(centres, "c long, x double, y double"), ["x", "y"], ["x", "y"], "id", "c", within=0.01)
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, c) for c, a, b in centres) for i, x, y in points}
    assert {r["id"]: r["nearest"] for r in got.collect()} == {i: c if d < 0.01 else None for i, (d, c) in want.items()}


@pytest.mark.parametrize("radius2", [0.5, 1.0, 6.0])
def test_neighbours_of_any_radius(spark, radius2):
    rng = random.Random(7)
    points = [(k, rng.uniform(-4, 4), rng.uniform(-4, 4)) for k in range(50)]
    got = joins.neighbours(spark.createDataFrame(points, "id long, x double, y double"), "id", ["x", "y"], radius2)
    want = {(a, b) for a, x, y in points for b, u, v in points if 1e-8 <= (x - u) ** 2 + (y - v) ** 2 <= radius2}
    assert {(r["id"], r["other_id"]) for r in got.collect()} == want


def test_spacing(spark):
    import datetime

    rng, zero = random.Random(8), datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice("aaab"), zero + datetime.timedelta(seconds=rng.randint(0, 3000))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    want_gate, want_polite = set(), set()
    for key in "ab":
        before = last = None
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            if before is None or (t - before).total_seconds() >= 40:
                want_gate.add(i)
            if last is None or (t - last).total_seconds() >= 40:
                want_polite.add(i)
                last = t
            before = t
    assert {r["id"] for r in joins.spaced(df, "k", "ts", 40, "id").collect()} == want_gate
    assert {r["id"] for r in joins.polite(df, "k", "ts", 40, "id").collect()} == want_polite


def test_rules_block_beginnings(spark):
    pages = [("http://a.com/x/1",), ("http://a.com/y",), ("http://b.com/x/1",), ("http://a.com/",), ("http://a.com/xy",)]
    rules = spark.createDataFrame([("a.com", "/x"), ("a.com", "/y/long"), ("b.com", "/q")], "host string, rule string")
    df = spark.createDataFrame(pages, "url string")
    assert {r["url"] for r in joins.not_blocked(df, rules).collect()} == {"http://a.com/y", "http://b.com/x/1", "http://a.com/"}
    assert joins.not_blocked(df, rules.limit(0)).count() == 5


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-50, 50)), min_size=1, max_size=30), st.integers(0, 30))
def test_update_equals_one_fold(spark, rows, at):
    df = spark.createDataFrame(rows, "k int, v int")
    spec = TableSpec(("k",), {"v": acc.SUM})
    whole = KeyedTable.of(spec, df).df.collect()
    parts = KeyedTable.of(spec, spark.createDataFrame(rows[:at], df.schema)).update(spark.createDataFrame(rows[at:], df.schema)).df.collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_table_self_check(spark):
    """Every shard writes keys 0..n-1: min, max and replace give the key, sums the number of shards."""
    n, shards = 50, 3
    rows = spark.range(n).crossJoin(spark.range(shards).withColumnRenamed("id", "s")).select(F.col("id").alias("k"), F.col("id").alias("lo"), F.col("id").alias("hi"), F.lit(1).alias("s1"), F.col("id").cast("string").alias("r"), F.col("s").alias("o"))
    spec = TableSpec(("k",), {"lo": acc.MIN, "hi": acc.MAX, "s1": acc.SUM, "r": acc.REPLACE}, shards=4, order="o", shard=lambda n: by_mod("k", n))
    t = KeyedTable.of(spec, rows)
    assert all(r["lo"] == r["hi"] == r["k"] and r["s1"] == shards and r["r"] == str(r["k"]) for r in t.rows())
    assert t.get(7)["hi"] == 7 and t.get(99) is None and t.get(99, default={"hi": 0}) == {"hi": 0}
    with pytest.raises(KeyError):
        t.get(99, strict=True)
    assert t.clear(1).size() == 37 and t.clear().empty() and {r["shard"]: r["entries"] for r in t.shard_sizes().collect()} == {0: 13, 1: 13, 2: 12, 3: 12}
    assert t.remove(spark.range(10).select(F.col("id").alias("k"))).size() == 40
    r = Registry()
    r.add(t)
    with pytest.raises(ValueError):
        r.add(t)


def test_negative_keys_have_shards(spark):
    assert {r[0] for r in spark.range(-8, 8).select(by_mod("id", 4)).collect()} == {0, 1, 2, 3}


def test_dense_defaults(spark):
    rows = spark.createDataFrame([(1, 5)], "k long, v long")
    assert {r["k"]: r["v"] for r in dense.accumulate(rows, "k", "v", acc.MIN, 4).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert dense.blocks(rows, "k", "v", 4).first()["values"] == [0, 5, 0, 0]


def test_page_rank(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (4, 3)], "src long, dst long")
    for steps, want in ((1, [0.2, 0.2, 0.2, 0.2]), (2, [0.36, 0.28, 0.6, 0.2]), (3, [0.68, 0.344, 0.728, 0.2]), (4, [0.7824, 0.472, 0.9072, 0.2])):
        got = {r["node"]: r["rank"] for r in graph.page_rank(edges, steps, every=2).collect()}
        assert np.allclose([got[k] for k in (1, 2, 3, 4)], want)


def test_page_rank_of_a_page_with_many_links(spark, monkeypatch):
    edges = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, 0) for k in range(1, 60)] + [(1, 2)], "src long, dst long")
    want = {r["node"]: r["rank"] for r in graph.page_rank(edges, 4).collect()}
    monkeypatch.setattr(graph, "PART_LINKS", 7)
    got = {r["node"]: r["rank"] for r in graph.page_rank(edges, 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_page_rank_sorts_links_once(spark, monkeypatch):
    """A step merges the state into the kept links, without a sort or an exchange of them."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="step": (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.page_rank(edges, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [(len(x) - len(x.lstrip(" :+-*")), x.lstrip(" :+-*")) for x in plans[-1].splitlines()]
    at = next(k for k, (_, x) in enumerate(lines) if x.startswith("InMemoryTableScan") and "dst" in x)
    above = []
    for depth, text in reversed(lines[:at]):
        if depth < (above[-1][0] if above else lines[at][0]):
            above.append((depth, text))
    assert next(text for _, text in above if not text.startswith(("Filter", "Project"))).startswith("SortMergeJoin")


def test_page_rank_of_missing_and_repeated_links_in_parts(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1)] * 30 + [(0, 2), (0, None), (None, 0), (1, 0)] * 3, "src long, dst long")
    want = {r["node"]: r["rank"] for r in graph.page_rank(edges, 3).collect()}
    monkeypatch.setattr(graph, "PART_LINKS", 7)
    got = {r["node"]: r["rank"] for r in graph.page_rank(edges, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_hops(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 0)], "src long, dst long")
    assert {r["node"]: r["hops"] for r in graph.hops(edges, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: -1}


def test_kmeans(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.2, 0.0), (2, 1.0, 1.0), (3, 1.2, 1.0), (4, 9.0, 9.0)], "id long, x double, y double")
    centres = spark.createDataFrame([(0, 0.1, 0.1), (1, 0.9, 0.9)], "centre long, x double, y double")
    got = learning.kmeans_assign(points, centres, ["x", "y"], "id")
    assert [r["nearest"] for r in got.orderBy("id").collect()] == [0, 0, 1, 1, None]
    new = {r["centre"]: (r["x"], r["y"]) for r in learning.kmeans_update(got, ["x", "y"], 2, 4).collect()}
    assert np.allclose(new[0], (0.1, 0)) and np.allclose(new[1], (1.1, 1.0))
    seeded = learning.kmeans_reseed(spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], centres.schema), points.where("id > 1"), ["x", "y"], "id")
    assert all(r["x"] > 0 for r in seeded.collect())


def test_matrix_product(spark):
    n = 6
    two = spark.range(n).select(F.col("id").alias("i")).crossJoin(spark.range(n).select(F.col("id").alias("k"))).withColumn("v", F.lit(2.0))
    out = joins.block_product(two, two.select(F.col("i").alias("k"), F.col("k").alias("j"), "v"))
    assert out.count() == n * n and {r["v"] for r in out.collect()} == {4.0 * n}


def test_training_lowers_the_error(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 4))
    df = spark.createDataFrame([(list(map(float, a)), 0.9 if a[0] > 0.5 else 0.1) for a in x], "x array<double>, t double")
    layers = [rng.standard_normal((5, 6)) * 0.3, rng.standard_normal((7, 1)) * 0.3]
    momentum, errors = [np.zeros_like(w) for w in layers], []
    for _ in range(6):
        layers, momentum, error = learning.train_epoch(df, "x", "t", layers, momentum, eta=2.0)
        errors.append(error)
    assert errors[-1] < errors[0]


def test_particles_at_one_place_are_one(spark):
    p = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (2, 1.5, 1.0, 1.0), (3, 21.0, 1.0, 1.0)], "id long, x double, y double, z double")
    assert sorted(r["id"] for r in learning.particle_step(p, "id", ["x", "y", "z"]).collect()) == [0, 2]


def test_runs_by_range(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, rng.choice("aab") if k % 9 else None) for k in range(300)], "k long, v string")
    got = [(r["k"], r["g"], r["p"]) for r in ordering.runs_by_range(rows, F.col("v"), ["k"], "g", "p").orderBy("k").collect()]
    want, group, place, last = [], -1, 0, object()
    for r in rows.orderBy("k").collect():
        group, place = (group, place + 1) if r["v"] == last else (group + 1, 0)
        want.append((r["k"], group, place))
        last = r["v"]
    assert got == want
    one = rows.withColumn("v", F.lit("same"))
    assert [r["p"] for r in ordering.runs_by_range(one, F.col("v"), ["k"], "g", "p").orderBy("k").collect()] == list(range(300))


def test_longest_first():
    assert longest_first({0: 5, 1: 4, 2: 3, 3: 3}, 2) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_snapshots(spark, tmp_path):
    snaps = Snapshots(spark, f"file://{tmp_path}/s")
    assert snaps.restore() is None
    snaps.save({"t": spark.range(3)}, {"i": 1})
    snaps.save({"t": spark.range(5)}, {"i": 2})
    spark.range(9).write.parquet(f"file://{tmp_path}/s/epoch=00007/table=t")  # never finished
    tables, variables = snaps.restore()
    assert tables["t"].count() == 5 and variables == {"i": 2} and snaps.restore(0)[0]["t"].count() == 3


def test_iterate_and_stats(spark):
    stats = Stats()
    out = stats.timed("loop", lambda: iterate(spark.range(4), lambda df, k: df.select((F.col("id") + 1).alias("id")), 5, every=2))
    assert sorted(r["id"] for r in out.collect()) == [5, 6, 7, 8]
    early = iterate(spark.range(4), lambda df, k: df, 50, done=lambda a, b: a.count() == b.count())
    assert early.count() == 4 and stats.table(spark).first()["calls"] == 1
    assert cut(spark.range(0)).count() == 0


def test_loop_goes_on_after_a_failure(spark, tmp_path):
    """A loop that fails after some steps, run again, begins at the last finished epoch."""
    snaps, seen = Snapshots(spark, f"file://{tmp_path}/loop"), []

    def step(df, k, fail):
        seen.append(k)
        if k == fail:
            raise RuntimeError("lost")
        return df.select((F.col("id") + 1).alias("id"))

    with pytest.raises(RuntimeError):
        iterate(spark.range(3), lambda df, k: step(df, k, 3), 6, snapshots=snaps)
    out = iterate(spark.range(3), lambda df, k: step(df, k, None), 6, snapshots=Snapshots(spark, f"file://{tmp_path}/loop"))
    assert seen == [0, 1, 2, 3, 3, 4, 5] and sorted(r["id"] for r in out.collect()) == [6, 7, 8]


def test_state_by_shard(spark, tmp_path):
    """A batch rewrites the shards it touches, and is merged once."""
    spec = TableSpec(("k",), {"v": acc.SUM}, shards=4, shard=lambda n: by_mod("k", n))
    start = KeyedTable.of(spec, spark.createDataFrame([(k, 1) for k in range(8)], "k long, v long"))
    state = ShardedState(spark, f"file://{tmp_path}/state", start)
    before = state._manifest()["versions"]
    for _ in range(2):
        state.merge(spark.createDataFrame([(1, 10), (5, 20), (9, 5)], "k long, v long"), 0)
    after = state._manifest()["versions"]
    assert {s for s in before if before[s] != after[s]} == {"1"}
    assert {r["k"]: r["v"] for r in state.read().collect()} == {0: 1, 1: 11, 2: 1, 3: 1, 4: 1, 5: 21, 6: 1, 7: 1, 9: 5}


def test_polite_crawl(spark):
    """One page of a host in a step, and none too soon after the last."""
    html = '<a href="/c">c</a>'
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.com/{'ab'[k // 2]}", html) for k in range(4)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("h1.com", "/b")], "host string, rule string")
    seeds = pages.select("url")
    for steps, gap, want in ((1, 60, {0: 4, 4: 2}), (2, 60, {0: 4, 4: 2}), (3, 60, {0: 2, 4: 3, 5: 1}), (2, None, {4: 3, 5: 1, 6: 2})):
        state, _, _, times = crawl.crawl(pages, seeds, rules, steps, gap, step_seconds=30)
        assert {r["status"]: r["count"] for r in state.df.groupBy("status").count().collect()} == want, (steps, gap)
    assert {r["host"]: r["at"] for r in times.df.collect()} == {"h0.com": 30, "h1.com": 30}


def test_crawl_of_a_url_stored_twice(spark):
    """It is fetched once, with the bytes of its largest page, and the links of both are followed."""
    rows = [(0, "http://h.com/a", '<a href="/x">'), (1, "http://h.com/a", '<a href="/y">   '), (2, "http://h.com/b", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, rule string")
    for steps, want, fetched in ((1, {4: 2, 10: 16}, 2), (2, {4: 2, 6: 2, 10: 16}, 4)):
        _, counts, updates, _ = crawl.crawl(pages, pages.select("url"), rules, steps)
        assert {r["status"]: r["n"] for r in updates.df.collect()} == want
        assert [tuple(r) for r in counts.df.select("host", "fetched", "bytes").collect()] == [("h.com", fetched, 16)]


def test_shared_folder_is_wanted_off_one_machine():
    from types import SimpleNamespace

    from shardloom.plans.driver import shared_folder

    session = lambda master, base: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": base}), conf=SimpleNamespace(get=lambda *_: None))
    assert shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and shared_folder(session("local[2]", None)).startswith("file:")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(session("yarn", None))


def test_processes(spark):
    df = spark.range(30_000).select(F.concat(F.lit("line "), "id").alias("v"))
    got = files.through_process(df, "v", ["tr", "a-z", "A-Z"])
    assert got.count() == 30_000 and got.where("line like 'LINE %'").count() == 30_000
    with pytest.raises(Exception, match="ended with"):
        files.through_process(df, "v", ["false"]).collect()


def test_framed_records(spark, tmp_path):
    (tmp_path / "r.bin").write_bytes(files.frame([b"a", b"", b"xyz"]))
    assert [r["payload"] for r in files.framed(spark, str(tmp_path / "r.bin")).orderBy("at").collect()] == [b"a", b"", b"xyz"]
    (tmp_path / "bad.bin").write_bytes(struct.pack("<i", 9) + b"x")
    with pytest.raises(Exception, match="cut off"):
        files.framed(spark, str(tmp_path / "bad.bin")).collect()


def test_greymaps(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes([0, 10, 13, 32, 200, 255]))
    row = files.images(spark, str(tmp_path / "a.pgm")).first()
    assert (row["rows"], row["cols"], row["data"]) == (2, 3, [0, 10, 13, 32, 200, 255])
    plain = spark.createDataFrame([(2, 3, [0, 10, 300, -1, 200, 255])], "r int, c int, d array<int>").select(files.plain_greymap(F.col("r"), F.col("c"), F.col("d"))).first()[0]
    assert files.parse_greymap(plain.encode()) == (2, 3, [0, 10, 0, 0, 200, 255])


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n" + "x" * 20000 + "\nlast")
    got = files.text_lines(spark, str(tmp_path / "*.txt")).collect()
    assert sorted(len(r["value"]) for r in got) == [3, 4, 20000] and got[0]["size"] == 20009


def test_plans_prune_and_push(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 40").groupBy("l_suppkey").agg(F.sum("l_quantity"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan


def test_file_helpers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    assert files.slurp(spark, f"{tmp_path}/a.txt") == "x\ny" and files.path_exists(spark, f"{tmp_path}/a.txt")
    assert files.move(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt") and not files.path_exists(spark, f"{tmp_path}/a.txt")
    files.append_log(spark.range(2), f"{tmp_path}/log")
    files.append_log(spark.range(3), f"{tmp_path}/log")
    assert files.records(spark, f"{tmp_path}/log").count() == 5
    files.write_records(spark.range(4).withColumn("p", F.col("id") % 2), f"{tmp_path}/out", "overwrite", "zstd", "p")
    assert files.records(spark, f"{tmp_path}/out").where("p = 1").count() == 2
    assert files.strided(spark, 5, 2).where("shard = 1").count() == 2


def test_training_equals_a_plain_epoch(spark):
    """Gradients summed by tasks change the weights as a loop over rows does."""
    rng = np.random.default_rng(3)
    x, t = rng.random((40, 3)), rng.random(40)
    w1, w2 = rng.standard_normal((4, 5)), rng.standard_normal((6, 1))
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, t, strict=True)], "x array<double>, t double").repartition(3)
    momentum = [np.full_like(w1, 0.1), np.full_like(w2, -0.2)]
    got, change, error = learning.train_epoch(df, "x", "t", [w1, w2], momentum, eta=0.5, alpha=0.2)
    g1, g2, total = np.zeros_like(w1), np.zeros_like(w2), 0.0
    for a, b in zip(x, t, strict=True):
        a = np.append(1.0, a)
        h = 1 / (1 + np.exp(-(a @ w1)))
        hb = np.append(1.0, h)
        o = float(1 / (1 + np.exp(-(hb @ w2)))[0])
        d = o * (1 - o) * (b - o)
        g2[:, 0] += d * hb
        for j in range(5):
            g1[:, j] += d * w2[j + 1, 0] * h[j] * (1 - h[j]) * a
        total += 0.5 * (b - o) ** 2
    want = [0.5 * g / 40 + 0.2 * m for g, m in zip((g1, g2), momentum, strict=True)]
    assert all(np.allclose(c, v) for c, v in zip(change, want, strict=True)) and abs(error - total / 40) < 1e-12
    assert np.allclose(got[0], w1 + want[0]) and np.allclose(got[1], w2 + want[1])


def test_spread(spark, monkeypatch):
    """A small table of one row group is dealt to all cores with all its rows; a larger one stays where it is."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts = lambda d: d.select(F.spark_partition_id()).distinct().count()
    got = files.spread(df)
    assert parts(df) == 1 and parts(got) == spark.sparkContext.defaultParallelism and sorted(got.collect()) == sorted(df.collect())
    monkeypatch.setattr(files, "SPREAD_BYTES", 10)
    assert parts(files.spread(df)) == 1
