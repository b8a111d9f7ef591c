"""Queries through sources and sinks, table handling, loops and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accumulators as acc
from ..operators.sharding import by_hash, by_mod
from ..operators.table import KeyedTable, Registry, TableSpec
from ..sources import files
from . import learning
from .driver import Snapshots, Stats, iterate, scratch
from .registry import Queries, table

_q = Queries()
QUERIES, ORACLES = _q.functions, _q.sql


@_q.add("text_scan", "SELECT line, count(*)::BIGINT AS n, 2::BIGINT AS files FROM (SELECT unnest(string_split(n_name || chr(10) || n_regionkey::VARCHAR, chr(10))) AS line FROM nation) GROUP BY 1")
def text_scan(spark, d):
    """Nations as lines of several text files, found by a pattern, with the files' sizes."""
    at = scratch(spark, "text")
    for part in (0, 1):  # two folders with a file each
        rows = table(spark, d, "nation").where(F.pmod("n_nationkey", F.lit(2)) == part)
        rows.select(F.concat_ws("\n", "n_name", "n_regionkey").alias("value")).coalesce(1).write.text(f"{at}/part-{part}")
    lines = files.text_lines(spark, f"{at}/part-*/*.txt")
    found = spark.read.format("binaryFile").load(f"{at}/part-*/*.txt").select("path").distinct().count()
    return lines.where("size > 0").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n")).withColumn("files", F.lit(found).cast("long"))


@_q.add("whole_file", "SELECT sum(length(n_name))::BIGINT + count(*)::BIGINT AS chars, true AS was_there, false AS is_there FROM nation")
def whole_file(spark, d):
    """A file read as one text, after it was moved."""
    at = scratch(spark, "file")
    table(spark, d, "nation").select("n_name").coalesce(1).write.text(f"{at}/lines")
    name = spark.read.format("binaryFile").load(f"{at}/lines/*.txt").first()["path"]
    before = files.path_exists(spark, name)
    files.move(spark, name, f"{at}/moved")
    text = files.slurp(spark, f"{at}/moved")
    return spark.createDataFrame([(len(text), before, files.path_exists(spark, name))], "chars long, was_there boolean, is_there boolean")


@_q.add("records_partitioned", "SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def records_partitioned(spark, d):
    """Records written in compressed files by status, of which the filter opens some."""
    at = scratch(spark, "records")
    files.write_records(table(spark, d, "orders"), at, "overwrite", "zstd", "o_orderstatus")
    back = files.records(spark, at).where("o_orderstatus <> 'O'")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_q.add("framed_records", "SELECT c_name AS name, length(c_name)::INT AS n FROM customer")
def framed_records(spark, d):
    """Names as length-prefixed records, a file for each task."""
    at = scratch(spark, "framed")
    files.write_framed(table(spark, d, "customer").select(F.col("c_name").cast("binary").alias("payload")), at)
    return files.framed(spark, f"{at}/*.bin").select(F.col("payload").cast("string").alias("name"), F.length("payload").alias("n"))


@_q.add("greymap_roundtrip", "SELECT label, (k // 8)::INT AS \"row\", (k % 8)::INT AS col, v FROM (SELECT label, unnest(range(0, 64)) AS k, unnest(p) AS v FROM (SELECT label, list_transform(range(0, 64), lambda i: least(255, greatest(0, (label * 40 + i * 3)::INT))) AS p FROM (SELECT DISTINCT label FROM embeddings)))")
def greymap_roundtrip(spark, d):
    """An image for each label, written as plain greymaps and read again."""
    at = scratch(spark, "images")
    labels = table(spark, d, "embeddings").select("label").distinct()
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("label") * 40 + i * 3)
    clipped = F.transform(pixels, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v)))
    labels.select(files.plain_greymap(F.lit(8), F.lit(8), clipped).alias("value"), "label").write.partitionBy("label").text(at)
    found = files.images(spark, f"{at}/label=*/*.txt").select(F.regexp_extract("name", "label=(-?[0-9]+)", 1).cast("int").alias("label"), F.posexplode("data").alias("k", "v"))
    return found.select("label", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), "v")


@_q.add("append_log", "SELECT event_type, (2 * count(*))::BIGINT AS n FROM events GROUP BY 1")
def append_log(spark, d):
    at, rows = scratch(spark, "log"), table(spark, d, "events").select("event_id", "event_type")
    for _ in range(2):
        files.append_log(rows, at)
    return files.records(spark, at).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@_q.add("table_dump", "SELECT n_nationkey, n_name FROM nation")
def table_dump(spark, d):
    """All rows of a table, through the driver's iterator."""
    t = KeyedTable.of(TableSpec(("n_nationkey",), {"n_name": acc.MAX}), table(spark, d, "nation").select("n_nationkey", "n_name"))
    return spark.createDataFrame([tuple(r) for r in t.rows()], t.df.schema)


@_q.add("table_empty_and_resized", "SELECT 5::BIGINT AS entries, true AS cleared, 16::INT AS shards, count(*)::BIGINT AS n FROM region")
def table_empty_and_resized(spark, d):
    """A table emptied, and the same dealt to more shards."""
    t = KeyedTable.of(TableSpec(("r_regionkey",), {"r_name": acc.MAX}, shards=4), table(spark, d, "region").select("r_regionkey", "r_name"))
    more = t.resized(16)
    inside = more.shard_sizes().where("shard BETWEEN 0 AND 15").agg(F.sum("entries").alias("n"))
    return inside.select(F.lit(t.size()).cast("long").alias("entries"), F.lit(t.clear().empty()).alias("cleared"), F.lit(more.spec.shards).alias("shards"), "n")


@_q.add("table_swap", "SELECT p_partkey, p_retailprice * 2 AS v FROM part")
def table_swap(spark, d):
    """Two tables by name; after the swap the new version answers to the old name, in SQL too."""
    spec = TableSpec(("p_partkey",), {"v": acc.MAX})
    tables = Registry()
    old = tables.add(KeyedTable(spec, table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")), "swap_old"))
    new = tables.add(KeyedTable(spec, old.pmap({"v": F.col("v") * 2}).df, "swap_new"))
    tables.swap(old.name, new.name)
    return spark.table("swap_old").select("p_partkey", "v")


@_q.add("pair_shard", "SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS pairs, count(DISTINCT l_partkey)::BIGINT AS placed, true AS inside FROM lineitem GROUP BY 1")
def pair_shard(spark, d):
    """A pair of keys has one shard, wherever it occurs."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", by_hash("l_suppkey", "l_partkey", shards=8).alias("shard")).distinct()
    return rows.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("pairs"), F.count(F.lit(1)).alias("placed"), F.min(F.col("shard").between(0, 7)).alias("inside"))


@_q.add("find_text", "SELECT c_custkey, instr(c_name, '00')::INT AS first, c_name = 'Customer#' || printf('%09d', c_custkey) AS same FROM customer")
def find_text(spark, d):
    same = F.col("c_name") == F.concat(F.lit("Customer#"), F.format_string("%09d", "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", F.instr("c_name", "00").alias("first"), same.alias("same"))


@_q.add("number_ranges", "SELECT r_regionkey, unnest(range(r_regionkey, 20, 3))::BIGINT AS v FROM region")
def number_ranges(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.explode(F.sequence("r_regionkey", F.lit(19).cast("long"), F.lit(3).cast("long"))).alias("v"))


@_q.add("image_targets", "SELECT p_partkey, CASE WHEN substr(p_name, 6, 1) = 'p' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS t, p_size / 255.0::DOUBLE AS x FROM part")
def image_targets(spark, d):
    """Targets by name and inputs in units, as the classifier loads its images."""
    rows = table(spark, d, "part").select("p_partkey", learning.target_of(F.col("p_name")).alias("t"), learning.unit_inputs(F.array("p_size"))[0].alias("x"))
    return rows


def _next(df, _):
    return df.select("r_regionkey", (F.col("v") * 2 + 1).alias("v"))


_LOOP = "SELECT r_regionkey, 63::BIGINT AS v FROM region"


@_q.add("loop_with_snapshots", _LOOP)
def loop_with_snapshots(spark, d):
    """Six steps with a rolling snapshot after each; the state of the last epoch."""
    snaps = Snapshots(spark, scratch(spark, "rolling"))
    iterate(table(spark, d, "region").select("r_regionkey", F.lit(0).cast("long").alias("v")), _next, 6, snapshots=snaps, seconds=0.0)
    return snaps.restore()[0]["state"]


@_q.add("loop_after_failure", _LOOP)
def loop_after_failure(spark, d):
    """The same loop, lost in its fourth step and begun again from the last finished epoch."""
    at, start = scratch(spark, "failing"), table(spark, d, "region").select("r_regionkey", F.lit(0).cast("long").alias("v"))
    ran = []

    def failing(df, k):
        if k == 3 and len(ran) == 3:
            ran.append("lost")
            raise RuntimeError("a worker is lost")
        ran.append(k)
        return _next(df, k)

    try:
        iterate(start, failing, 6, snapshots=Snapshots(spark, at))
    except RuntimeError:
        pass
    out = iterate(start, failing, 6, snapshots=Snapshots(spark, at))
    return out.where(F.lit(ran == [0, 1, 2, "lost", 3, 4, 5]))


@_q.add("snapshot_of_some_tables", "SELECT 'nation' AS \"table\", count(*)::BIGINT AS n FROM nation")
def snapshot_of_some_tables(spark, d):
    """Of two tables only the chosen one is in the epoch."""
    every = {name: table(spark, d, name) for name in ("nation", "region")}
    snaps = Snapshots(spark, scratch(spark, "chosen"))
    snaps.save({name: every[name] for name in ["nation"]}, {"round": 1})
    tables, _ = snaps.restore()
    return spark.createDataFrame([(name, df.count()) for name, df in tables.items()], "table string, n long")


@_q.add("run_statistics", "SELECT 'count' AS method, 2::BIGINT AS calls, true AS timed UNION ALL SELECT 'sum', 1, true")
def run_statistics(spark, d):
    stats, rows = Stats(), table(spark, d, "region")
    for _ in range(2):
        stats.timed("count", rows.count)
    stats.timed("sum", lambda: rows.agg(F.sum("r_regionkey")).first())
    return stats.table(spark).select("method", "calls", (F.col("total") >= F.col("longest")).alias("timed"))


@_q.add("shard_owners", "SELECT (s_suppkey % 4)::INT AS shard, count(*)::BIGINT AS n, 1::BIGINT AS tasks FROM supplier GROUP BY 1")
def shard_owners(spark, d):
    """Rows dealt by shard: each shard is owned by one task."""
    shard = by_mod("s_suppkey", 4)
    dealt = table(spark, d, "supplier").withColumn("shard", shard).repartitionById(4, "shard").withColumn("task", F.spark_partition_id())
    return dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks"))
