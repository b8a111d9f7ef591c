"""Rank and distance over edge tables, as deterministic supersteps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import sized
from .driver import cut, iterate, scratch

#: Damping, rank given to every page in each step, distance that counts as unreached.
DAMPING, RESTART, FAR = 0.8, 0.2, 1000


#: Links of a page in one part; a page with more is dealt in several parts.
PART_LINKS = 100_000


def page_rank(edges: DataFrame, steps: int, src: str = "src", dst: str = "dst", every: int = 4, pages: int | None = None) -> DataFrame:
    """(node, rank) after so many steps; repeated links count each time.

    A step gives every page RESTART and every link's target its part of the source's rank. The
    state begins empty, so the first step gives RESTART everywhere. Links move once: they are dealt
    and sorted by their source and kept so, and a step merges the pages' shares into them where they
    are, so that only the sums move. Links of a page with very many are counted by target and dealt
    in parts, and its share is sent to all of them.
    With pages the table is dense: it holds 0 to pages - 1, also those without links, which all get
    RESTART; else it holds the pages that link.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    degree = cut(links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "degree")
    degree = degree.withColumn("parts", F.ceil(F.col("degree") / PART_LINKS).cast("int"))
    heavy = degree.where("parts > 1").select("src", "parts")  # one for each PART_LINKS links at most
    split = not heavy.isEmpty()
    keys = ["src", "part"] if split else ["src"]
    if split:
        heavy = sized(heavy)
        many = links.join(heavy, "src").groupBy("src", "dst", "parts").agg(F.count(F.lit(1)).alias("times"))
        many = many.select("src", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"), "dst", "times")
        links = links.join(heavy, "src", "left_anti").select("src", F.lit(0).alias("part"), "dst", F.lit(1).cast("long").alias("times")).unionByName(many)
    links = links.repartition(n, *keys).sortWithinPartitions(*keys).persist()
    shares = degree.select("src", (F.lit(DAMPING) / F.col("degree")).alias("share"), "parts").repartition(n, "src").sortWithinPartitions("src").persist()
    for kept in (links, shares):
        kept.count()  # how a kept table is dealt and sorted is used only once it is there
    nodes = degree.select(F.col("src").alias("node")) if pages is None else edges.sparkSession.range(pages).select(F.col("id").alias("node"))
    restart = nodes.select("node", F.lit(RESTART).alias("rank"))

    def step(state: DataFrame, _: int) -> DataFrame:
        part = [F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")] if split else []
        own = state.join(shares, state["node"] == shares["src"]).select("src", (F.col("rank") * F.col("share")).alias("each"), *part)
        sent = own.join(links, keys).select(F.col("dst").alias("node"), (F.col("each") * F.col("times") if split else F.col("each")).alias("rank"))
        return restart.unionByName(sent).groupBy("node").agg(F.sum("rank").alias("rank"))

    out = cut(iterate(restart, step, steps - 1, every), "ranks")
    links.unpersist()
    shares.unpersist()
    return out


def hops(edges: DataFrame, source: int, limit: int = 20, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hops): links from the source to every node of the graph, -1 beyond limit or where there is no way.

    Only nodes reached in the last step send on; the loop ends when none is new. Steps are written as
    parts of one table, and the nodes reached so far are read from all of its parts.
    """
    spark = edges.sparkSession
    links = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "links")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    at = scratch(spark, "reached")
    spark.createDataFrame([(source,)], "node long").write.parquet(f"{at}/hops=0")
    part = lambda k: spark.read.schema("node long").parquet(f"{at}/hops={k}")
    reached = lambda: spark.read.schema("node long, hops long").parquet(at)
    for k in range(1, limit + 1):
        front = part(k - 1)
        new = links.join(front, links["src"] == front["node"]).select(F.col("dst").alias("node")).distinct()
        new.join(reached().select("node"), "node", "left_anti").write.parquet(f"{at}/hops={k}")
        if part(k).isEmpty():
            break
    return nodes.join(reached(), "node", "left").select("node", F.when(F.col("hops") < FAR, F.col("hops")).otherwise(F.lit(-1)).cast("long").alias("hops"))
