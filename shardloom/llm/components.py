"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v.

    large: every node joins its larger neighbours to its smallest one; small: it joins its
    smaller neighbours, and itself, to the smallest of them. The minima are written before
    they are joined, so that both sides of the join are plain exchanges: AQE can split a
    node with very many neighbours.
    """
    around = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        around = around.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = materialise(around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "star-least")
    joined = around.join(least, "x")
    if large:
        out = joined.where("y > x and y > m").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("x", "y")).alias("u"), F.col("m").alias("v")).where("u > v")
    return out.distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node with an edge, and the smallest node it reaches.

    Only counts and checksums of the edges reach the driver. Null ends and loops are no edges.
    """
    now = edges.where(f"{left} <> {right}").select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).distinct()
    now = materialise(now, "star-edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    while before[0]:
        now = materialise(_star(_star(now, True), False), "star-edges")
        after = sign(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
