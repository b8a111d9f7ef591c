"""Frames by tiles, and greyscale pictures of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import scale_to
from ..operators import dense


def tiles(spark: SparkSession, rows: int, cols: int, size: int) -> DataFrame:
    """(tile, top, left): squares that cover a frame."""
    across = -(-cols // size)
    down = -(-rows // size)
    return spark.range(across * down).select(F.col("id").alias("tile"), (F.floor(F.col("id") / across) * size).alias("top"), (F.col("id") % across * size).alias("left"))


def trace_tile(frame: DataFrame, rows: int, cols: int, size: int, spheres: tuple) -> DataFrame:
    """(row, col, v): the pixels of each tile that a sphere is seen in.

    Rays run straight down on the frame, whose height is 1; the highest point met is seen, as bright
    as it faces up.
    """
    place = lambda name, first, end: F.explode(F.sequence(F.col(first), F.least(F.col(first) + size, F.lit(end)) - 1)).alias(name)
    pixels = frame.select("top", "left", place("row", "top", rows)).select("row", "left").select("row", place("col", "left", cols))
    x, y = ((F.col(c) + 0.5) / rows for c in ("col", "row"))

    def met(sphere) -> Column:
        sx, sy, sz, radius, bright = (F.lit(float(v)) for v in sphere)
        rest = radius * radius - (x - sx) * (x - sx) - (y - sy) * (y - sy)
        near = (x - sx) * (x - sx) + (y - sy) * (y - sy) < radius * radius
        return F.when(near, F.struct((sz + F.sqrt(rest)).alias("height"), F.floor(F.sqrt(rest) / radius * bright * 255).cast("int").alias("v")))

    return pixels.select("row", "col", F.array_max(F.array(*[met(s) for s in spheres])).alias("seen")).where("seen is not null").select("row", "col", F.col("seen.v").alias("v"))


def trace_frame(spark: SparkSession, rows: int, cols: int, size: int, spheres: tuple) -> DataFrame:
    """(row, col, v) of a whole frame: tiles write what they see into a dense table, whose other cells are dark."""
    seen = trace_tile(tiles(spark, rows, cols, size), rows, cols, size, spheres)
    out = dense.grid(seen, ("row", 0, rows - 1), ("col", 0, cols - 1), F.col("v"), 0)
    return out.select("row", "col", F.col("total").cast("int").alias("v"))


def weight_picture(weights: DataFrame, layer: int, unit: int, cols: int) -> DataFrame:
    """(row, col, v): the weights into a hidden unit as pixels of an image, scaled to 0 to 255. weights: (layer, i, j, w), row 0 the bias."""
    own = weights.where((F.col("layer") == layer) & (F.col("j") == unit) & (F.col("i") > 0)).select((F.col("i") - 1).alias("k"), "w")
    ends = own.agg(F.min("w").alias("low"), F.max("w").alias("high"))
    return own.crossJoin(F.broadcast(ends)).select(F.floor(F.col("k") / cols).cast("int").alias("row"), (F.col("k") % cols).cast("int").alias("col"), scale_to(F.col("w"), F.col("low"), F.col("high")).alias("v"))
