"""Numeric expressions: log-bucketed histograms, scaling, geometry, activation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the histogram: base and least value.
BASE, LEAST = 1.1, 1e-9


def log_bucket(v: Column) -> Column:
    """Bucket of a non-negative value: 0 below LEAST, then one for each factor BASE."""
    return F.when(v < F.lit(LEAST), F.lit(0)).otherwise(1 + F.floor(F.log(v / F.lit(LEAST) + F.lit(BASE)) / F.lit(math.log(BASE)))).cast("long")


def bucket_value(b: Column) -> Column:
    """Value at which a bucket begins."""
    return F.exp(F.lit(math.log(BASE)) * (b - 1)) * F.lit(LEAST)


def bar_length(n: Column, total: Column, width: int = 80) -> Column:
    return F.floor(n * width / total).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scale_to(x: Column, low: Column, high: Column, top: int = 255) -> Column:
    """Whole numbers 0 to top by position between low and high; 0 where they are equal."""
    return F.when(high > low, F.floor((x - low) / (high - low) * top)).otherwise(F.lit(0)).cast("int")


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def box_of(x: Column, size: float = 1.0) -> Column:
    """Grid cell, toward zero."""
    return (x / F.lit(size)).cast("int")


def block_start(key: Column, size: int) -> Column:
    return key - F.pmod(key, F.lit(size))


def block_place(key: Column, size: int) -> Column:
    return F.pmod(key, F.lit(size))


def tile_of(a: Column, b: Column, size: int) -> tuple[Column, Column, Column]:
    """(tile of a, tile of b, place in the tile) of a two-dimensional key."""
    return block_start(a, size), block_start(b, size), block_place(a, size) * size + block_place(b, size)


def upsample(pixels: Column, cols: int, times: int = 2) -> Column:
    """An image (rows after one another) with every pixel repeated in both directions."""
    wide = cols * times
    return F.transform(F.sequence(F.lit(0), F.size(pixels) * (times * times) - 1), lambda i: F.get(pixels, F.floor(F.floor(i / wide) / times).cast("int") * cols + F.floor((i % wide) / times).cast("int")))
