"""Dense tables: blocks of neighbouring integer keys with a default for keys never written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import block_place, block_start
from .accumulators import Accumulator

BLOCK = 500


def blocks(df: DataFrame, key: str, value: str, size: int = BLOCK, default: float = 0) -> DataFrame:
    """(block, values): one array of size elements for each block with a key; other elements are default."""
    rows = df.groupBy(block_start(F.col(key), size).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(block_place(F.col(key), size).cast("int"), F.col(value)))).alias("m"))
    return rows.select("block", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(default))).alias("values"))


def block_sums(df: DataFrame, key: str, value: str, size: int = BLOCK) -> DataFrame:
    return df.groupBy(block_start(F.col(key), size).alias("block")).agg(F.count(F.lit(1)).alias("entries"), F.sum(value).alias("total"), F.max(block_place(F.col(key), size)).cast("long").alias("last_place"))


def accumulate(updates: DataFrame, key: str, value: str, acc: Accumulator, size: int = BLOCK, default: float = 0) -> DataFrame:
    """(key, value) of every key of every written block. Each merge begins with the default, also for written keys."""
    starts = updates.select(block_start(F.col(key), size).alias("block")).distinct()
    every = starts.select(F.explode(F.sequence("block", F.col("block") + size - 1)).alias(key), F.lit(default).cast(updates.schema[value].dataType).alias(value))
    return every.unionByName(updates.select(key, value)).groupBy(key).agg(acc(value).alias(value))


def grid(df: DataFrame, a: tuple[str, int, int], b: tuple[str, int, int], value: Column, default: float = 0.0) -> DataFrame:
    """Sums of value for every cell of two ranges (column, first, last); cells without rows have default."""
    spark = df.sparkSession
    cells = spark.range(a[1], a[2] + 1).select(F.col("id").alias(a[0]), F.explode(F.sequence(F.lit(b[1]).cast("long"), F.lit(b[2]).cast("long"))).alias(b[0]))
    sums = df.groupBy(a[0], b[0]).agg(F.sum(value).alias("total"))
    return cells.join(sums, [a[0], b[0]], "left").select(a[0], b[0], F.coalesce("total", F.lit(default)).alias("total"))
