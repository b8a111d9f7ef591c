"""Runs, ranks, sorted buckets and largest-first choices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.driver import cut


def runs_by_range(df: DataFrame, value: Column, order: list[str], group: str, place: str) -> DataFrame:
    """Number runs of equal neighbours in an order (group), and the rows in each (place), both from 0.

    Rows are range-partitioned by the order, tasks number their own runs, and only the last and first
    value and counts of each task are put in sequence.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written, as the ranges come from a sample and must be the same wherever they are used
    dealt = cut(df.withColumn("_v", value).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_p").orderBy(*order)
    marked = dealt.withColumn("_new", F.coalesce((~F.col("_v").eqNullSafe(F.lag("_v").over(own))).cast("int"), F.lit(1)))
    marked = marked.withColumn("_r", F.row_number().over(own)).withColumn("_new", F.when(F.col("_r") == 1, F.lit(1)).otherwise(F.col("_new")))
    marked = marked.withColumn("_g", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("_p").agg(F.max("_g").alias("groups"), F.min_by("_v", "_r").alias("first"), F.max_by("_v", "_r").alias("last"))
    seq = Window.orderBy("_p")
    ends = ends.withColumn("_joins", F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(seq)) & F.lag("_p").over(seq).isNotNull(), F.lit(False)).cast("int"))
    ends = ends.withColumn("_base", F.sum(F.col("groups") - F.col("_joins")).over(seq.rowsBetween(Window.unboundedPreceding, 0)) - F.col("groups"))
    numbered = marked.join(ends.select("_p", "_base"), "_p").withColumn(group, (F.col("_base") + F.col("_g") - 1).cast("long"))
    sizes = numbered.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_p").orderBy(*order)) - 1
    out = numbered.withColumn("_w", within).join(sizes, [group, "_p"])
    return out.withColumn(place, (F.col("_w") + F.col("_before")).cast("long")).select(*df.columns, group, place)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ranked_in_buckets(df: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """df with its bucket and its place in the bucket's order (rank, from 1), however many rows a bucket has.

    Rows are range-partitioned by bucket and order, so a bucket is sorted by as many tasks as it needs;
    only the counts by task and bucket are summed up.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.withColumn("bucket", bucket).repartitionByRange(n, "bucket", *order).withColumn("_p", F.spark_partition_id()), "buckets")
    counts = dealt.groupBy("bucket", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("bucket", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("bucket", "_p").orderBy(*order))
    return dealt.withColumn("_own", own).join(counts, ["bucket", "_p"]).select("bucket", *df.columns, (F.col("_own") + F.col("_before")).cast("long").alias("rank"))


#: Fixed values of the public integer-sort benchmark: multiplier, seed, modulus 2^MODULUS, bits of a bucket.
MULTIPLIER, SEED, MODULUS, BUCKET_BITS = 5**13, 314159625, 47, 16


def lehmer_block(first: int, n: int, seed: int = SEED) -> np.ndarray:
    """Keys first to first + n - 1: powers of the multiplier modulo 2^47, cut to 32 bits. The first power is reached by squaring."""
    x = np.full(n, MULTIPLIER, np.uint64)
    x[:1] = seed * pow(MULTIPLIER, first + 1, 1 << MODULUS) % (1 << MODULUS)
    # products modulo 2^64 have the right bits below 2^47
    return np.multiply.accumulate(x) & np.uint64((1 << MODULUS) - 1) & np.uint64(0xFFFFFFFF)


def lehmer_keys(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """(i, key): the benchmark's first n keys; every task jumps to its own place in the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids of a range are consecutive inside a batch
            if batch.num_rows:
                keys = lehmer_block(batch.column(0)[0].as_py(), batch.num_rows, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.astype(np.int64))], names=["i", "key"])

    return spark.range(n).mapInArrow(run, "i long, key long")
