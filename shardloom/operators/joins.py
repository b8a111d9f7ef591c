"""Lookups between tables, and joins by space, prefix and time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import box_of, squared_distance
from ..functions.text import host, path_of
from ..plans.driver import cut

#: A side of at most so many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000
#: Centres in one array that tasks read.
CENTRES = 20_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(left: DataFrame, right: DataFrame, on: Column | list[str], default: dict | None = None) -> DataFrame:
    out = left.join(right, on, "left")
    return out.fillna(default) if default else out


def nearest(points: DataFrame, centres: DataFrame, point: list[str], centre: list[str], key: str, centre_id: str, within: float | None = None) -> DataFrame:
    """points with the id (nearest) and squared distance (d2) of the nearest centre; null beyond within.

    centres is a parameter table. It is counted, gathered into arrays of CENTRES at most, and every
    task reads one array after the other, keeping the best so far; points do not move. Ties go to
    the smallest id.
    """
    blocks = max(1, -(-centres.count() // CENTRES))
    entry = F.struct(F.col(centre_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in centre])
    kind = dict(centres.dtypes)[centre_id]
    out = points.withColumn("_best", F.lit(None).cast(f"struct<d2:double,id:{kind}>"))
    for n in range(blocks):
        part = centres if blocks == 1 else centres.where(F.pmod(F.xxhash64(centre_id), F.lit(blocks)) == n)
        table = part.agg(F.array_sort(F.collect_list(entry)).alias("_centres"))
        scored = F.transform("_centres", lambda c: F.struct(squared_distance([F.col(p) for p in point], [c[x] for x in centre]).alias("d2"), c["id"].alias("id")))
        allowed = F.filter(scored, lambda s: s["d2"] < F.lit(within)) if within is not None else scored
        out = out.crossJoin(F.broadcast(table)).withColumn("_best", F.least("_best", F.array_min(allowed))).drop("_centres")
    return out.select(*points.columns, F.col("_best.id").alias("nearest"), F.col("_best.d2").alias("d2"))


def neighbours(points: DataFrame, key: str, axes: list[str], radius2: float = 1.0, least2: float = 1e-8, box: float = 1.0) -> DataFrame:
    """Pairs (key, other) of points whose squared distance is in [least2, radius2]; other columns of the second point get other_.

    Every point is sent to the cells that the radius reaches from its own, so the pairs meet by an
    equi-join on the cell.
    """
    reach = max(1, math.ceil(math.sqrt(radius2) / box))
    own = points.select(F.col(key), *axes, *[box_of(F.col(a), box).alias(f"c_{a}") for a in axes])
    spread = own.select(F.col(key).alias(f"other_{key}"), *[F.col(a).alias(f"other_{a}") for a in axes], *[F.col(f"c_{a}") for a in axes])
    for a in axes:
        spread = spread.withColumn(f"c_{a}", F.explode(F.sequence(F.col(f"c_{a}") - reach, F.col(f"c_{a}") + reach)))
    pairs = own.join(spread, [f"c_{a}" for a in axes])
    d2 = squared_distance([F.col(a) for a in axes], [F.col(f"other_{a}") for a in axes])
    return pairs.withColumn("d2", d2).where((F.col("d2") >= least2) & (F.col("d2") <= radius2)).drop(*[f"c_{a}" for a in axes])


def not_blocked(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose path begins with no rule of their host. rules: (host, rule).

    A path is cut at the lengths that rules have (a few, whatever their number), so paths and rules meet
    by an equi-join on host and beginning, and a host with many pages and rules is many keys.
    """
    r = rules.select(F.col("host").alias("_host"), F.col("rule").alias("_begin")).distinct()
    lengths = sorted(int(x[0]) for x in r.select(F.length("_begin")).distinct().collect())
    p = pages.withColumns({"_host": host(F.col(url)), "_path": path_of(F.col(url))})
    paths = p.select("_host", "_path").distinct()
    begins = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    cuts = paths.select("_host", "_path", F.explode(begins).alias("_n")).select("_host", "_path", F.substring("_path", F.lit(1), F.col("_n")).alias("_begin"))
    blocked = cuts.join(r, ["_host", "_begin"], "left_semi").select("_host", "_path").distinct()
    return p.join(blocked, ["_host", "_path"], "left_anti").drop("_host", "_path")


def spaced(df: DataFrame, key: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """Rows at least so many seconds after the row before them of the same key.

    Rows are range-partitioned by key and time, so a key with many rows is in several tasks; a task's
    first row of a key looks at the last one of that key in the tasks before.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(n, key, ts, tie).withColumn("_p", F.spark_partition_id()), "spaced")
    ends = dealt.groupBy(key, "_p").agg(F.max(ts).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(key).orderBy("_p"))
    ends = ends.select(F.col(key).alias("_k"), F.col("_p").alias("_q"), earlier.alias("_earlier"))
    own = dealt.withColumn("_b", F.lag(ts).over(Window.partitionBy(key, "_p").orderBy(ts, tie)))
    both = own.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    before = F.coalesce("_b", "_earlier")
    return both.where(before.isNull() | (F.col(ts) >= before + F.expr(f"interval {seconds} seconds"))).select(*df.columns)


def polite(df: DataFrame, key: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """Rows at least so many seconds after the last accepted row of the same key.

    Sequential in a key: keys are dealt to tasks and streamed in order, so a key's rows need not
    fit in memory.
    """
    cols = df.columns
    rows = df.repartition(key).sortWithinPartitions(key, ts, tie)

    gap = np.timedelta64(seconds, "s")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for part in parts:
            if not len(part):
                continue
            keys, times = part[key].to_numpy(), part[ts].to_numpy("datetime64[us]")
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keep = []
            for a, b in zip(first, [*first[1:], len(part)], strict=True):
                if keys[a] != now:
                    now, last = keys[a], None
                # from one accepted row straight to the next: times of a key are sorted
                at = a if last is None else a + int(np.searchsorted(times[a:b], last + gap))
                while at < b:
                    keep.append(at)
                    last = times[at]
                    at += max(1, int(np.searchsorted(times[at:b], last + gap)))
            yield part.iloc[keep][cols]

    return rows.mapInPandas(run, df.schema)


def block_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices in coordinate form: a (i, k, v), b (k, j, v) -> (i, j, v)."""
    rows = a.select("i", "k", F.col("v").alias("x")).join(b.select("k", "j", F.col("v").alias("y")), "k")
    return rows.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
