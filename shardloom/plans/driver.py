"""Supersteps, shard runs, snapshots and run statistics."""

from __future__ import annotations

import atexit
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..operators.table import KeyedTable


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without, and gets one of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "file:///tmp/shardloom-work").rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's full URL in the shared folder; what is there is removed when the program ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/shardloom-{name}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _made.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written to the shared folder and read again: ends its lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_range(df: DataFrame, shard: Column, shards: list[int]) -> DataFrame:
    return df.where(shard.isin(shards))


def run_one(df: DataFrame, shard: Column) -> DataFrame:
    return run_range(df, shard, [0])


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], steps: int, every: int = 4, done: Callable[[DataFrame, DataFrame], bool] | None = None, snapshots: Snapshots | None = None, seconds: float = 0.0) -> DataFrame:
    """Apply step so often; each reads one version and makes the next. Lineage is cut every few steps.

    done(before, after) may end the loop early. With snapshots, a version is saved as an epoch whenever
    the last one is so many seconds old, and a loop that is run again goes on from the last finished
    epoch.
    """
    first = 0
    if snapshots is not None and (found := snapshots.restore()) is not None:
        state, first = found[0]["state"], found[1]["steps"]
    for k in range(first, steps):
        after = step(state, k)
        if snapshots is not None and snapshots.due(seconds):
            after = snapshots.restore(snapshots.save({"state": after}, {"steps": k + 1}))[0]["state"]
        elif (k + 1) % every == 0 or done is not None:
            after = cut(after)
        if done is not None and done(state, after):
            return after
        state = after
    return state


@dataclass
class Stats:
    """Calls and seconds by method name."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    def timed(self, name: str, fn: Callable):
        began = time.time()
        out = fn()
        self.rows.append((name, time.time() - began))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        df = spark.createDataFrame(self.rows, "method string, seconds double")
        return df.groupBy("method").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("total"), F.max("seconds").alias("longest"))


class Snapshots:
    """Epochs of tables and variables below a folder. An epoch counts once its manifest is written, which is last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._last = 0.0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def epochs(self) -> list[int]:
        fs, path = self._path("")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(self._path(f"{n}/manifest")[1]))

    def save(self, tables: dict[str, DataFrame], variables: dict | None = None) -> int:
        epoch = (self.epochs() or [-1])[-1] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch:05d}/table={name}")
        manifest = json.dumps({"tables": sorted(tables), "variables": variables or {}})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/epoch={epoch:05d}/manifest")
        self._last = time.time()
        return epoch

    def due(self, seconds: float) -> bool:
        """Whether the last snapshot is so old, for rolling snapshots by interval."""
        return time.time() - self._last >= seconds

    def restore(self, epoch: int | None = None) -> tuple[dict[str, DataFrame], dict] | None:
        """Tables and variables of the latest finished epoch, or of one; contents replace what there was."""
        known = self.epochs()
        if not known or epoch is not None and epoch not in known:
            return None
        at = f"{self.folder}/epoch={known[-1] if epoch is None else epoch:05d}"
        manifest = json.loads(self.spark.read.text(f"{at}/manifest").first()[0])
        return {t: self.spark.read.parquet(f"{at}/table={t}") for t in manifest["tables"]}, manifest["variables"]


class ShardedState:
    """Versions of a keyed table by shard: a change writes the shards that it touches only.

    The manifest, written last, names each shard's version and the last batch that was merged, so a
    batch that is run again is merged once.
    """

    def __init__(self, spark: SparkSession, folder: str, table: KeyedTable):
        self.spark, self.table, self.snaps = spark, table, Snapshots(spark, f"{folder.rstrip('/')}/manifests")
        self.folder = folder.rstrip("/")
        if not self.snaps.epochs():
            self._write(table.df, {}, -1)

    def _manifest(self) -> dict:
        return self.snaps.restore()[1]

    def _write(self, df: DataFrame, versions: dict[str, str], batch: int) -> None:
        at = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.withColumn("_shard", self.table.spec.shard_column()).repartition("_shard").write.partitionBy("_shard").parquet(at)
        fs, path = self.snaps._path("")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        found = {s.getPath().getName() for s in fs.listStatus(path)}
        new = {n.removeprefix("_shard="): f"{at}/{n}" for n in found if n.startswith("_shard=")}
        self.snaps.save({}, {"versions": versions | new, "batch": batch})

    def read(self, shards: list[str] | None = None) -> DataFrame:
        paths = [p for s, p in sorted(self._manifest()["versions"].items()) if shards is None or s in shards]
        schema = self.table.df.select(*self.table.spec.columns()).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, updates: DataFrame, batch: int) -> None:
        manifest = self._manifest()
        if manifest["batch"] >= batch:
            return
        touched = [str(r[0]) for r in updates.select(self.table.spec.shard_column()).distinct().collect()]  # at most the number of shards
        before = replace(self.table, df=self.read(touched))
        self._write(before.update(updates).df, manifest["versions"], batch)
