"""Keyed tables: a DataFrame with unique keys, a merge rule for each value, and a shard rule."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .accumulators import MERGED_BY, Accumulator
from .sharding import by_hash


@dataclass(frozen=True)
class TableSpec:
    """keys; values with their merge rules; order: the column that ranks writes; shard: expression over the keys."""

    keys: tuple[str, ...]
    values: Mapping[str, Accumulator]
    shards: int = 8
    order: str | None = None
    shard: Callable[[int], Column] | None = None

    def shard_column(self) -> Column:
        return self.shard(self.shards) if self.shard else by_hash(*self.keys, shards=self.shards)

    def columns(self) -> list[str]:
        return [*self.keys, *self.values, *([self.order] if self.order else [])]

    def fold(self) -> list[Column]:
        """Aggregates that merge rows of the table: counts by their sum, sets by union, lists by appending."""
        out = [MERGED_BY.get(acc.name, acc)(v, self.order).alias(v) for v, acc in self.values.items()]
        return out + ([F.max(self.order).alias(self.order)] if self.order else [])


@dataclass(frozen=True)
class KeyedTable:
    """Immutable: every change gives a new table, so a step reads one version and writes the next."""

    spec: TableSpec
    df: DataFrame
    name: str = field(default="table")

    @staticmethod
    def of(spec: TableSpec, updates: DataFrame, name: str = "table") -> KeyedTable:
        """Table of the given updates, merged by key."""
        aggs = [acc(v, spec.order).alias(v) for v, acc in spec.values.items()]
        aggs += [F.max(spec.order).alias(spec.order)] if spec.order else []
        return KeyedTable(spec, updates.groupBy(*spec.keys).agg(*aggs), name)

    def _with(self, df: DataFrame) -> KeyedTable:
        return replace(self, df=df)

    # reads
    def get(self, *key, default: dict | None = None, strict: bool = False) -> dict | None:
        """Values of one key; default, or an error if strict, where it is absent."""
        cond = F.lit(True)
        for k, v in zip(self.spec.keys, key, strict=True):
            cond = cond & (F.col(k) == F.lit(v))
        row = self.df.where(cond).select(*self.spec.values).first()
        if row is None and strict:
            raise KeyError(key)
        return default if row is None else row.asDict()

    def lookup(self, keys: DataFrame, default: dict | None = None) -> DataFrame:
        """Rows of keys with this table's values; absent ones null or by default."""
        out = keys.join(self.df.select(*self.spec.keys, *self.spec.values), list(self.spec.keys), "left")
        return out.fillna(default) if default else out

    def contains(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.df.select(*self.spec.keys), list(self.spec.keys), "left_semi")

    def absent(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.df.select(*self.spec.keys), list(self.spec.keys), "left_anti")

    def scan(self, *shards: int) -> DataFrame:
        """Rows of some shards, or of all."""
        return self.df.where(self.spec.shard_column().isin(list(shards))) if shards else self.df

    def first(self, n: int) -> DataFrame:
        """The n smallest keys of each shard."""
        w = Window.partitionBy("shard").orderBy(*self.spec.keys)
        ranked = self.df.withColumn("shard", self.spec.shard_column()).withColumn("row", F.row_number().over(w))
        return ranked.where(F.col("row") <= n)

    def shard_sizes(self) -> DataFrame:
        return self.df.groupBy(self.spec.shard_column().alias("shard")).agg(F.count(F.lit(1)).alias("entries"))

    def size(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    def rows(self) -> Iterator:
        """All rows on the driver, one partition at a time."""
        return self.df.toLocalIterator()

    # writes
    def update(self, updates: DataFrame) -> KeyedTable:
        """Merge updates by the rules; an absent key takes its first value as it is.

        Updates of counts, sets and lists are single writes and single elements, merged among
        themselves first.
        """
        spec = self.spec
        if any(acc.name in MERGED_BY for acc in spec.values.values()):
            updates = KeyedTable.of(spec, updates).df
        both = self.df.select(*spec.columns()).unionByName(updates.select(*spec.columns()))
        return self._with(both.groupBy(*spec.keys).agg(*spec.fold()))

    def put(self, rows: DataFrame) -> KeyedTable:
        """Store rows (unique keys) in place of what their keys had."""
        rows = rows.select(*self.spec.columns())
        return self._with(self.df.select(*self.spec.columns()).join(rows.select(*self.spec.keys), list(self.spec.keys), "left_anti").unionByName(rows))

    def remove(self, keys: DataFrame) -> KeyedTable:
        return self._with(self.df.join(keys.select(*self.spec.keys), list(self.spec.keys), "left_anti"))

    def clear(self, *shards: int) -> KeyedTable:
        """Without the rows of some shards, or empty."""
        return self._with(self.df.where(~self.spec.shard_column().isin(list(shards))) if shards else self.df.limit(0))

    def resized(self, shards: int) -> KeyedTable:
        """The same rows, dealt to another number of shards."""
        return replace(self, spec=replace(self.spec, shards=shards))

    # maps
    def pmap(self, values: Mapping[str, Column], bind: Mapping[str, KeyedTable] | None = None) -> KeyedTable:
        """New values by expressions; other tables' values of the same key are columns '<name>_<value>', and keys they lack are an error of the caller, so they are left out."""
        df = self.df
        for name, other in (bind or {}).items():
            cols = [F.col(v).alias(f"{name}_{v}") for v in other.spec.values]
            df = df.join(other.df.select(*other.spec.keys, *cols), list(self.spec.keys))
        return self._with(df.withColumns(dict(values)).select(*self.spec.columns()))

    def map_shards(self, fn: Callable[..., pd.DataFrame], schema: str, shards: list[int] | None = None, setup: Callable[[int], object] | None = None) -> DataFrame:
        """Opaque code on whole shards, each of which must fit in a task's memory; prefer pmap.

        setup(shard) makes what the code needs once for each shard in a worker, which keeps it for later
        calls; fn(instance, shard, rows) then gets it first. Without setup it is fn(shard, rows).
        """
        df = self.df.withColumn("_shard", self.spec.shard_column())
        df = df.where(F.col("_shard").isin(shards)) if shards is not None else df
        if setup is None:
            return df.groupBy("_shard").applyInPandas(lambda key, pdf: fn(int(key[0]), pdf.drop(columns="_shard")), schema)
        kernel = f"{self.name}-{uuid.uuid4().hex}"
        return df.groupBy("_shard").applyInPandas(lambda key, pdf: fn(instance(kernel, int(key[0]), setup), int(key[0]), pdf.drop(columns="_shard")), schema)


_instances: dict[tuple[str, int], object] = {}


def instance(kernel: str, shard: int, setup: Callable[[int], object]) -> object:
    """What setup made for a kernel and shard in this worker process."""
    if (kernel, shard) not in _instances:
        _instances[kernel, shard] = setup(shard)
    return _instances[kernel, shard]


class Registry(dict):
    """Tables by name, with views for SQL."""

    def add(self, table: KeyedTable) -> KeyedTable:
        if table.name in self:
            raise ValueError(f"table {table.name} is there already")
        self[table.name] = table
        table.df.createOrReplaceTempView(table.name)
        return table

    def swap(self, a: str, b: str) -> None:
        """Exchange the contents of two tables; readers of a version that they hold are not disturbed."""
        one, other = self[a], self[b]
        self.set(replace(other, name=a))
        self.set(replace(one, name=b))

    def set(self, table: KeyedTable) -> KeyedTable:
        self[table.name] = table
        table.df.createOrReplaceTempView(table.name)
        return table
