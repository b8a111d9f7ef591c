"""Merge rules of keyed tables. Each is a Spark aggregate, so updates are combined before they are shuffled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accumulator:
    """fold: aggregate of a value column. order: the column that ranks writes, where their order matters."""

    name: str
    fold: Callable[[Column, Column | None], Column]
    ordered: bool = False

    def __call__(self, value: str, order: str | None = None) -> Column:
        if self.ordered and order is None:
            raise ValueError(f"{self.name} needs an order column")
        return self.fold(F.col(value), F.col(order) if order else None)


MIN = Accumulator("min", lambda v, _: F.min(v))
MAX = Accumulator("max", lambda v, _: F.max(v))
SUM = Accumulator("sum", lambda v, _: F.sum(v))
COUNT = Accumulator("count", lambda v, _: F.count(v))
#: The write with the greatest order wins.
REPLACE = Accumulator("replace", lambda v, o: F.max_by(v, o), ordered=True)
#: Texts in their order, one after the other.
CONCAT = Accumulator("concat", lambda v, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v")))), lambda x: x["v"]), ""), ordered=True)
#: Distinct values, sorted; of array values, their union.
SET_UNION = Accumulator("set_union", lambda v, _: F.array_sort(F.collect_set(v)))
ARRAY_UNION = Accumulator("array_union", lambda v, _: F.array_sort(F.array_distinct(F.flatten(F.collect_list(v)))))
#: All values, sorted, so that the result does not depend on arrival.
LIST_APPEND = Accumulator("list_append", lambda v, _: F.array_sort(F.collect_list(v)))
ARRAY_APPEND = Accumulator("array_append", lambda v, _: F.array_sort(F.flatten(F.collect_list(v))))
#: Rules whose result has another form than the values they take, with the rule that merges results.
MERGED_BY = {COUNT.name: SUM, SET_UNION.name: ARRAY_UNION, LIST_APPEND.name: ARRAY_APPEND}


def vector_sum(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pos, total): element-wise sums of array values; an element is a row, so no array is held whole."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return parts.groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("total"))


def vectors(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Array form of vector_sum's result."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "total")))
    return sums.groupBy(*keys).agg(F.transform(rows, lambda x: x["total"]).alias("total"))


def _ufunc(fold: Callable[[float, float], float] | np.ufunc) -> np.ufunc:
    return fold if isinstance(fold, np.ufunc) else np.frompyfunc(fold, 2, 1)


def user_fold(fold: Callable[[float, float], float]) -> Callable[[Column], Column]:
    """An aggregate from a commutative and associative Python function of two numbers. All values of a key
    meet in one task: for many of them use fold_by_key, which folds before it shuffles."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> float:
        return float(_ufunc(fold).reduce(values.to_numpy())) if len(values) else None

    return run


def fold_by_key(df: DataFrame, keys: list[str], value: str, fold: Callable[[float, float], float] | np.ufunc) -> DataFrame:
    """(keys, value): a commutative and associative function of two numbers over each key's values.

    Tasks fold every batch by key first, so what is shuffled, and what meets in one task, is a key's
    partial results. Null values are left out.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())

    def partial(parts):
        many = _ufunc(fold)
        for part in parts:
            if len(part):
                group = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.diff(group[order], prepend=-1))
                out = part.iloc[order[first]].copy()
                out[value] = many.reduceat(part[value].to_numpy()[order], first).astype(float)
                yield out

    return rows.mapInPandas(partial, rows.schema).groupBy(*keys).agg(user_fold(fold)(F.col(value)).alias(value))


#: Calls, total and longest of a method, as a keyed table's values.
STATS = {"calls": SUM, "total": SUM, "longest": MAX}


def stats_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One map of statistics: calls, total and longest value by key."""
    return df.groupBy(*keys).agg(F.count(value).alias("calls"), F.sum(value).alias("total"), F.max(value).alias("longest"))


def merge_stats(first: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics of several maps (stats_of), merged by key, and their mean."""
    for other in others:
        first = first.unionByName(other)
    merged = first.groupBy(*keys).agg(*[rule(name).alias(name) for name, rule in STATS.items()])
    return merged.withColumn("mean", F.col("total") / F.col("calls"))
