"""Clustering, a small neural classifier, and particle steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..operators.joins import nearest, neighbours
from ..sources.files import scramble

#: Squared distance at which a point stays unassigned; time step and cube of particles; targets of the classifier.
WITHIN, STEP, CUBE, HIGH, LOW = 2.0, 1e-6, 20.0, 0.9, 0.1


def kmeans_assign(points: DataFrame, centres: DataFrame, axes: list[str], key: str, centre_id: str = "centre") -> DataFrame:
    return nearest(points, centres, axes, axes, key, centre_id, WITHIN)


def kmeans_update(assigned: DataFrame, axes: list[str], centres: int, points: int, mode: str = "expected") -> DataFrame:
    """New centres: sums times centres / points, which is the mean for clusters of equal size, or mode 'mean'. Unassigned points count for none."""
    assigned = assigned.where("nearest IS NOT NULL")
    if mode == "mean":
        return assigned.groupBy(F.col("nearest").alias("centre")).agg(*[F.avg(a).alias(a) for a in axes])
    share = centres / points
    return assigned.groupBy(F.col("nearest").alias("centre")).agg(*[(F.sum(a) * share).alias(a) for a in axes])


def kmeans_reseed(centres: DataFrame, points: DataFrame, axes: list[str], key: str, seed: int = 1) -> DataFrame:
    """Centres that lie exactly at the origin take the place of a point, chosen by its scrambled key; the others stay."""
    empty = F.lit(True)
    for a in axes:
        empty = empty & (F.col(a) == 0)
    lost = centres.where(empty).select("centre")
    n = lost.count()
    if not n:
        return centres
    picked = points.orderBy(scramble(F.col(key), seed), key).limit(n).select(*axes).collect()
    ids = [r["centre"] for r in lost.orderBy("centre").collect()]
    new = centres.sparkSession.createDataFrame([(i, *[float(p[a]) for a in axes]) for i, p in zip(ids, picked, strict=False)], "centre long, " + ", ".join(f"{a} double" for a in axes))
    return centres.join(new.select("centre"), "centre", "left_anti").select("centre", *axes).unionByName(new)


def forward(inputs: Column, weights: list[list[float]]) -> Column:
    """Outputs of one fully connected sigmoid layer; weights of a unit: its bias, then one for each input."""
    units = []
    for w in weights:
        ws = F.array(*[F.lit(float(x)) for x in w[1:]])
        total = F.aggregate(F.zip_with(inputs, ws, lambda x, y: x.cast("double") * y), F.lit(float(w[0])), lambda a, b: a + b)
        units.append(sigmoid(total))
    return F.array(*units)


def target_of(name: Column) -> Column:
    """Target by the sixth character of an image's name."""
    return F.when(F.substring(name, 6, 1) == "p", F.lit(HIGH)).otherwise(F.lit(LOW))


def unit_inputs(pixels: Column) -> Column:
    return F.transform(pixels, lambda x: x / F.lit(255.0))


def evaluate(df: DataFrame, output: Column, target: Column) -> DataFrame:
    """Rows, rows on the right side of one half, mean of half the squared error."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((output > 0.5) == (target > 0.5)).alias("correct"),
        F.avg(0.5 * (target - output) * (target - output)).alias("error"),
    )


def train_epoch(df: DataFrame, inputs: str, target: str, layers: list[np.ndarray], momentum: list[np.ndarray], eta: float = 0.3, alpha: float = 0.3) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """One synchronous epoch: tasks sum gradients over their rows, the sums change the weights once.

    layers: two matrices (inputs + 1, hidden) and (hidden + 1, 1), first row the bias. Returns the
    new layers, their last changes, and the mean error before the epoch.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w1, w2 = layers
        g1, g2, error, n = np.zeros_like(w1), np.zeros_like(w2), 0.0, 0
        for part in parts:
            x = np.column_stack([np.ones(len(part)), np.stack(part[inputs].to_numpy()).astype(float)])
            h = 1 / (1 + np.exp(-(x @ w1)))
            hb = np.column_stack([np.ones(len(part)), h])
            o = 1 / (1 + np.exp(-(hb @ w2)))[:, 0]
            t = part[target].to_numpy(float)
            d = o * (1 - o) * (t - o)
            g2 += hb.T @ d[:, None]
            g1 += x.T @ (h * (1 - h) * (d[:, None] * w2[1:, 0]))
            error, n = error + float((0.5 * (t - o) ** 2).sum()), n + len(part)
        yield pd.DataFrame({"pos": np.arange(g1.size + g2.size + 2), "v": np.concatenate([g1.ravel(), g2.ravel(), [error, n]])})

    sums = df.select(inputs, target).mapInPandas(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").toPandas()["v"].to_numpy()
    sizes = [w.size for w in layers]
    grads = [sums[: sizes[0]].reshape(layers[0].shape), sums[sizes[0] : sum(sizes)].reshape(layers[1].shape)]
    n = max(1.0, sums[-1])
    change = [eta * g / n + alpha * m for g, m in zip(grads, momentum, strict=True)]
    return [w + c for w, c in zip(layers, change, strict=True)], change, float(sums[-2] / n)


def forces(points: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(key, f_<axis>): sums over near points of the difference by the squared distance; 0 without near points."""
    pairs = neighbours(points, key, axes)
    sums = pairs.groupBy(key).agg(*[F.sum((F.col(a) - F.col(f"other_{a}")) / F.col("d2")).alias(f"f_{a}") for a in axes])
    return points.select(key, *axes).join(sums, key, "left").fillna(0.0, [f"f_{a}" for a in axes])


def particle_step(points: DataFrame, key: str, axes: list[str], cube: float = CUBE) -> DataFrame:
    """Points after one step; points outside the cube go, and points at one place are one."""
    moved = forces(points, key, axes).select(key, *[(F.col(a) + F.col(f"f_{a}") * STEP).alias(a) for a in axes])
    inside = F.lit(True)
    for a in axes:
        inside = inside & F.col(a).between(0.0, cube)
    return moved.where(inside).groupBy(*axes).agg(F.min(key).alias(key)).select(key, *axes)


def layer_rows(spark, layers: list[np.ndarray]) -> DataFrame:
    """(layer, i, j, w): weights as a table, to be saved with snapshots."""
    rows = [(n, i, j, float(w)) for n, m in enumerate(layers) for (i, j), w in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "layer int, i int, j int, w double")


def layers_of(rows: DataFrame) -> list[np.ndarray]:
    """Weights from their table; the model is small and wanted by every task."""
    table = rows.orderBy("layer", "i", "j").toPandas()
    out = []
    for _, part in table.groupby("layer", sort=True):
        out.append(part["w"].to_numpy().reshape(part["i"].max() + 1, part["j"].max() + 1))
    return out
