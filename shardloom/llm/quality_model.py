"""Quality classifier as a sparse rule ensemble over text statistics.

Shallow trees are grown on a bounded labelled sample; every path of a tree is a rule, a
conjunction of thresholds. A lasso logistic regression gives most rules the weight 0; the
others become one Spark expression over the statistics of a text, so whole tables are
scored in the scan's stage without user functions.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, let
from .quality_rules import MADE_OF, ratios, statistics, words_of

#: At most so many labelled rows are learned from, those with the smallest hash of their id.
SAMPLE_ROWS = 6000
TREES, DEPTH, SEED = 40, 3, 7
PENALTY = 0.002


FEATURES = ("n_words", "mean_word_length", "symbol_ratio", "caps_ratio", "stop_word_ratio", "dup_line_ratio", "mean_line_words", "repeat_ratio", "distinct_ratio", "shout_ratio", "number_ratio", "bar_ratio")
#: Counts beside those of the rules' statistics, per word.
MORE = {"distinct_ratio": "distinct", "shout_ratio": "shouts", "number_ratio": "numbers", "bar_ratio": "bars"}


def features(text: Column, names: Collection[str] = FEATURES) -> Column:
    """Struct of the model's statistics of these names, all finite doubles; nothing else is counted."""
    text = F.coalesce(text, F.lit(""))
    names = [n for n in FEATURES if n in names]
    only = {"n_words", *(c for n in names for c in MADE_OF.get(n, ()))}

    def of(words: Column) -> Column:
        counts = {
            "distinct": lambda: F.size(F.array_distinct(words)),
            "shouts": lambda: F.regexp_count(text, F.lit("[!?]{2,}")),
            "numbers": lambda: F.regexp_count(text, F.lit("[0-9]+")),
            "bars": lambda: F.regexp_count(text, F.lit(r"\|")),
        }
        more = [counts[c]().alias(c) for n, c in MORE.items() if n in names]
        return let(F.struct(statistics(text, only=only, words=words).alias("s"), *more), lambda r: let(F.greatest(r["s"]["n_words"], F.lit(1)).cast("double"), lambda n: named(r, n)))

    def named(r: Column, n: Column) -> Column:
        parts = ratios(r["s"]) | {"n_words": F.log1p(r["s"]["n_words"].cast("double"))} | {k: r[c] / n for k, c in MORE.items() if k in names}
        return F.struct(*[parts[k].cast("double").alias(k) for k in names])

    return let(words_of(text), of)


#: A condition is (feature number, True for <=, threshold); a rule is a tuple of them.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, s: Column) -> Column:
        """The score as an expression over the struct of `features`."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for k, below, at in rule:
                cond = cond & ((s[FEATURES[k]] <= F.lit(at)) if below else (s[FEATURES[k]] > F.lit(at)))
            z = z + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, below, at in rule:
        out &= (x[:, k] <= at) if below else (x[:, k] > at)
    return out


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, feature, threshold) of the split with the greatest drop of squared error."""
    best = (1e-9, -1, 0.0)
    total, n = y.sum(), len(y)
    for k in columns:
        order = np.argsort(x[:, k], kind="stable")
        v, s = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(at + 1 >= least) & (n - at - 1 >= least)]
        if len(at):
            gain = s[at] ** 2 / (at + 1) + (total - s[at]) ** 2 / (n - at - 1) - total**2 / n
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), int(k), float((v[at[i]] + v[at[i] + 1]) / 2))
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng, depth: int, path: Rule, rules: set[Rule]) -> None:
    if path:
        rules.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return
    columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
    _, k, at = _split(x, y, columns, 3)
    if k < 0:
        return
    low = x[:, k] <= at
    _grow(x[low], y[low], rng, depth - 1, (*path, (k, True, at)), rules)
    _grow(x[~low], y[~low], rng, depth - 1, (*path, (k, False, at)), rules)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> RuleModel:
    """Rules from trees on half samples, weighted by lasso logistic regression (accelerated proximal steps)."""
    base = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    bias = float(np.log(base / (1 - base)))
    if not len(y) or y.min() == y.max():
        return RuleModel((), (), bias)
    rng, found = np.random.default_rng(seed), set()
    for _ in range(trees):
        rows = rng.choice(len(y), max(8, len(y) // 2), replace=True)
        _grow(x[rows], y[rows].astype(float), rng, depth, (), found)
    rules = sorted(found)
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    _, first = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows
    rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    # rows on which all rules agree are one row with a weight
    full, where = np.unique(np.column_stack([np.ones(len(y)), a]), axis=0, return_inverse=True)
    n, ones = np.bincount(where.ravel()) / len(y), np.bincount(where.ravel(), y) / len(y)
    step = 4 / (np.linalg.norm(full * np.sqrt(n)[:, None], 2) ** 2)
    w = v = np.zeros(full.shape[1])
    w[0] = v[0] = bias
    t = 1.0
    for _ in range(3000):
        grad = full.T @ (n / (1 + np.exp(-(full @ v))) - ones)
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, moved = new + (t - 1) / t2 * (new - w), np.abs(new - w).max()
        w, t = new, t2
        if moved < 1e-6:
            break
    kept = np.flatnonzero(np.abs(w[1:]) > 1e-6)
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(w[1 + i]) for i in kept), float(w[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most rows labelled documents (0 and 1) that are not held out.

    Only the sample's statistics reach the driver. The sample's ids are broadcast, as their
    number is bounded.
    """
    picked = labels.where(F.col(label_col).isin(0, 1) & (crc_mod(id_col, 5) != 0) & F.col(id_col).isNotNull())
    picked = picked.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i", "y").limit(rows)
    sample = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(F.broadcast(picked), F.col("d") == F.col("i"))
    table = sample.select("d", features(F.col("t")).alias("f"), "y").select("d", "f.*", "y")
    # ids that documents repeat give more rows than labels: of these too, the smallest hashes
    table = table.orderBy(F.xxhash64("d"), "d", "y", *FEATURES).limit(rows).toPandas()
    table = table.sort_values(["d", "y", *FEATURES])
    return fit(table[list(FEATURES)].to_numpy(float), table["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """id_col, held_out, score, predicted for every row.

    Defined cases: null and empty texts are scored by their statistics, all 0; a text of any length is
    read whole; a value at a threshold is below it; null ids are passed on; repeated rows, and ids
    that labels or documents repeat, are rows of their own; without labels, or with one class of
    them, the score is the same for all; other columns are ignored.
    """
    scored = docs.select(F.col(id_col), (crc_mod(id_col, 5) == 0).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return scored.select(id_col, "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))


def score_column(text: Column, model: RuleModel) -> Column:
    """The score of a text; statistics that no rule of the model asks for are not computed."""
    used = {FEATURES[k] for rule in model.rules for k, _, _ in rule}
    return let(features(text, used or {"n_words"}), model.column)


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
