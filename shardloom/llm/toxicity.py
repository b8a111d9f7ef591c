"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding maps look-alike letters and digits used as letters to plain ones, and everything
between words to one space. Lexicon entries are whole words or beginnings of words; their
weights are log odds learned from labelled documents. Exception phrases, seen in clean
documents only, cancel the matches inside them. The weight found is normalised by length.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, crc_mod, documents, materialise

#: At most so many labelled rows are learned from, those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
#: Lengths of word beginnings, least log odds of an entry.
PREFIXES, LEAST = range(4, 9), 1.5

#: What a document counts after each entry found in it; documents, so counted, that an entry needs.
SHARE, ENOUGH = 0.6, 1.5

#: Look-alikes of Latin letters, and digits and signs used for letters inside words.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁɡοαειυνκρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅ", "abekmhopctyxijsdgoaeiuvkptabezhikmnoptyxabekmhopctyxijs", strict=True))
LEET = dict(zip("01345789@$!", "oieastbgasi", strict=True))
_MAP = str.maketrans(HOMOGLYPHS | {"​": "", "‌": "", "‍": "", "­": ""} | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)})
_LEET = re.compile(r"(?:(?<=[^\W\d_])|(?<=[^\W\d_][0-9@$!]))[01345789@$!](?=[01345789@$!]?[^\W\d_])|\b[013457@$](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower-case words of a text between single spaces, look-alikes replaced; begins and ends with a space."""
    text = text.translate(_MAP).lower()
    text = _LEET.sub(lambda m: LEET[m[0]], text)
    return " " + _GAP.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """entries: pattern -> weight, a pattern is ' word ' or ' beginning'; bias, slopes: of the two length-normalised features."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    bias: float
    slopes: tuple[float, float]


@functools.lru_cache(maxsize=4)
def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (p, w) in enumerate(entries):
        a.add_word(p, (p, k, w))
    for p in exceptions:
        if p not in a:
            a.add_word(p, (p, -1, 0.0))
    a.make_automaton()
    return a


def matches(folded: str, entries, exceptions=()) -> list[tuple[int, int]]:
    """(place, entry) of all entries found outside exception phrases."""
    if not entries:
        return []
    found, spans = [], []
    for end, (p, k, _) in _automaton(tuple(entries), tuple(exceptions)).iter(folded):
        (spans if k < 0 else found).append((end - len(p) + 1, k, end))
    if spans:
        # the furthest end of the phrases that begin at or before a match tells whether one holds it
        spans.sort()
        begins, ends = [a for a, _, _ in spans], list(itertools.accumulate((b for _, _, b in spans), max))
        held = lambda m: (n := bisect.bisect_right(begins, m[0])) and m[2] <= ends[n - 1]
        found = [m for m in found if not held(m)]
    return [(a, k) for a, k, _ in found]


def measures(weight: float, words: int) -> tuple[float, float]:
    """Normalised by length: the weight per word, and the weight against the root of the words."""
    n = max(1, words)
    return math.log1p(100 * weight / n), math.log1p(weight) / (1 + 0.1 * math.log1p(n))


def text_score(text: str | None, lexicon: Lexicon) -> float:
    folded = fold(text or "")
    weight = sum(lexicon.entries[k][1] for _, k in matches(folded, lexicon.entries, lexicon.exceptions))
    a, b = measures(weight, folded.count(" ") - 1)
    return 1 / (1 + math.exp(-(lexicon.bias + lexicon.slopes[0] * a + lexicon.slopes[1] * b)))


def _candidates(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return out


def _select(held: list[np.ndarray], names: list[str], clean: np.ndarray, n0: int) -> list[tuple[str, float]]:
    """Entries by greedy gain: log odds times the toxic texts that hold the candidate.

    held: candidates of each toxic text; clean: how many of the n0 clean texts hold each candidate.
    A text counts less by SHARE for each entry already found in it, so that several words
    of one text enter, but not all words of a group of near copies. Of equal gains, whole
    words and then the longest beginning win.
    """
    rows, flat = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
    odds = np.log((np.bincount(flat, minlength=len(names)) + 0.5) / (len(held) + 1)) - np.log((clean + 0.5) / (n0 + 1))
    left, share, out = np.ones(len(names), bool), np.ones(len(held)), []
    while True:
        mass = np.bincount(flat, share[rows], len(names))
        left &= mass >= ENOUGH
        if not left.any():
            return out
        gain = np.where(left, np.round(mass * odds, 6), -1.0)
        best = int(max(np.flatnonzero(gain == gain.max()), key=lambda k: _rank(names[k])))
        out.append((names[best], round(float(odds[best]), 4)))
        share[rows[flat == best]] *= SHARE
        left[best] = False
        rows, flat = rows[left[flat]], flat[left[flat]]


def _rank(name: str) -> tuple[bool, int, str]:
    return name.endswith(" "), len(name), name


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps, slopes kept at least 0."""
    a, w = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-4] + [0.02] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        grad = a.T @ (p - y) / len(y) + ridge @ w * 0.1
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * 0.1 + 1e-9 * np.eye(len(w))
        new = w - np.linalg.solve(hess, grad)
        new[1:] = np.maximum(new[1:], 0)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return float(w[0]), w[1:]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn entries, weights, exceptions and slopes from at most rows documents that are not held out.

    Spark counts the candidates by the sample's distinct texts and merges those that lie in the same
    ones; all that are left, and which of them the toxic texts hold, reach the driver.
    """
    picked = labels.where(F.col(label_col).isin(0, 1) & (crc_mod(id_col, 3) != 1) & F.col(id_col).isNotNull())
    picked = picked.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i", "y").limit(rows)
    sample = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), F.col("d") == F.col("i")).select("y", "t")
    sample = bounded(materialise(folded(sample), "toxic-sample"), rows, "toxic-sample")

    sizes = {int(r["y"]): int(r["n"]) for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    base = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -2.0
    if not n1 or not n0:
        return Lexicon((), (), base, (0.0, 0.0))
    texts = materialise(sample.dropDuplicates(["y", "t"]), "toxic-texts")
    names, clean, n0 = _merged(texts)
    entries = _select(_held(texts, names), names, clean, n0)
    exceptions = _exceptions(sample, entries)
    x, y = [], []
    for label, words, ks in _incidence(sample, entries, exceptions):
        x.append(measures(sum(entries[k][1] * n for k, n in ks), words))
        y.append(label)
    bias, slopes = _logistic(np.array(x), np.array(y, float))
    return Lexicon(tuple(entries), exceptions, bias, (float(slopes[0]), float(slopes[1])))


def folded(sample: DataFrame) -> DataFrame:
    """(y, t) with t folded, once for all passes over the sample."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(t.as_py() or "") for t in batch.column(1)], pa.string())], names=["y", "t"])

    return sample.select("y", "t").mapInArrow(run, "y int, t string")


def _merged(texts: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """(candidates that two toxic texts hold with LEAST odds, clean texts that hold each, clean texts).

    Of candidates in the same toxic texts and as many clean ones, whole words and then the longest
    beginning stay. The toxic texts of a candidate are compared by their number and two sums of
    40-bit hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]):
        toxic, clean = {}, Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                if not y:
                    clean.update(_candidates(text))
                    continue
                h = hashlib.blake2b(text.encode(), digest_size=10).digest()
                a, b = int.from_bytes(h[:5]), int.from_bytes(h[5:])
                for c in _candidates(text):
                    p, u, v = toxic.get(c, (0, 0, 0))
                    toxic[c] = (p + 1, u + a, v + b)
        # a candidate is judged where toxic texts have it
        for own, columns in ((toxic, lambda k: (*toxic[k], 0)), (clean, lambda k: (0, 0, 0, clean[k]))):
            keys = list(own)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                numbers = zip(*map(columns, part), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=["c", "p", "a", "b", "n"])

    sizes = {int(r["y"]): int(r["n"]) for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("p") + 0.5) / (sizes[1] + 1)) - F.log((F.col("n") + 0.5) / (sizes[0] + 1))
    summed = texts.mapInArrow(count, "c string, p long, a long, b long, n long").groupBy("c").agg(*[F.sum(x).alias(x) for x in "pabn"])
    same = summed.where((F.col("p") >= 2) & (odds >= LEAST)).groupBy("p", "a", "b", "n").agg(F.max(F.struct(F.col("c").endswith(" "), F.length("c"), "c")).getField("c").alias("c"))
    got = sorted((r["c"], int(r["n"])) for r in same.select("c", "n").collect())
    return [c for c, _ in got], np.array([n for _, n in got], np.int64), sizes[0]


def _held(texts: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Candidates that each toxic text holds, as places in names, in a fixed order of texts."""
    names = tuple(names)

    def run(batches):
        place = {c: k for k, c in enumerate(names)}
        for batch in batches:
            held = [np.array(sorted(place[c] for c in _candidates(t.as_py()) if c in place), np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["held"])

    got = texts.where("y = 1").select("t").mapInArrow(run, "held binary").collect()
    return [np.frombuffer(h, np.int32) for h in sorted(bytes(r["held"]) for r in got)]


def _exceptions(sample: DataFrame, entries: list[tuple[str, float]]) -> tuple[str, ...]:
    """Phrases around matches that at least three clean documents of the sample hold, and no toxic one."""
    entries = tuple(entries)

    def run(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                around = set()
                for a, _ in matches(text, entries):
                    end = text.index(" ", a + 1)
                    after, before = text.find(" ", end + 1), text.rfind(" ", 0, a)
                    around |= {text[a : end + 1]} | ({text[a : after + 1]} if after > 0 else set()) | ({text[before : end + 1]} if before >= 0 else set())
                counts[y].update(around)
        for y, own in enumerate(counts):
            keys = list(own)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([y] * len(part), pa.int64()), pa.array([own[k] for k in part], pa.int64())], names=["phrase", "y", "n"])

    summed = sample.mapInArrow(run, "phrase string, y long, n long").groupBy("phrase").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    return tuple(sorted(r["phrase"] for r in summed.where("n0 >= 3 AND n1 = 0").select("phrase").collect()))


def _incidence(sample: DataFrame, entries: list[tuple[str, float]], exceptions: tuple[str, ...] = ()) -> list[tuple]:
    """(label, words, [(entry, count)]) of each sampled document, in a fixed order."""
    entries = tuple(entries)

    def run(batches):
        for batch in batches:
            rows = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                ks = Counter(k for _, k in matches(text, entries, exceptions))
                rows.append((y, text.count(" ") - 1, list(ks), list(ks.values())))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, types, strict=True)], names=["y", "words", "k", "n"])

    got = sample.mapInArrow(run, "y long, words long, k array<long>, n array<long>").collect()
    return sorted((int(r["y"]), int(r["words"]), list(zip(r["k"], r["n"], strict=True))) for r in got)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """id_col, held_out, score, predicted for every row, over whole texts.

    Defined cases: null and empty texts have no matches and the least score; a text of any length is
    read whole, in time in proportion to it; matches that overlap all count, and of candidates of
    equal gain whole words and then longer beginnings win; null ids are passed on; repeated rows, and
    ids that labels or documents repeat, are rows of their own; without labels, or with one class,
    the lexicon is empty and all scores are equal; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = pa.array([text_score(t.as_py(), lexicon) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, pa.array(np.asarray(scores) >= least).cast(pa.int32())], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
