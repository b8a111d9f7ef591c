"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and gives every position a
distribution over the languages; a text's distribution is the normalised geometric mean of
those of all its positions. It is trained in numpy by backpropagation through time. Texts
of any length are read in windows: each labels its own bytes, after the states have run
through some bytes of its neighbours on both sides, so nothing begins anew at blanks or
inside words, and memory is bounded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, documents
from .words import columns_bytes

#: At most so many labelled rows are learned from (one of each language, if there are more languages), by stretches drawn from all of a row's text.
SAMPLE_ROWS, DRAWS, STRETCH = 4000, 24, 40
#: Bytes that a window labels, and bytes read before and after them.
WINDOW, AROUND = 192, 24
#: Sizes of the network, training steps, stretches in a step, windows computed together.
EMBED, HIDDEN, STEPS, BATCH, TOGETHER = 12, 16, 400, 96, 2048
#: Signs and factors of the update gate, the reset gate and the candidate in an exponent.
SCALES = np.array([-1, -1, 2], np.float32)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Network:
    langs: tuple[str, ...]
    w: dict[str, np.ndarray]

    @np.errstate(over="ignore")  # in the exponents of gates
    def label(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums (windows, languages) of the log probabilities of positions first to last (exclusive) of windows begin to end.

        Windows stand in rows, the widest first, and those that have a position are the first of
        them. Each direction reads the bytes before its first labelled position, then the labelled
        ones, and stops there. The backward states begin at the last position and take windows in as
        it reaches their ends, so both directions meet at a position, where its labels are summed at once.
        """
        order = np.argsort(first - last, kind="stable")
        first, last = first[order], last[order]
        width = last - first
        steps, n = int(width[0]), len(first)
        running = np.searchsorted(-width, -np.arange(steps), "left")  # windows wider than k
        forward = np.empty((steps, len(self.langs), n), np.float32)
        sums = np.zeros((len(self.langs), n))
        room = _rows(5, n)
        state = room[0]
        for d in "fb":
            gates, u = (self.w["E"] @ self.w["X" + d] + self.w["B" + d]), self.w["H" + d]
            tables, us = _rows(3, 256), _rows(3, HIDDEN)
            for k, scale in enumerate(SCALES):
                part = slice(k * HIDDEN, (k + 1) * HIDDEN)
                tables[k], us[k] = gates[:, part] * scale, u[:, part] * scale
            half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            read = np.ascontiguousarray(self.w["O"][half].T)
            _warm(tables, us, data, room, *((first, first - begin[order], -1) if d == "f" else (last - 1, end[order] - last, 1)))
            for k in range(steps) if d == "f" else reversed(range(steps)):
                m = int(running[k])
                own = state[:m]
                _row_step(tables, us, data[first[:m] + k].astype(np.intp), own, room[1:, :m])
                both = forward[k, :, :m]
                if d == "f":
                    np.matmul(read, own.T, out=both)
                    continue
                both += read @ own.T
                both += self.w["C"][:, None]
                both -= both.max(axis=0)
                both -= np.log(np.exp(both).sum(axis=0))
                sums[:, :m] += both
        out = np.empty((n, len(self.langs)))
        out[order] = sums.T
        return out


def _rows(count: int, n: int) -> np.ndarray:
    """Arrays (n, HIDDEN) whose rows begin with lines of the cache, where numpy's loops are faster, and not all at one place of a page."""
    rows = n + 9
    space = np.empty(count * rows * HIDDEN + 16, np.float32)
    return space[-space.ctypes.data % 64 // 4 :][: count * rows * HIDDEN].reshape(count, rows, HIDDEN)[:, :n]


def _warm(tables: np.ndarray, us: np.ndarray, data: np.ndarray, room: np.ndarray, edge: np.ndarray, count: np.ndarray, way: int) -> None:
    """Sets room[0] to the states after count bytes beyond edge, read towards it; way: on which side of it they lie."""
    order = np.argsort(-count, kind="stable")
    edge, count, state = edge[order], count[order], room[0]
    state[:] = 0
    for k in range(int(count[0]), 0, -1):
        m = int(np.searchsorted(-count, -k, "right"))  # windows with k bytes or more there
        _row_step(tables, us, data[edge[:m] + way * k].astype(np.intp), state[:m], room[1:, :m])
    state[order] = state.copy()


def _row_step(tables: np.ndarray, us: np.ndarray, byte: np.ndarray, state: np.ndarray, room: np.ndarray) -> None:
    """_step without what training keeps, by weights times SCALES; changes state. room: four arrays like state.

    A gate is 1 / (1 + exp(-x)), so what it multiplies is divided by 1 + exp(-x), and tanh(x) is
    1 - 2 / (1 + exp(2 x)): numpy's exp is fast on all processors, its tanh only on some. Where
    exp is infinite both have their limits.
    """
    gates, rest = room[:2], room[2:]
    np.take(tables[0], byte, axis=0, out=gates[0], mode="clip")
    np.take(tables[1], byte, axis=0, out=gates[1], mode="clip")
    gates += np.matmul(state, us[:2], out=rest)
    np.exp(gates, out=gates)
    gates += 1
    (z, r), c = gates, rest[0]
    np.matmul(state, us[2], out=c)
    c /= r
    c += np.take(tables[2], byte, axis=0, out=r, mode="clip")
    np.exp(c, out=c)
    c += 1
    np.divide(-2, c, out=c)
    c += 1
    state -= c
    state /= z
    state += c


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _step(gates: np.ndarray, state: np.ndarray, u: np.ndarray):
    """One gated step: (new state, update gate, reset gate, candidate, recurrent part of the candidate)."""
    s = state @ u
    zr = _sigmoid(gates[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
    z, r, c = zr[:, :HIDDEN], zr[:, HIDDEN:], s[:, 2 * HIDDEN :]
    n = np.tanh(gates[:, 2 * HIDDEN :] + r * c)
    return n + z * (state - n), z, r, n, c


def _start(langs: tuple[str, ...], rng) -> Network:
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"E": init(256, EMBED) * 4, "O": init(2 * HIDDEN, len(langs)), "C": np.zeros(len(langs), np.float32)}
    for d in "fb":
        w |= {"X" + d: init(EMBED, 3 * HIDDEN), "H" + d: init(HIDDEN, 3 * HIDDEN), "B" + d: np.zeros(3 * HIDDEN, np.float32)}
    return Network(langs, w)


def _gradients(net: Network, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean cross entropy of all positions, by backpropagation through time. x is padded at its end."""
    w, (n, t) = net.w, x.shape
    place = np.arange(t)
    mask = (place[None] < lengths[:, None]).astype(np.float32)
    back = np.where(mask > 0, lengths[:, None] - 1 - place[None], place[None])
    kept, hs = {}, {}
    for d in "fb":
        xs = x if d == "f" else np.take_along_axis(x, back, axis=1)
        gates = w["E"][xs] @ w["X" + d] + w["B" + d]
        state, steps, out = np.zeros((n, HIDDEN), np.float32), [], np.empty((n, t, HIDDEN), np.float32)
        for k in range(t):
            new, z, r, c, s = _step(gates[:, k], state, w["H" + d])
            steps.append((state, z, r, c, s))
            state = np.where(mask[:, k : k + 1] > 0, new, state)
            out[:, k] = state
        kept[d] = (xs, steps)
        hs[d] = out if d == "f" else np.take_along_axis(out, back[:, :, None], axis=1)
    both = np.concatenate([hs["f"], hs["b"]], axis=2)
    z = both @ w["O"] + w["C"]
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=2, keepdims=True)
    total = mask.sum()
    loss = -float((np.log(p[np.arange(n), :, y] + 1e-9) * mask).sum() / total)
    dz = p.copy()
    dz[np.arange(n), :, y] -= 1
    dz *= mask[:, :, None] / total
    g = {"O": np.einsum("nth,ntl->hl", both, dz, optimize=True), "C": dz.sum(axis=(0, 1)), "E": np.zeros_like(w["E"])}
    dboth = dz @ w["O"].T
    for d in "fb":
        dh = dboth[:, :, :HIDDEN] if d == "f" else np.take_along_axis(dboth[:, :, HIDDEN:], back[:, :, None], axis=1)
        xs, steps = kept[d]
        u, carry = w["H" + d], np.zeros((n, HIDDEN), np.float32)
        du, dgates = np.zeros_like(u), np.zeros((n, t, 3 * HIDDEN), np.float32)
        for k in reversed(range(t)):
            state, zg, r, c, s = steps[k]
            m = mask[:, k : k + 1]
            dnew = carry + dh[:, k]
            here = dnew * m
            dc = here * (1 - zg) * (1 - c * c)
            dzr = np.concatenate([here * (state - c) * zg * (1 - zg), dc * s * r * (1 - r)], axis=1)
            dgates[:, k] = np.concatenate([dzr, dc], axis=1)
            ds = np.concatenate([dzr, dc * r], axis=1)
            du += state.T @ ds
            carry = ds @ u.T + here * zg + dnew * (1 - m)
        g["H" + d], g["B" + d] = du, dgates.sum(axis=(0, 1))
        g["X" + d] = np.einsum("nte,ntg->eg", w["E"][xs], dgates, optimize=True)
        np.add.at(g["E"], xs, dgates @ w["X" + d].T)
    return g, loss


def pad(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in stretches])
    out = np.zeros((len(stretches), lengths.max()), np.uint8)
    for k, x in enumerate(stretches):
        out[k, : len(x)] = np.frombuffer(x, np.uint8)
    return out, lengths


def fit(samples: dict[str, list[bytes]], steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> Network:
    """Train with Adam on stretches of text; every language has the same part of each step."""
    langs = tuple(sorted(k for k, v in samples.items() if v))
    rng = np.random.default_rng(seed)
    net = _start(langs, rng)
    if len(langs) < 2:
        return net
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    each = max(1, batch // len(langs))
    for k in range(1, steps + 1):
        chosen, y = [], []
        for i, lang in enumerate(langs):
            own = samples[lang]
            chosen += [own[j] for j in rng.integers(0, len(own), each)]
            y += [i] * each
        x, lengths = pad(chosen)
        g, _ = _gradients(net, x, lengths, np.array(y))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.01 * (0.1 ** (k / steps))
        for name, a in g.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * a
            v[name] = 0.99 * v[name] + 0.01 * a * a
            net.w[name] = (net.w[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network:
    """Learn from at most rows documents that are not held out and have a language, the same number of each language.

    Only DRAWS short stretches of each, from places drawn out of the whole text, reach the driver.
    """
    picked = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 3) != 1))
    # rows that repeat id and text are alike
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(lang_col), F.col(text_col)), F.lit(1 << 40))
    picked = picked.select(F.col(lang_col).alias("y"), key.alias("h"))
    # rows of each language alike, so that rare ones are learned too: by their counts, about twice
    # the wanted rows pass a bound on the hash, and the smallest hashes of those are taken
    counts = picked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return Network((), {})
    each = max(1, rows // len(counts))
    bounds = docs.sparkSession.createDataFrame([(r["y"], int((1 << 40) * min(1.0, (2 * each + 50) / r["n"]))) for r in counts], "y string, bound long")
    near = picked.join(F.broadcast(bounds), "y").where("h <= bound").select("y", "h").distinct()
    keys = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("r") <= each).select("y", "h")
    sample = docs.where(crc_mod(id_col, 3) != 1).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("l"), key.alias("k"))
    sample = sample.join(F.broadcast(keys), (F.col("k") == F.col("h")) & (F.col("l") == F.col("y"))).dropDuplicates(["l", "k"])

    def cut(batches):
        for batch in batches:
            langs, out = [], []
            data, at = columns_bytes(batch.column(1))
            for lang, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                rng = np.random.default_rng(zlib.crc32(data[a:b]))
                places = a + rng.integers(0, max(1, b - a - STRETCH + 1), DRAWS if b > a else 0)
                langs += [lang] * len(places)
                out += [_LOWER[data[p : min(b, p + STRETCH)]].tobytes() for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "stretch"])

    got = sample.select("l", "t").mapInArrow(cut, "lang string, stretch binary").toArrow()
    samples: dict[str, list[bytes]] = {}
    for lang, stretch in sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)):
        samples.setdefault(lang, []).append(stretch)
    return fit(samples)


def label_texts(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean log probabilities (texts, languages) over all positions of the texts data[at[k] : at[k + 1]]; 0 for empty ones."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    first = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    last = np.minimum(first + WINDOW, at[text + 1])
    begin, end = np.maximum(first - AROUND, at[text]), np.minimum(last + AROUND, at[text + 1])
    order = np.argsort(begin - end, kind="stable")  # windows of about one length are computed together
    sums = np.zeros((len(size), len(net.langs)))
    for lo in range(0, len(order), TOGETHER):
        part = order[lo : lo + TOGETHER]
        low, high = int(begin[part].min()), int(end[part].max())
        near = high - low <= 4 * len(part) * WINDOW  # else bytes are copied window by window below
        own = _LOWER[data[low:high]] if near else None
        if own is None:
            widths = end[part] - begin[part]
            starts = np.cumsum(widths) - widths
            own = _LOWER[data[np.repeat(begin[part] - starts, widths) + np.arange(int(widths.sum()))]]
            moved = starts - begin[part]
        else:
            moved = np.full(len(part), -low)
        np.add.at(sums, text[part], net.label(own, begin[part] + moved, end[part] + moved, first[part] + moved, last[part] + moved))
    return sums / np.maximum(size, 1)[:, None]


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score for every row, from its whole text alone.

    Defined cases: null texts and texts without a letter are UNKNOWN with score 0, as is every
    text if no language was learned; of equal probabilities the first language in order of names
    wins; a text of any length is read whole; null ids are passed on; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n = batch.num_rows
            mean = label_texts(net, *columns_bytes(batch.column(2))) if net.langs else np.zeros((n, 1))
            prob = np.exp(mean - mean.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            known = np.array([bool(net.langs) and bool(_LETTER.search(t.as_py() or "")) for t in batch.column(2)], bool)
            pred = [net.langs[k] if ok else UNKNOWN for k, ok in zip(prob.argmax(axis=1), known, strict=True)]
            score = np.where(known, prob.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
