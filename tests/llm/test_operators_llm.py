import math
import random
import warnings
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import catalogue, components, decontaminate, eliasfano, langid, lm, neardup, packing, quality_model, quality_rules, sharding, toxicity, warc, words

from .conftest import odd_rows, sentence

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLES[name])


# hashing of words and packed lists
@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
def test_word_hashes(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    rng = random.Random(1)
    texts = [None, "", "x" * 50, "  "] + ["".join(rng.choice("aB \n\tzé日 \x1f\x0b\x85") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    seen, rows = {}, 0
    for first, hashes, counts in words.hashed(pa.array(texts)):
        at = 0
        for k, n in enumerate(counts):
            own = (texts[first + k] or "").encode().lower().split()
            assert len(own) == n
            assert all(seen.setdefault(w, int(h)) == int(h) for w, h in zip(own, hashes[at : at + n], strict=True))
            at, rows = at + n, rows + 1
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n,top", [(0, 10), (1, 1), (1000, 50), (3000, 1 << 40), (20000, (1 << 64) - 1)])
def test_elias_fano(tmp_path, n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n, np.uint64))
    e = eliasfano.EliasFano.of(v)
    e = eliasfano.EliasFano.read(eliasfano.load(eliasfano.save(f"file://{tmp_path}", "a", e.arrays("e"))), "e")
    assert (e.get(np.arange(len(v))) == v).all()
    q = np.concatenate([v, rng.integers(0, top, 500, np.uint64), np.array([0, top], np.uint64)])
    at = {int(x): k for k, x in enumerate(v)}
    assert (e.find(q) == [at.get(int(x), -1) for x in q]).all()


# 1 packing
def test_fill_is_best():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        capacity = rng.randint(1, 50)
        got = packing.fill(counts, capacity)
        assert all(n <= counts[k] for k, n in got.items())
        items = [k for k, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= capacity)


def test_plan_uses_every_piece():
    counts = {k: (k * 7) % 5 for k in range(1, 64)}
    used = Counter()
    for chosen, times in packing.plan(counts, 64):
        assert sum(k * n for k, n in chosen.items()) <= 64
        used.update({k: n * times for k, n in chosen.items()})
    assert used == +Counter(counts)


def check_pack(got, texts, window):
    got = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    ends = defaultdict(int)
    for r in got:
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values(), default=0) <= window and sorted(ends) == list(range(len(ends)))
    left = Counter()
    for doc, text in texts:
        ids = np.append(packing.token_ids(text or "", ranks=None), [0]).astype("<u4")
        for at in range(0, len(ids), window):
            left[(doc, at, len(ids[at : at + window]), zlib.crc32(ids[at : at + window].tobytes()), len(ids))] += 1
    assert left == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    return sum(ends.values()) / max(1, len(ends) * window)


def test_pack_odd_rows(odd):
    check_pack(packing.pack(odd).collect(), [r[:2] for r in odd_rows()], 1024)


def test_pack_documents(spark, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_pack(packing.pack(docs.repartition(5)).collect(), texts, 1024) > 0.97
    assert check_pack(packing.pack(docs, window=64).collect(), texts, 64) > 0.99


def test_ids_are_those_of_the_tokenizer_file():
    """Also with added tokens written out, and where the faster implementation gives up."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing._path(packing.TOKENIZER))
    for text in ["", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", "x <|endoftext|> <|endoftext|>", " " * 300_000, "日本 é\x85\u200b\U0001f600 1234\r\n\n", sentence(500, "ids")]:
        assert packing.token_ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pack_empty(empty):
    assert packing.pack(empty).collect() == []


# 2 decontamination
def brute_hits(texts, items, window=13):
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans(decontaminate._UPPER, decontaminate._LOWER)
    words_of = lambda t: pattern.findall((t or "").translate(lower))
    out = []
    for doc, text in texts:
        w, hit, listed = words_of(text), set(), set()
        for item, it in items:
            iw = words_of(it)
            n = min(window, len(iw))
            grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    if item is not None:
                        listed.add(str(item))
        out.append((doc, len(w), len(hit), len(listed), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontaminate_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "c", "D", "é", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (3, text(2)), (4, text(5)), (5, "b"), (6, None), (7, ""), (None, "c c c a"), (8, text(30)), (8, "zz")]
    texts = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "..."), (None, text(30)), (93, "pre " + items[0][1].upper() + " post"), (93, items[1][1])]
    got = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "contaminated")) for r in got.collect()), key=key)
    assert got == sorted(brute_hits(texts, items), key=key)


def test_decontaminate_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, sentence(80, "a"))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(odd, items).collect()}
    assert got[6]["contaminated"] and got[8]["n_hit"] == 80 and not got[4]["contaminated"] and got[1]["n_words"] == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(odd, items.limit(0)).collect())


def test_decontaminate_in_passes(spark, monkeypatch, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = sorted(decontaminate.decontaminate(docs, items).collect())
    monkeypatch.setattr(decontaminate, "PASS_PREFIXES", 20)
    assert sorted(decontaminate.decontaminate(docs, items).collect()) == want


def test_decontaminate_repeated_words(spark):
    """Long runs of one word, or of two, take time in proportion to their length."""
    items = [(1, "a " * 400), (2, "a b " * 200), (3, "b " * 12)]
    texts = [(1, "a " * 4000), (2, "a b " * 3000), (3, "x " * 50 + "b " * 12), (4, "c " * 20_000)]
    got = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_hit"], r["n_items"], r["longest"]) for r in got.collect()) == [(1, 4000, 1, 13), (2, 6000, 1, 13), (3, 12, 1, 12), (4, 0, 0, 0)]


def test_decontaminate_clashing_benchmark_columns(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    more = items.withColumns({c: F.lit("clash") for c in ("item", "w", "win", "wid", "len", "k", "t", "j", "doc_id", "uid", "pos", "word")})
    assert sorted(decontaminate.decontaminate(docs, more).collect()) == sorted(decontaminate.decontaminate(docs, items).collect())


# 3 quality rules
def test_quality_rules_odd(odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert [got[k]["n_words"] for k in (1, 2, 3, 4)] == [0, 0, 0, 2] and got[4]["word_chars"] == 8
    assert got[1]["base_failed"] and not got[1]["kept"] and got[6]["kept"] and got[5]["n_words"] == 40_001
    assert quality_rules.quality_rules(odd).count() == len(odd_rows()) and quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("text,n", [("a b c", 0), ("a b c a b c", 6), ("a a a a", 4), ("a b c d a b c", 6), ("x y z q", 0)])
def test_repeat_words(spark, text, n):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.quality_rules(df).first()["n_repeat_words"] == n


# 4 language
def test_gradients():
    rng = np.random.default_rng(0)
    net = langid._start(("a", "b", "c"), rng)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x, lengths = langid.pad([b"abc", b"de", b"fghij"])
    y = np.array([0, 1, 2])
    g, _ = langid._gradients(net, x, lengths, y)
    for name, a in net.w.items():
        at = (ord("f"), 3) if name == "E" else tuple(rng.integers(0, s) for s in a.shape)
        old, step = a[at], 1e-3
        a[at] = old + step
        up = langid._gradients(net, x, lengths, y)[1]
        a[at] = old - step
        down = langid._gradients(net, x, lengths, y)[1]
        a[at] = old
        assert abs(g[name][at] - (up - down) / 2 / step) < 1e-3 * max(1, abs(g[name][at]))


@pytest.fixture(scope="module")
def net(docs):
    return langid.train(docs)


def test_language_held_out(docs, net):
    got = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_language_odd_and_empty(odd, empty, net):
    got = {r["doc_id"]: r for r in langid.identify(odd, net).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3)) and got[5]["lang_pred"] in net.langs
    assert langid.identify(odd, net).count() == len(odd_rows()) and langid.identify(empty, net).count() == 0
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def plain_labels(net, raw):
    """Log probabilities of every position of a text, computed byte by byte in each position's own window."""
    size, out = langid.HIDDEN, []
    w = {k: v.astype(float) for k, v in net.w.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def run(part, d):
        state, states = np.zeros(size), []
        for byte in part:
            g, s = w["E"][byte] @ w["X" + d] + w["B" + d], state @ w["H" + d]
            z, r = sig(g[:size] + s[:size]), sig(g[size : 2 * size] + s[size : 2 * size])
            n = np.tanh(g[2 * size :] + r * s[2 * size :])
            state = (1 - z) * n + z * state
            states.append(state)
        return states

    raw = raw.lower()
    for first in range(0, len(raw), langid.WINDOW):
        last = min(len(raw), first + langid.WINDOW)
        begin, end = max(0, first - langid.AROUND), min(len(raw), last + langid.AROUND)
        f, b = run(raw[begin:end], "f"), run(raw[begin:end][::-1], "b")[::-1]
        for p in range(first - begin, last - begin):
            z = np.concatenate([f[p], b[p]]) @ w["O"] + w["C"]
            out.append(z - np.log(np.exp(z).sum()))
    return out


def test_language_equals_a_plain_loop(docs, net):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(12).collect() if r["text"]] + ["", "A", "日本語 é", "x" * 700, "one two " * 60]
    texts = [t[:1500] for t in texts]
    raw = [t.encode() for t in texts]
    got = langid.label_texts(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, row in zip(raw, got, strict=True):
        assert np.allclose(row, np.mean(plain_labels(net, t), axis=0) if t else 0, atol=2e-3)


def test_language_does_not_depend_on_the_batch(docs, net, monkeypatch):
    texts = pa.array([r["text"] for r in docs.orderBy("doc_id").limit(40).collect()])
    whole = langid.label_texts(net, *words.columns_bytes(texts))
    monkeypatch.setattr(langid, "TOGETHER", 7)
    assert np.allclose(whole, langid.label_texts(net, *words.columns_bytes(texts)), atol=1e-4)


def test_packing_and_smoothing_a_piece_needs_little_memory(tmp_path):
    """Beside its arguments, a piece of a level takes some 50 bytes an n-gram at most while it is written."""
    import tracemalloc
    from types import SimpleNamespace

    rng, n, size = np.random.default_rng(3), 1_500_000, 500_000
    for width in (1, 13, 64):
        values = rng.integers(0, 1 << min(width, 63), 600_001).astype(np.uint64)
        assert (eliasfano.unpack(eliasfano.pack(values, width), width, np.arange(len(values))) == values).all()
    ctx, sub, counts = np.sort(rng.integers(0, size, n)), rng.integers(0, 1 << 20, n), np.ones(n, np.int64)
    total, distinct = np.bincount(ctx, counts, size), np.bincount(ctx, minlength=size)
    flat = SimpleNamespace(counts=lambda ids: ids, first=lambda counts: np.full(len(counts), -3.0))
    tracemalloc.start()
    try:
        lm._finish(flat, 2, 0, f"file://{tmp_path}", ctx, sub, counts, total, distinct)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50 * n


def test_language_labels_are_summed_as_directions_meet():
    """Beside the forward labels of all positions, labelling keeps what belongs to one position."""
    import tracemalloc

    net = langid._start(tuple("abcd"), np.random.default_rng(1))
    data = np.random.default_rng(2).integers(0, 256, 400_000).astype(np.uint8)
    begin = np.arange(0, len(data), 200)
    tracemalloc.start()
    try:
        net.label(data, begin, begin + 200, begin + 20, begin + 180)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * 4 * 4 * len(data)


def test_language_runs_only_states_that_labels_need(monkeypatch):
    """Each direction begins AROUND bytes before a window's own bytes, and stops at their end."""
    net, step, rows = langid._start(tuple("abcd"), np.random.default_rng(1)), langid._row_step, []
    monkeypatch.setattr(langid, "_row_step", lambda tables, us, byte, *rest: (rows.append(len(byte)), step(tables, us, byte, *rest)))
    sizes = np.array([0, 1, 150, 192, 200, 1000, 5000])
    at = np.cumsum([0, *sizes])
    langid.label_texts(net, np.random.default_rng(2).integers(97, 123, at[-1]).astype(np.uint8), at)
    edges = [b for n in sizes for b in range(langid.WINDOW, n, langid.WINDOW)]
    after = [min(langid.AROUND, n - b) for n in sizes for b in range(langid.WINDOW, n, langid.WINDOW)]
    assert sum(rows) == 2 * sizes.sum() + langid.AROUND * len(edges) + sum(after)


def test_language_gates_that_are_wide_open_or_shut():
    net = langid._start(tuple("abcd"), np.random.default_rng(1))
    wide = langid.Network(net.langs, {k: v * np.float32(1 if k in "OC" else 30) for k, v in net.w.items()})
    data = np.random.default_rng(2).integers(0, 256, 3000).astype(np.uint8)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = langid.label_texts(wide, data, np.array([0, 1000, 3000]))
        one = langid.label_texts(wide, data, np.array([0, 1]))
    with np.errstate(over="ignore"):
        assert np.isfinite(got).all() and np.allclose(one[0], plain_labels(wide, bytes(data[:1]))[0], atol=1e-4)


def test_all_languages_are_learned(spark):
    rows = [(k, "".join(chr(97 + (k % 30 + j * j) % 26) for j in range(60)), f"l{k % 30}") for k in range(300)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=10).langs) == 30


# 5 language model
def test_base_score_and_gain(spark, docs, tmp_path):
    got = {r["doc_id"]: r for r in lm.score_texts(docs, lm.train(docs, f"file://{tmp_path}/lm", piece_bytes=100_000)).collect()}
    tokens = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b" "] for r in docs.collect()}
    trained = {k for k in tokens if zlib.crc32(str(k).encode()) % 10}
    counts = Counter(w for k in trained for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    for k, own in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = got[k]
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(counts[w] > 0 for w in own) and r["train_tokens"] == n and r["held_out"] == (k not in trained)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("piece_bytes,bits", [(1 << 20, 63), (120, 63), (120, 13)])
def test_scores_equal_brute_force(spark, tmp_path, monkeypatch, piece_bytes, bits):
    """Discounted probabilities of all n-grams, also of those seen once, in contexts that are cut, and counted in passes."""
    monkeypatch.setattr(lm, "KEY_BITS", bits)
    texts = {k: "alpha beta " + sentence(25, f"few{k % 7}") + f" own{k} tail{k} end{k}" for k in range(40)}
    texts[100] = texts[3] + " unseen " + texts[4]
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    docs = rows.where("doc_id < 100")
    trie = lm.train(docs, f"file://{tmp_path}/lm", piece_bytes=piece_bytes)
    tokens = {k: [*t.lower().split(), " "] for k, t in texts.items()}
    one, two, three = Counter(), Counter(), Counter()
    for k in (k for k in tokens if k < 100 and zlib.crc32(str(k).encode()) % 10):
        own = [" ", *tokens[k]]
        one.update(own[1:])
        two.update(zip(own, own[1:], strict=False))
        three.update(zip(own, own[1:], own[2:], strict=False))
    assert sum(n == 1 for n in two.values()) > 50 and sum(n == 1 for n in three.values()) > 50
    opened = lm.Trie(trie)
    assert [sum(len(opened.level(n, s)["p"]) for s in range(len(opened.files[n]))) for n in (2, 3)] == [len(two), len(three)]
    if piece_bytes < 1000:
        assert all(len(opened.pieces[n].split) for n in (2, 3))
    left2, left3 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for (a, b), n in two.items():
        left2[a] -= (n - lm.DISCOUNT) / (one[a] + lm.SMOOTH)
    for (a, b, c), n in three.items():
        left3[a, b] -= (n - lm.DISCOUNT) / (two[a, b] + lm.SMOOTH)

    def p1(w):
        return (one[w] + 0.1) / (sum(one.values()) + 0.1 * (len(one) + 1))

    def p2(a, w):
        return max(0, two[a, w] - lm.DISCOUNT) / (one[a] + lm.SMOOTH) + left2[a] * p1(w)

    def p3(a, b, w):
        return p2(b, w) if (a, b) not in two else max(0, three[a, b, w] - lm.DISCOUNT) / (two[a, b] + lm.SMOOTH) + left3[a, b] * p2(b, w)

    for r in lm.score_texts(rows, trie).collect():
        own = [" ", *tokens[r["doc_id"]]]
        want = math.log10(p2(own[0], own[1])) + sum(math.log10(p3(*x)) for x in zip(own, own[1:], own[2:], strict=False))
        assert abs(r["score"] - want) < 3 * lm.QUANTUM * len(own)


def test_model_is_a_distribution(spark, docs, tmp_path):
    """After seen contexts the probabilities of all words, and of one unknown word, add up to 1 or a little less."""
    trie = lm.Trie(lm.train(docs, f"file://{tmp_path}/lm"))
    known = np.concatenate([trie.level(1, s)["list"].get(np.arange(trie.level(1, s)["list"].n)) for s in range(trie.segments)])
    every = np.append(known, np.uint64(12345))
    text = np.array([words.hash_words(np.frombuffer(b"the of and", np.uint8), np.zeros(1, np.int64))[0]]).ravel()
    for context in (text[:1], text[:2], text[1:3]):
        tokens = np.concatenate([np.append(context, w) for w in every])
        starts = np.arange(0, len(tokens), len(context) + 1)
        _, model, _ = trie.score(tokens, starts)
        assert 0.97 < (10 ** model[len(context) :: len(context) + 1]).sum() < 1.0001


def test_language_model_odd_and_empty(odd, empty, tmp_path):
    got = lm.score_texts(odd, lm.train(odd, f"file://{tmp_path}/a")).collect()
    assert len(got) == len(odd_rows()) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    none = lm.train(empty, f"file://{tmp_path}/b")
    assert {r["n_known"] for r in lm.score_texts(odd, none).collect()} == {0} and lm.score_texts(empty, none).count() == 0


def test_lookups_do_not_grow_with_pieces(spark, docs, tmp_path, monkeypatch):
    """A trie of many pieces is searched for longer runs of texts: not once a piece and MB of text."""
    trie = lm.train(docs, f"file://{tmp_path}/lm", piece_bytes=4_000)
    texts = pa.array([r["text"] for r in docs.collect()] * 8)
    opened, calls, search = lm.Trie(trie), [], lm.lower_bound
    monkeypatch.setattr(lm, "lower_bound", lambda *a: calls.append(1) or search(*a))
    runs = list(lm._runs(texts, lm.most_pieces(trie)))
    for w, n in runs:
        opened.score(*lm._with_end(w, n))
    pieces = len(trie["files"][2]) + len(trie["files"][3])
    assert texts.nbytes > 3 << 20 and pieces > 200 and len(calls) <= pieces
    parts = list(words.hashed(texts))
    assert len(parts) > 3 and all((np.concatenate([p[k + 1] for p in parts]) == np.concatenate([r[k] for r in runs])).all() for k in (0, 1))
    few = list(lm._runs(texts, 1))
    assert len(few) == len(parts) and max(len(w) for w, _ in few) < 1 << 20
    assert list(lm._runs(pa.array([], pa.string()), 5)) == []


@pytest.mark.parametrize("width", [1, 7, 17, 33, 57, 58, 64])
def test_unpack(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, (1 << width) - 1, 1000, np.uint64, endpoint=True)
    packed, at = eliasfano.pack(values, width), rng.permutation(1000)
    assert (eliasfano.unpack(packed, width, at) == values[at]).all()


@pytest.mark.parametrize("n,top", [(2, 1), (5, 3), (1000, 10), (1000, 1000), (1000, 1 << 40), (20000, 30000)])
def test_neighbouring_numbers(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, np.uint64))
    at = rng.integers(0, n - 1, 500)
    own, after = eliasfano.EliasFano.of(v).pairs(at)
    assert (own == v[at]).all() and (after == v[at + 1]).all()


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    counts = rng.integers(1, 900, len(keys))
    a, b = lm.decode(lm.encode(keys, counts))
    assert (a == keys).all() and (b == counts).all()


# 6 quality model
def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    got = quality_model.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    table = docs.select(quality_model.features(F.col("text")).alias("f"), quality_model.score_column(F.col("text"), model).alias("s")).select("f.*", "s").toPandas()
    assert np.allclose(model.score(table[list(quality_model.FEATURES)].to_numpy(float)), table["s"])


def plain_features(text):
    """The model's statistics in plain Python."""
    import re

    text = text or ""
    own = [w for w in re.split("[ \t\n\x0b\f\r]", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    grams = Counter(zip(own, own[1:], own[2:], strict=False))
    repeated = {i + j for i, g in enumerate(zip(own, own[1:], own[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    n, chars, find = max(1, len(own)), sum(map(len, own)), lambda p: len(re.findall(p, text))
    return [
        math.log1p(len(own)),
        chars / n,
        find("[#*$%&|<>]") / max(1, chars),
        find("[A-ZÀ-ÖØ-Þ]{2,}") / n,
        sum(w.lower() in quality_rules.STOP_WORDS for w in own) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        len(own) / max(1, len(lines)),
        len(repeated) / n,
        len(set(own)) / n,
        find("[!?]{2,}") / n,
        find("[0-9]+") / n,
        find(r"\|") / n,
    ]


def test_quality_scores_equal_plain_rules(spark, docs, labels, odd):
    """Statistics, rules and weights, all in plain Python, for documents and odd rows."""
    model = quality_model.train(docs, labels)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()] + [r[:2] for r in odd_rows()]
    want = []
    for k, t in texts:
        x = plain_features(t)
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[f] <= at) if below else (x[f] > at) for f, below, at in rule))
        want.append((k, round(1 / (1 + math.exp(-z)), 6), zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 0))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = [(r["doc_id"], round(r["score"], 6), r["held_out"]) for r in quality_model.score_quality(both, model).collect()]
    assert Counter(got) == Counter(want) and len(model.rules) > 3


def test_labels_that_repeat_ids_and_clash(spark, docs, labels):
    """Repeated ids in either table and clashing columns crash nothing, and the sample stays bounded."""
    more = labels.unionByName(labels.limit(20)).withColumns({c: F.lit("clash") for c in ("text", "t", "d", "i", "y", "source", "f", "n_words", "c", "p")})
    twice = docs.unionByName(docs)
    model = quality_model.train(twice, more, rows=50)
    assert quality_model.score_quality(twice, model).count() == 2 * docs.count()
    lexicon = toxicity.train(twice, more, rows=50)
    assert toxicity.score_toxicity(twice, lexicon).count() == 2 * docs.count()


def test_quality_model_odd_and_empty(odd, empty, no_labels, labels, docs):
    model = quality_model.train(docs, labels)
    got = quality_model.score_quality(odd, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.score_quality(empty, model).count() == 0
    flat = quality_model.train(empty, no_labels)
    assert {round(r["score"], 6) for r in quality_model.score_quality(odd, flat).collect()} == {0.5}


# 7 toxicity
def test_fold():
    assert toxicity.fold("You 1d10t, m0r0n$$$ ＩＤＩＯＴ іdiot 1234 w0r7hless 5tupid") == " you idiot moron idiot idiot 1234 worthless stupid "


def test_exceptions_cancel():
    entries = ((" trash ", 5.0), (" idio", 4.0))
    assert [k for _, k in toxicity.matches(" the trash idiots ", entries)] == [0, 1]
    assert [k for _, k in toxicity.matches(" trash can idiots ", entries, (" trash can ",))] == [1]


def test_toxicity_learns(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(600):
        bad = k % 5 == 0
        own = sentence(40, k).split()
        for _ in range(3 if bad else 0):
            own.insert(rng.randint(0, 40), rng.choice(["blarg", "zonk", "frobbing", "frobbed", "fr0bber"]))
        if k % 21 == 0:
            own += ["zonk", "valley"] if not bad else []
        rows.append((k, " ".join(own)))
        marks.append((k, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert any("zonk valley" in p for p in model.exceptions)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)


def naive_score(text, lexicon):
    """Every entry and phrase searched at every place of the folded text."""
    folded = toxicity.fold(text or "")
    at = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spans = [(i, i + len(p)) for p in lexicon.exceptions if p not in dict(lexicon.entries) for i in at(p)]
    weight = 0.0
    for p, w in lexicon.entries:
        weight += sum(w for i in at(p) if not any(a <= i and i + len(p) <= b for a, b in spans))
    n = max(1, len(folded.split()))
    z = lexicon.bias + lexicon.slopes[0] * math.log1p(100 * weight / n) + lexicon.slopes[1] * math.log1p(weight) / (1 + 0.1 * math.log1p(n))
    return 1 / (1 + math.exp(-z))


def test_toxicity_equals_a_naive_search(spark, docs, labels):
    learned = toxicity.train(docs, labels)
    assert learned.entries
    made = toxicity.Lexicon(((" the ", 1.5), (" win", 2.0), (" sum", 1.0), (" river ", 0.5)), (" the river ", " winter summer ", " summer "), -2.0, (1.0, 0.5))
    texts = docs.select("doc_id", F.substring("text", 1, 3000).alias("text"))
    for lexicon in (learned, made):
        got = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in toxicity.score_toxicity(texts, lexicon).collect()}
        for r in texts.collect():
            want = naive_score(r["text"], lexicon)
            assert abs(got[r["doc_id"]][0] - want) < 1e-9 and got[r["doc_id"]][1:] == (int(want >= 0.7), zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_many_matches_in_one_text():
    """A very long text with as many matches as phrases takes no quadratic time."""
    assert len(toxicity.matches(" " + "bad can bad " * 60_000, ((" bad ", 1.0),), (" bad can ",))) == 60_000


def test_lexicon_of_many_entries_keeps_its_exceptions(spark):
    """600 entries: a phrase that only clean documents hold still cancels."""
    entries = [(f" bad{k} ", 2.0) for k in range(600)]
    rows = [(1, f"x bad{k} y") for k in range(600)] + [(0, f"{sentence(9, k)} bad7 valley") for k in range(5)]
    assert toxicity._exceptions(toxicity.folded(spark.createDataFrame(rows, "y int, t string")), entries) == (" bad7 valley ",)


def test_lexicon_beside_copies_of_a_long_text(spark):
    """Words of a few toxic texts enter, also where a long toxic text is copied very often."""
    long = " ".join(f"{a}{b}{c}" for a in "bcdfghjklmnpqrstvwxz" for b in ("alo", "emi", "uru", "osa", "ine") for c in ("pat", "ked", "vum", "zor", "lis", "gan", "tew", "mib", "ruk", "nof", "dax", "hul", "wep", "jic", "sot", "bry", "cly", "fen", "gop", "hiv"))
    rows = [(f"{sentence(30, k)} blarg{'' if k % 2 else ' zonk'}", 1) for k in range(6)] + [(long, 1)] * 300 + [(sentence(30, k), 0) for k in range(100, 500)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    assert " blarg " in dict(toxicity.train(docs, labels).entries)


def test_phrase_of_toxic_documents_after_many_matches(spark):
    """A phrase that toxic documents hold only after 50 other matches is no exception."""
    rows = [(f"{sentence(20, k)} {'blarg river ' * 60}{'blarg valley' if k % 5 else ''}", 1) for k in range(30)]
    rows += [(sentence(20, k) + (" blarg valley" if k < 130 else ""), 0) for k in range(100, 500)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert any(p.startswith(" blarg") for p, _ in model.entries) and not any("blarg valley" in p for p in model.exceptions)


def test_toxicity_odd_and_empty(odd, empty, no_labels):
    model = toxicity.Lexicon(((" summer ", 3.0),), (), -3.0, (2.0, 2.0))
    got = toxicity.score_toxicity(odd, model).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(odd_rows()) and by[1] == by[2] == by[3] == by[4] < by[6]
    assert toxicity.score_toxicity(empty, model).count() == 0 and toxicity.train(empty, no_labels).entries == ()


# 8 archives
def test_archives(spark, tmp_path):
    import base64
    import hashlib

    rows = [(k, f"http://h{k}.com/ä b", f"page {k % 4}" * (k % 3)) for k in range(40)] + [(50, None, None), (51, "u", ""), (None, "u", "page 1"), (52, "x", "é" * 500_000), (5, rows_url := "http://again", "page 1page 1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(index).collect()
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = Counter()
    for k, _, html in rows:
        body = (html or "").encode()
        back = None if first.get(html or "") == k else first.get(html or "")
        want[(k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if back is None else "revisit", back, body if back is None else None)] += 1
    assert want == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got)
    for r in index.limit(5).collect():
        head, _ = warc.read_record(r["bundle"], r["frame"], r["offset"])
        assert head["WARC-Record-ID"] == r["record_id"]
    assert warc.read_archives(index).rdd.getNumPartitions() == index.select("bundle").distinct().count()
    assert rows_url and warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_archives_of_odd_pages(spark, tmp_path):
    """Clashing columns, a very long payload, ties and repeated rows."""
    rows = [(3, "u", "same"), (1, "u", "same"), (1, "u", "same"), (2, "v", "x" * 3_000_000), (7, None, None), (6, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "body", "sha", "first", "back", "n", "bundle", "frame", "payload", "bytes")})
    got = warc.read_archives(warc.write_archives(pages.repartition(2), f"file://{tmp_path}/w")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, 4, "response", None), (1, 4, "response", None), (2, 3_000_000, "response", None), (3, 4, "revisit", 1), (6, 0, "response", None), (7, 0, "revisit", 6)]


def test_frames_and_bundles(tmp_path):
    out = warc.BundleWriter(f"file://{tmp_path}", frame_bytes=2000, bundle_bytes=3000)
    rows = []
    for k in range(60):
        name, data = warc.record(k, "u", random.Random(k).randbytes(400), None, "d")
        out.add(name, k, data)
        rows += out.take()
    rows += out.take(end=True)
    assert [r[1] for r in rows] == list(range(60)) and len({r[2] for r in rows}) > 3
    assert [r[1] for r in warc._bundles(sorted({r[2] for r in rows}), True)].__len__() == 60


# 9 sharding
def check_shards(rows, got, shards, slack):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) <= slack for k in range(shards))


def test_shards(spark, docs, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_shards(rows, sharding.shard_documents(docs, 4).collect(), 4, max(len(t.encode()) for _, t in rows) + 100)
    # the longest text is most of these rows, and whole: the others share the rest
    got = sharding.shard_documents(odd, 3).collect()
    check_shards([r[:2] for r in odd_rows()], got, 3, 10**6)
    longest = max(got, key=lambda r: r["size"])
    assert sum(r["size"] for r in got if r["shard"] == longest["shard"]) < longest["size"] + 3000
    assert sharding.shard_documents(empty, 4).count() == 0


def test_shards_of_one_text(spark):
    rows = [(k * 3, "same text") for k in range(900)] + [(k * 3 + 1, f"own {k}") for k in range(300)]
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect(), 16, 45)


@pytest.mark.parametrize("ids", [[None, *range(900)], [-(1 << 63), (1 << 63) - 1, *range(400)], [-(1 << 62), 1 << 62, *range(400)], [7] * 500, [None] * 500, [5] * 300 + [None] * 300])
def test_shards_of_one_text_with_any_ids(spark, ids):
    """Null, extreme and repeated ids inside one heavy text."""
    rows = [(k, "same text") for k in ids]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 16).collect()
    check_shards(rows, got, 16, 10 + 0.01 * 10 * len(rows) / 16)


@pytest.mark.parametrize("seed", range(4))
def test_shards_have_the_wanted_bytes(spark, seed):
    """Every splitter is off by the tolerance or by one row at most."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, rng.randint(-50, 50), rng.randint(-(1 << 63), (1 << 63) - 1)]), rng.choice(["", None, "a" * rng.randint(1, 40), f"own {rng.random()}"])) for _ in range(700)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    total = sum(r["size"] for r in got)
    check_shards(rows, got, 5, 2 * (42 + 0.002 * total / 5))


# 10 near duplicates
def word_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(texts, percent=85, size=5):
    sets = {k: word_set(t, size) for k, t in texts}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,percent", [(1024, 85), (4, 85), (8, 80)])
def test_near_duplicates_brute_force(spark, monkeypatch, block, percent):
    """Families whose members are at and around the limit, so that hubs do not reach all of them."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block * 500)
    monkeypatch.setattr(neardup, "PAIR_ROWS", block)
    monkeypatch.setattr(neardup, "HUB_ROWS", 8)
    rng = random.Random(8)
    texts = [t for f in range(6) for t in family(rng, sentence(100, f), 25, 3)] + [t for f in range(3) for t in family(rng, sentence(60, f"s{f}"), 12, 1)]
    texts += ["", None, "one two", "one two", "One TWO", "a b c d e", "a b c d e"] + texts[:10]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_repeated_ids(spark):
    """An id with several texts has the links of all of them, and joins their components."""
    a, b, c = sentence(60, "ra"), sentence(60, "rb"), sentence(60, "rc")
    rows = [(5, a), (5, b), (9, b + " more"), (3, a + " tail"), (7, c), (8, c), (8, "quite another text of six words"), (6, None), (6, "quite another text of six words"), (1, "alone")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {k: v for (k, n), v in got.items() if n} == {5: 3, 9: 3, 3: 3, 7: 6, 8: 6, 6: 6, 1: 1} and got[6, 0] == 6


def test_near_duplicates_recall_on_documents(spark):
    """All true links of the ids divisible by 100, found by brute force against all rows, lie inside components."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: word_set(r["text"]) for r in docs.collect()}
    comp = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    links = [(a, b) for a in sets if a % 100 == 0 for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert sum(comp[a] == comp[b] for a, b in links) == len(links)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_shape_misses_few(percent):
    rows, least = neardup.shape(percent)
    p = percent / 100
    assert (1 - p**rows) ** (120 // rows) <= 1e-5 and 120 % rows == 0
    assert sum(math.comb(120, k) * p**k * (1 - p) ** (120 - k) for k in range(least)) <= 1e-5


def test_near_duplicates_odd_and_empty(odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[7]["component_id"] == by[8]["component_id"] == 6 and by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[3]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: top(k) for k in root}


