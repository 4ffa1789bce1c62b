"""The corpus operators against brute force, on awkward rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, corpus, frame, prose, query, words_of

from lectern.llm import hmm, induced, mixing, ngram, pieces, registry, ring, secrets, simhash, suffixes, tagger, topk

ROWS = corpus()
CLASH = "n key data band_lang spans kept_id copies arc word text_crc32 p_domain mix_tokens scan_base lectern_quality"


def test_registry_has_all_ten():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_table(spark, tmp_path, name):
    if name.startswith("op3_"):
        assert query(spark, tmp_path, registry.QUERIES[name], [], "embeddings", "vec_id long, embedding array<float>, label int") == []
    else:
        assert query(spark, tmp_path, registry.QUERIES[name], []) == []


# 1


def features(text):
    w = words_of(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    cover = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, tmp_path):
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op1_quality"], ROWS)}
    assert len(got) == len(ROWS)
    for i, text, *_ in ROWS:
        f, r = features(text), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == f
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = ngram.keep_good(frame(spark, ROWS, CLASH))
    assert kept.columns == frame(spark, [], CLASH).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def plain_symbols(text):
    """Symbols of a text, by the rules of the docstring."""
    out, last = [], " "
    for c in text:
        x = int(ngram._SYMBOL[ord(c)]) if ord(c) < 0x3000 else 31 + ord(c) % 24
        mark = x == 0 or 28 <= x <= 30 or x >= 55
        if not (mark and c == last) and not (x == 0 and (not out or out[-1] == 0)):
            out.append(x)
        last = c
    return out


class PlainModel:
    """Interpolated modified Kneser-Ney written down once more, over tuples."""

    def __init__(self, texts):
        self.counts = {4: Counter()}
        for t in texts:
            s = [0, 0, 0, *plain_symbols(t)]
            self.counts[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.by = {}, {}
        for k, c in self.counts.items():
            n = Counter(c.values())
            if all(n[i] for i in (1, 2, 3, 4)):
                y = n[1] / (n[1] + 2 * n[2])
                self.d[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]
            else:
                self.d[k] = [0, 0.5, 1, 1.5]
            for g, x in c.items():
                self.by.setdefault(g[:-1], []).append(x)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 64
        below = self.p(gram[1:])
        if gram[:-1] not in self.by:
            return below
        xs, d = self.by[gram[:-1]], self.d[k]
        x = self.counts[k][gram]
        return ((x - d[min(x, 3)] if x else 0) + sum(d[min(y, 3)] for y in xs) * below) / sum(xs)

    def logp(self, text):
        s = [0, 0, 0, *plain_symbols(text)]
        return sum(math.log10(self.p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)), len(s) - 3


def test_quality_by_brute_force(spark):
    """Perplexity of every text, and the verdict by its bands, for a language of many and one of few texts."""
    rows = [r for r in ROWS if r[2] == "fr" and (r[1] is None or len(r[1]) < 2000)] + [(900, "ab cd ab cd " * 20, "xx", "s", 0), (901, None, None, None, None)]
    got = {r.doc_id: r for r in ngram.score_documents(frame(spark, rows, CLASH)).collect()}
    for lang in ("fr", "xx"):
        texts = {i: t for i, t, la, *_ in rows if la == lang and t is not None}
        model = PlainModel(texts.values())
        good = {}
        for i, t in texts.items():
            logp, n = model.logp(t)
            if n:
                assert math.isclose(got[i].log10_ppl, -logp / n, rel_tol=1e-5), i
            if not got[i].base_failed:
                good[t] = -logp / n
        if good:
            mid = np.median(list(good.values()))
            for i, t in texts.items():
                r = got[i]
                if not r.base_failed:
                    assert abs((r.low + r.high) / 2 - mid) < 2e-4 and r.kept == (r.low <= r.log10_ppl <= r.high)
                else:
                    assert not r.kept


def test_salad_is_less_likely(spark):
    """Contexts cross words: the same words in another order, with other neighbours, score worse."""
    rng = random.Random(1)
    line = "the house of the river and the winter garden of the morning table "
    texts = [(line * 4)[rng.randrange(20) :] for _ in range(40)]
    codes = np.concatenate([ngram.symbols_of([t])[0] for t in texts])
    counts, level = {}, np.unique(codes.astype(np.int64), return_counts=True)
    for order in range(ngram.ORDER, 0, -1):
        counts[0, order] = level
        level = np.unique(level[0] & (1 << ngram.BITS * (order - 1)) - 1, return_counts=True)
    model = ngram.Model(["en"], counts)
    words = line.split() * 4
    rng.shuffle(words)
    ordered, mixed = (x[1] / x[0] for x in model.text_scores("en", [line * 4, " ".join(words)]))
    assert ordered > mixed + 0.02
    context = int(codes[30]) >> ngram.BITS << ngram.BITS & (1 << ngram.BITS * ngram.ORDER) - 1
    assert math.isclose((10 ** model.score("en", np.arange(1 << ngram.BITS) | context)).sum(), 1, rel_tol=1e-3)


# 2


def removed_spans(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out.append([tuple(s) for s in spans])
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 0])
def test_suffix_dedup(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)  # 0: every window takes the way of crowded anchors
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op2_suffix_dedup"], ROWS)}
    texts = [(t or "").encode() for _, t, *_ in ROWS]
    for (i, *_), t, spans in zip(ROWS, texts, removed_spans(texts, 200)):
        kept = suffixes.kept_bytes(t, spans)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_keeps_columns(spark):
    df = frame(spark, ROWS[:20] + [(99, None, "en", "s", None)], CLASH)
    out = suffixes.remove_repeats(df)
    assert out.columns == df.columns and out.count() == 21 and out.where("doc_id = 99").first().text is None


@pytest.mark.parametrize("memory, buffer", [(None, None), (0, 8), (None, 60)])
def test_induced_sorting(memory, buffer):
    """Order and common prefixes against sorting, with arrays in memory and in files, and queues of some runs."""
    rng = np.random.default_rng(1)
    deepest = written = 0
    for trial in range(80):
        t = rng.integers(1, int(rng.integers(2, 7)), int(rng.integers(1, 250)))
        t = np.tile(t[: max(1, len(t) // 7)], 9) if trial % 3 == 0 else np.repeat(t, 3) if trial % 5 == 0 else t
        u = np.unique(np.append(t, 0), return_inverse=True)[1].astype(np.uint16)
        suffixes_ = sorted(range(len(u)), key=lambda i: u[i:].tolist())
        shared = [0] + [next(k for k in itertools.count() if a + k >= len(u) or b + k >= len(u) or u[a + k] != u[b + k]) for a, b in zip(suffixes_, suffixes_[1:])]
        with induced.scratch(memory, buffer) as files:
            order, lcp = induced.sort_suffixes(u, int(u.max()) + 1, files)
            deepest, written = max(deepest, files.deepest), written + files.written
        assert list(order) == suffixes_ and list(lcp) == shared
    assert deepest >= 3 and (written > 100) == (buffer == 8)


@pytest.mark.parametrize("sigma", [2, 5, 300, 70_000])
@pytest.mark.parametrize("buffer", [1, 16, None])
def test_substrings_are_named_by_rank(sigma, buffer):
    """Names of substrings against sorting; words of many and few symbols, long ties, and blocks that are merged."""
    rng = np.random.default_rng(sigma)
    for trial in range(30):
        t = rng.integers(1, sigma, int(rng.integers(2, 400)))
        t = np.tile(t[: max(1, len(t) // 9)], 9) if trial % 3 == 0 else np.repeat(t, rng.integers(1, 40, len(t))) if trial % 3 == 1 else t
        u = np.append(t, 0).astype(np.int32)
        with induced.scratch(0, buffer) as files:
            level = induced.Level(u, sigma, files)
            names, n = level.name()
            ends = list(level.lms[1:]) + [len(u) - 1]
            # What ends is larger than what goes on: its last symbol begins a suffix of type S.
            parts = [(*u[a : b + 1].tolist(), sigma) if a < b else (0,) for a, b in zip(level.lms, ends)]
        ranks = {x: k for k, x in enumerate(sorted(set(parts)))}
        assert list(names) == [ranks[x] for x in parts] and n == len(ranks)


@pytest.mark.parametrize("part, buffer", [(1, 40), (5, 1 << 15), (1 << 12, 1 << 15)])
def test_a_level_is_induced_once(monkeypatch, part, buffer):
    """One induction a level (naming takes none, as it did), with queues whose buffers are sorted part by part."""
    calls = []
    induce = induced.Level.induce
    monkeypatch.setattr(induced, "PART", part, raising=False)
    monkeypatch.setattr(induced.Level, "induce", lambda self, *a: calls.append(self.depth) or induce(self, *a))
    rng = np.random.default_rng(2)
    for trial in range(12):
        t = rng.integers(1, 4 + 9 * trial, 1500)
        t = np.concatenate((t, t[200:900], np.full(40, 3), t[100:700]))
        u = np.unique(np.append(t, 0), return_inverse=True)[1].astype(np.uint16)
        calls.clear()
        with induced.scratch(None, buffer) as files:
            order, lcp = induced.sort_suffixes(u, int(u.max()) + 1, files)
            deepest = files.deepest
        want = sorted(range(len(u)), key=lambda i: u[i:].tolist())
        shared = [0] + [next(k for k in itertools.count() if a + k >= len(u) or b + k >= len(u) or u[a + k] != u[b + k]) for a, b in zip(want, want[1:])]
        assert list(order) == want and list(lcp) == shared
        assert sorted(calls) == list(range(deepest))


def test_dedup_sorts_on_disk(spark, monkeypatch):
    """The whole operator with shards larger than memory and buffer: runs are written, the recursion goes deep, spans stay right."""
    monkeypatch.setattr(induced, "MEMORY", 1 << 14)
    monkeypatch.setattr(induced, "BUFFER", 500)
    rng = random.Random(4)
    texts = [prose(rng, "en", 150) for _ in range(40)]
    texts += [texts[i][:700] + "@" + texts[i + 1][100:] for i in range(20)] + [texts[3][200:500] * 4]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    seen = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
    keyed = suffixes.keyed(frame(spark, rows, CLASH))
    spans = {bytes(r.key): r.spans for r in suffixes.repeated_spans(keyed.selectExpr("repeat_key AS key", "repeat_data AS data"), seen).collect()}
    for t, want in zip(texts, removed_spans([t.encode() for t in texts], 200)):
        got = suffixes.merged([(s.lo, s.hi) for s in spans.get(hashlib.md5(t.encode()).digest(), ())], len(t.encode()))
        assert got == want
    assert seen[0].value > 10 and seen[1].value >= 3


@pytest.mark.parametrize("width", [1, 2, 151])
def test_sliding_minima(width):
    values = np.random.default_rng(width).integers(0, 1 << 60, 40_000).astype(np.uint64)
    for n in (width, 152, (1 << 14) + width - 1, (1 << 14) + width, 40_000):
        assert (suffixes.sliding_min(values[:n], width) == np.lib.stride_tricks.sliding_window_view(values[:n], width).min(1)).all()


def test_contexts_come_once():
    """Places found by copies too, places of another text with the same number, a text that comes again, a text without places."""
    import pyarrow as pa

    text = prose(random.Random(6), "en", 120).encode()
    found = [{"anchor": a, "first": lo, "last": hi} for a, lo, hi in [(7, 30, 60), (-3, 0, 29), (7, 30, 60), (7, 100, 120), (5, 30, 60), (9, 300, len(text) - 199)]]
    places = pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
    keys, data = [b"k" * 16, b"l" * 16, b"k" * 16, b"m" * 16], [text, text[:230], text, text]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(data), pa.array([found, found, found, []], places)], names=["key", "data", "found"])
    rows = [r for b in suffixes.cut_contexts([batch, batch.slice(1)]) for r in b.to_pylist()]
    wanted = {(k, f["first"], f["anchor"], xxhash.xxh3_128_digest(t[f["first"] : f["last"] + 200])) for k, t in zip(keys[:2], data) for f in found if f["last"] + 200 <= len(t)}
    assert len(rows) == len(wanted) and {(r["key"], r["first"], r["anchor"], r["ctx"]) for r in rows} == wanted
    pieces = [r["piece"] for r in rows if r["piece"] is not None]
    assert {xxhash.xxh3_128_digest(x) for x in pieces} == {r["ctx"] for r in rows} and len(pieces) == len(set(pieces))


def test_shards_tell_runs_of_windows():
    """Verdicts of pieces laid end to end: at a piece's first and last window, of copies, of none."""
    import pyarrow as pa

    text = prose(random.Random(7), "en", 200).encode()
    pieces, copies = [text[:300], text[50:400], text[600:850], b"#" + text[800:1000], text[820:1100], b"!" * 200], [1, 1, 2, 1, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(6)]), pa.array(pieces), pa.array(copies)], names=["ctx", "piece", "copies"])
    got = sorted(tuple(r.values()) for b in suffixes.sort_shard(0, 50)([batch]) for r in b.to_pylist())
    assert got == [(b"0", 50, 100), (b"1", 0, 50), (b"2", 0, 50)]


def test_long_texts_are_cut_with_overlap(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "ROOM_BITS", 11)
    text = prose(random.Random(5), "en", 1500).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([b"k" * 16]), pa.array([text])], names=["key", "data"])
    rows = [r for b in suffixes.find_anchors([batch]) for r in b.to_pylist()]
    covered = sorted(s for r in rows for s in range(r["first"], r["last"] + 1))
    assert covered == list(range(len(text) - suffixes.LEAST + 1))


# 3


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def best_five(data):
    """Brute force over rows: a query leaves out its own row alone."""
    v = [(n, i, [math.floor(256 * float(np.float32(x))) for x in e]) for n, (i, e, *_) in enumerate(data) if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for n, q, x in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for m, c, y in v if m != n)[:5]
            want.update((q, rank, c, -s) for rank, (s, c) in enumerate(best, 1))
    return want


def top_rows(got):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def test_topk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)  # many shards, several groups
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=8) / 4).astype(np.float32).tolist(), 0) for i in range(170)]
    data[5] = (5, None, 0)
    data[6] = (6, [0.1, None] + [0.0] * 6, 0)
    data[7] = (7, [float("nan")] + [0.0] * 7, 0)
    data[8] = (8, [float("inf")] + [0.0] * 7, 0)
    data[9] = (None, [0.5] * 8, 0)
    data[60] = (60, data[50][1], 0)
    data[61] = (61, data[50][1], 0)
    data += [data[50], data[50], data[3], (100, data[100][1][:5], 0), (171, [], 0), (150, [0.0] * 8, 0)]  # repeated rows and ids, short, empty and zero vectors
    assert top_rows(query(spark, tmp_path, registry.QUERIES["op3_topk"], data, "embeddings", EMBEDDINGS)) == best_five(data)


def test_topk_with_clashing_columns(spark, tmp_path):
    data = [(i, [float(i % 7), 1.0], 0, "x", "y") for i in range(60)]
    got = query(spark, tmp_path, registry.QUERIES["op3_topk"], data, "embeddings", EMBEDDINGS + ", row string, rank string")
    assert top_rows(got) == best_five(data)


def test_topk_skips_postings():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(800, 16)) * 1000 / 1.6 ** np.arange(16)  # bounds fall, so the least terms together stay below the threshold
    data = data.astype(np.int64)
    one, two = (topk.Shard.of(np.arange(a, b), np.arange(a, b), data[a:b]) for a, b in ((0, 400), (400, 800)))
    for q in range(0, 800, 50):
        seen = Counter()
        best = two.search(data[q].tolist(), q, 5, one.search(data[q].tolist(), q, 5, []), seen)
        assert best == sorted((-int(data[q] @ data[i]), i) for i in range(800) if i != q)[:5]
        assert seen["traversed"] < seen["all"] and seen["probed"] < 400 * 16
    assert seen["traversed"] < seen["all"] / 2
    sparse = data * (rng.random(data.shape) < 0.1)  # lists of pairs
    one, two = (topk.Shard.unpack(*topk.Shard.of(np.arange(a, b), np.arange(a, b), sparse[a:b]).pack()) for a, b in ((0, 400), (400, 800)))
    for q in range(0, 800, 50):
        best = two.search(data[q].tolist(), q, 5, one.search(data[q].tolist(), q, 5, []))
        assert best == sorted((-int(data[q] @ sparse[i]), i) for i in range(800) if i != q)[:5]


def test_topk_beyond_63_bits():
    big = np.array([[1 << 40, 1], [1 << 41, -1], [-(1 << 40), 5]])
    shard = topk.Shard.of(np.arange(3), np.arange(3), big)
    assert shard.search(big[1].tolist(), 1, 5, []) == [(-((1 << 81) - 1), 0), ((1 << 81) + 5, 2)]


# 4


def test_language_id(spark, tmp_path):
    rows = corpus(150, seed=9)
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op4_langid"], rows)}
    right = [got[i]["lang_pred"] == la for i, t, la, *_ in rows[:150] if got[i]["held_out"]]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    for i, t, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        if not any(map(str.isalpha, t or "")):
            assert got[i]["lang_pred"] == "und"


def test_forward_backward():
    rng = np.random.default_rng(4)
    scores, trans, start = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = tagger.posteriors(scores, np.array([5]), trans, start)
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        w = math.exp(start[path[0]] + sum(scores[i, k] for i, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        for i, k in enumerate(path):
            total[i, k] += w
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))


def test_field_gradient_is_exact():
    """Against finite differences of the log-likelihood, and against the sum over all paths."""
    rng = np.random.default_rng(6)
    field = tagger.Field(["de", "en", "fr"], {"house": (1,), "der": (0, 2)})
    field.weights += rng.normal(size=field.weights.shape) / 2
    field.trans, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    chains, gold = [["der", "house", "la", "la", "x1"], ["House."], ["une", "maison"]], [[0, 1, 2, 2, 0], [1], [2, 2]]
    value, used, rows, moves, begin = field.gradient(chains, gold)
    e = field.emissions(chains[0])
    weigh = lambda path: math.exp(field.start[path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(field.trans[a, b] for a, b in zip(path, path[1:])))
    alone = field.gradient(chains[:1], gold[:1])[0]
    assert math.isclose(alone, math.log(weigh(gold[0]) / sum(map(weigh, itertools.product(range(3), repeat=5)))))
    for array, grad, places in ((field.weights, dict(zip(used.tolist(), rows)), [(int(u), j) for u in used[::7] for j in range(3)]), (field.trans, moves, list(itertools.product(range(3), repeat=2))), (field.start, begin, [0, 1, 2])):
        for at in places:
            was = array[at]
            array[at] = was + 1e-5
            up = field.gradient(chains, gold)[0]
            array[at] = was - 1e-5
            down = field.gradient(chains, gold)[0]
            array[at] = was
            got = grad[at[0]][at[1]] if isinstance(grad, dict) else grad[at]
            assert abs((up - down) / 2e-5 - got) < 1e-6


def test_language_of_repeated_and_switching_rows(spark):
    rows = corpus(90, seed=2)[:90] + [(7, "the the the", "en", "s", 0)] * 400 + [(None, "der die das und", None, None, None)]
    docs = frame(spark, rows, CLASH + " lang_pred score held_out")
    field = tagger.train(docs, sample=40)
    assert field.labels == ["de", "en", "fr"] and field.start.any() and field.trans.any()
    assert np.trace(field.trans) / 3 > field.trans.mean()
    rng = random.Random(1)
    mixed = prose(rng, "en", 30).split() + prose(rng, "de", 30).split()
    p = tagger.posteriors(field.emissions(mixed), np.array([60]), field.trans, field.start)
    assert (p[:28].argmax(axis=1) == 1).mean() > 0.9 and (p[32:].argmax(axis=1) == 0).mean() > 0.9
    assert field.predict([None, "", "12 .", "der die das und"])[:3] == [("und", 0.0)] * 3


# 5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def secret_rows():
    rng = random.Random(8)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [f"say Password = '{key(12, b64)}' and token:abc or AKIA{key(16, 'ABCDEFGH234567')} é {key(40, '0123456789abcdef')} end" for _ in range(30)]
    texts += [f"note {key(40, b64)} here", "secret: short", "api_key=\"x\" apikey: abcdef.g", None, "", "token=" + "a" * 5000, "AKIA" + "Z" * 15, "d" * 23 + " " + "d" * 24]
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


def test_secrets(spark, tmp_path):
    rows = secret_rows() + [(100 + i, t, la, s, n) for i, t, la, s, n in ROWS[-12:]]
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op5_secrets"], rows)}
    for i, t, *_ in rows:
        spans, r = base_spans(t or ""), got[i]
        shown = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r["spans"].split(",") if r["spans"] else [])


def plain_score(word, k, alphabet):
    """The battery with exact special functions from the standard library."""
    x = [alphabet.index(c) for c in word]
    n = len(x)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = k / n * sum(c * c for c in Counter(x).values()) - n
    free = k - 1
    p1 = tail(((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    up = [2 * v >= k for v in x]
    both = 2 * sum(up) * (n - sum(up))
    var = both * (both - n) / (n * n * (n - 1))
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    p2 = 2 * tail(abs((runs - both / n - 1) / math.sqrt(var))) if var > 0 else 0.0
    mean = sum(x) / n
    s = sum((v - mean) ** 2 for v in x)
    p3 = 2 * tail(abs((sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / s + 1 / n) * math.sqrt(n))) if s > 0 else 0.0
    return 1 - (1 - max(0.0, min(p1, p2, p3))) ** 3


def test_battery_values(spark):
    rng = random.Random(2)
    words = [("".join(rng.choice(secrets.ENCODINGS[e]) for _ in range(n)), e) for e in secrets.ENCODINGS for n in (20, 41, 90)] + [("a1" * 15, "base36"), ("Chapter7AboutTheHistoryOfRome", "base64"), ("a" * 19 + "1", "hex")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(w, e) for w, e in words], "w string, e string")
    for r in df.select("w", "e", secrets.score_of(F.col("w"), F.col("e")).alias("p")).collect():
        assert math.isclose(r.p, plain_score(r.w, len(secrets.ENCODINGS[r.e]), secrets.ENCODINGS[r.e]), abs_tol=1e-6), r


def planted(n_docs, n_secrets, seed=5):
    """Prose with structured identifiers in every text, and random strings in some; (rows, planted strings)."""
    rng = random.Random(seed)
    b64 = secrets.ENCODINGS["base64"][:62]
    rows, keys = [], set()
    for i in range(n_docs):
        words = prose(rng, ("en", "fr", "de")[i % 3], 60).split()
        words.insert(20, "".join(w.strip(".").capitalize() for w in words[:4])[:28] + str(rng.randrange(100, 10_000)))
        if i < n_secrets:
            keys.add(key := "".join(rng.choice(b64) for _ in range(rng.choice((32, 40, 64)))))
            words.insert(40, key)
        rows.append((i, " ".join(words), "en", "s", None))
    return rows, keys


def test_false_discoveries_are_bounded(spark):
    """Figure: share of false discoveries among random spans at the stated rate, and share of planted strings found."""
    rows, keys = planted(1200, 120)
    out = secrets.find_secrets(frame(spark, rows)).collect()
    text = {i: t for i, t, *_ in rows}
    found = [text[r.doc_id][s.start : s.end] for r in out for s in r.scan_spans if s.rank == 3]
    false = sum(x not in keys for x in found)
    coded = {k for k in keys if any(c.isdigit() for c in k)}
    assert len(found) - false > 0.8 * len(coded) and false <= 2 * secrets.RATE * len(found)  # 107 of 120 planted strings and 1 other


def test_lone_string_is_no_discovery(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["see Chapter7AboutTheHistoryOfRome now", prose(random.Random(1), "en", 90), "short", None])]
    assert all(not r.scan_spans for r in secrets.find_secrets(frame(spark, rows)).collect())
    assert {r.text for r in secrets.redact(frame(spark, rows)).collect()} == {t for _, t, *_ in rows}


def test_redaction_of_many_spans(spark):
    text = " ".join(f"é token=abcdef{i} and" for i in range(3000))
    out = secrets.redact(frame(spark, [(1, text, "en", "s", 0)])).first().text
    assert out == " ".join("é [SECRET] and" for _ in range(3000))


def test_redaction(spark):
    df = frame(spark, secret_rows(), CLASH)
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    for i, t, *_ in secret_rows():
        if t is None:
            assert out[i] is None
        else:
            assert ("[SECRET]" in out[i]) >= bool(base_spans(t)) and all(t[a:b] not in out[i] for a, _, b in base_spans(t))


# 6


def fingerprint(text):
    w = words_of("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, tmp_path):
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op6_simhash"], ROWS)}
    prints = {i: fingerprint(t) for i, t, *_ in ROWS}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in prints}
    df = frame(spark, ROWS, CLASH)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {find(i) for i in prints}


# 7


def test_hmm_scores(spark, tmp_path):
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op7_hmm"], ROWS)}
    counts = Counter()
    for i, t, *_ in ROWS:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in ROWS:
        tokens, r = [*(t or "").encode().lower().split(), b""], got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(x in counts for x in tokens), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), rel_tol=1e-9)
        assert -1e9 < r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_hmm_recursion_is_exact(monkeypatch):
    rng = np.random.default_rng(6)
    emit = rng.random((7, 3))
    model = hmm.Hmm(np.array([0.2, 0.5, 0.3]), rng.dirichlet(np.ones(3), 3), emit / emit.sum(axis=0))
    ids = rng.integers(0, 7, 6).astype(np.uint16)
    total = sum(model.start[p[0]] * math.prod(model.emit[ids[i], k] for i, k in enumerate(p)) * math.prod(model.trans[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=6))
    assert math.isclose(model.log10([ids, ids[:1]])[0], math.log10(total))
    long = rng.integers(0, 7, 1500).astype(np.uint16)
    short_way = model.log10([long])[0]
    monkeypatch.setattr(hmm, "LONG", 5)
    assert math.isclose(model.log10([long])[0], short_way)


def plain_counts(model, docs):
    """Expected counts by the textbook recursions, one token at a time."""
    k, pad = len(model.start), len(model.emit) - 1
    start, moves, cells = np.zeros(k), np.zeros((k, k)), np.zeros((k, pad))
    for ids in docs:
        a = [model.start * model.emit[ids[0]]]
        for x in ids[1:]:
            a.append((a[-1] / a[-1].sum()) @ model.trans * model.emit[x])
        b = np.ones(k)
        for t in range(len(ids) - 1, -1, -1):
            p = a[t] * b / (a[t] * b).sum()
            cells[:, ids[t]] += p
            if t:
                pair = (a[t - 1] / a[t - 1].sum())[:, None] * model.trans * (model.emit[ids[t]] * b)[None]
                moves += pair / pair.sum()
                b = model.trans @ (model.emit[ids[t]] * b)
                b /= b.sum()
        start += p
    return start, moves, cells


def test_expected_counts_of_whole_sequences(monkeypatch):
    rng = np.random.default_rng(8)
    model = hmm.Hmm.seed(np.full(12, 1 / 12), 3)
    docs = [rng.integers(0, 12, n).astype(np.uint16) for n in (1, 7, 1, 300, 41, 95)]
    monkeypatch.setattr(hmm, "PIECE", 16)
    for long in (4096, 40):  # 40: two sequences in pieces, the last piece of one shorter
        monkeypatch.setattr(hmm, "LONG", long)
        for got, want in zip(model.expected(docs), plain_counts(model, docs)):
            assert np.allclose(got, want, rtol=1e-3, atol=1e-4)


def test_hmm_score_by_brute_force(spark, monkeypatch):
    """Lexicon, classes, every pass of Baum-Welch and the likelihood, written down once more over plain words."""
    monkeypatch.setattr(hmm, "OWN", 60)
    monkeypatch.setattr(hmm, "TAILS", 16)
    rows = [r for r in ROWS if r[0] % 3 == 0]
    docs = {i: [*(t or "").encode().lower().split(), b""] for i, t, *_ in rows}
    seen = [docs[i] for i in docs if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for d in seen for w in d[:-1])
    n = sum(counts.values())
    own = [w for w in sorted(counts, key=lambda w: (-counts[w], w)) if counts[w] * 60 >= n]
    place = {b"": 0} | {w: i for i, w in enumerate(own, 1)}
    tail = lambda w: 61 + zlib.crc32(w[-3:]) % 16
    of = lambda w: place.get(w, tail(w))
    size, words = Counter(), Counter()
    for w, c in counts.items():
        if w not in place:
            size[tail(w)] += c
            words[tail(w)] += 1
    prior = np.zeros(61 + 16)
    prior[0] = len(seen) + 0.1
    for w in own:
        prior[place[w]] = counts[w] + 0.1
    for c in range(61, 77):
        prior[c] = size[c] + 0.1 * (words[c] + 1)
    prior /= prior.sum()
    model = hmm.Hmm.seed(prior, 3)
    coded = [np.array([of(w) for w in d]) for d in seen]
    for _ in range(hmm.PASSES):
        start, moves, cells = plain_counts(model, coded)
        e, t = cells.T + hmm.PRIOR * prior[:, None], moves + 1 / 3
        model = hmm.Hmm((start + 1 / 3) / (start + 1 / 3).sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=0))
    got = {r.doc_id: r.score for r in hmm.score_documents(frame(spark, rows, CLASH), states=3).collect()}
    for i, d in docs.items():
        a, total = model.start, 0.0
        for j, w in enumerate(d):
            a = (a if j == 0 else a @ model.trans) * model.emit[of(w)]
            total += math.log10(a.sum())
            a = a / a.sum()
            if w not in place:
                total += math.log10((counts[w] + 0.1) / (size[tail(w)] + 0.1 * (words[tail(w)] + 1)))
        assert math.isclose(got[i], total, rel_tol=1e-4), (i, got[i], total)


def test_baum_welch_gains():
    rng = np.random.default_rng(7)
    docs = [np.where(rng.random(60) < 0.9, rng.integers(0, 5, 60) + 5 * (i % 2), rng.integers(0, 10, 60)).astype(np.uint16) for i in range(80)]
    prior = np.full(10, 0.1)
    model = hmm.Hmm.seed(prior, 2)
    before = -1e18
    for _ in range(6):
        now = model.log10(docs).sum()
        assert now > before - 1e-6 or _ == 1
        before = now
        start, moves, cells = model.expected(docs)
        assert math.isclose(cells.sum(), 80 * 60, rel_tol=1e-3) and math.isclose(start.sum(), 80, rel_tol=1e-3)
        model = model.update(prior, start, moves, cells.T)


# 8


def test_ring(spark, tmp_path):
    rows = ROWS + [(7777, "same", "en", "s", 4)] * 40
    got = query(spark, tmp_path, registry.QUERIES["op8_sharding"], rows)
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"}
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_ring_placement_by_brute_force(spark):
    """Every key's shard and slot: keys go clockwise one by one, own arcs first, what a full shard can't take to the next ones with room."""
    import bisect

    from pyspark.sql import functions as F

    df = frame(spark, ROWS + [(7777, "same", "en", "s", 4)] * 30 + [(None, None, None, None, None)] * 2, CLASH)
    shards, vnodes = 5, 3
    got = ring.shard_rows(df, shards, vnodes).collect()
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = df.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("c")).withColumn("h", F.xxhash64("doc_id", "size", "c", F.lit(0))).collect()
    points = ring.ring(shards, vnodes)
    at = [p for p, _ in points]
    arcs = [[] for _ in points]
    for r in keys:
        arcs[bisect.bisect_left(at, r.h % (1 << 32)) % len(at)].append((r.h % (1 << 32), r.h, -1 if r.doc_id is None else r.doc_id, r.size, r.c))
    room = [len(keys) // shards + (x < len(keys) % shards) for x in range(shards)]
    slots, late = [[] for _ in range(shards)], []
    for (_, owner), arc in zip(points, arcs):
        late.append([])
        for key in sorted(arc):
            (slots[owner] if len(slots[owner]) < room[owner] else late[-1]).append(key)
    for i, rest in enumerate(late):
        for key in rest:
            j = i
            while True:
                j = (j + 1) % len(points)
                if len(slots[points[j][1]]) < room[points[j][1]]:
                    slots[points[j][1]].append(key)
                    break
    want = Counter((None if k[2] == -1 else k[2], k[3], k[4], x, n) for x, keys_ in enumerate(slots) for n, k in enumerate(keys_))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want


def test_ring_moves_little(spark):
    df = frame(spark, [(i, f"text {i}", "en", "s", None) for i in range(3000)], CLASH)
    a = {r.doc_id: r.shard for r in ring.shard_rows(df, 10).collect()}
    b = {r.doc_id: r.shard for r in ring.shard_rows(df, 11).collect()}
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.5  # a modulus would move ten of eleven


# 9


def test_pieces(spark, tmp_path):
    import sentencepiece

    rows = ROWS + [(900 + i, t, "en", "s", None) for i, t in enumerate(["  two  spaces ", "▁ mark ▁▁x", "tab\tand\nline", " ", " 　", "🙂🙂 é ß ﬁ"])]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op9_sentencepiece"], rows)}
    for i, t, *_ in rows:
        ids = model.encode(t or "")
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_each_chunk_is_segmented_once(spark):
    """Over several blocks, with repeated rows, null ids, clashing columns and a long text of long words."""
    rows = ROWS + [ROWS[3]] * 5 + [(None, "lone  row", "en", None, None), (77, ("x" * 90_000 + " ") * 30, "en", "s", 0)]
    docs = frame(spark, rows, CLASH + " block kept ends codes words ids chunk code")
    out = pieces.encode(docs, ["doc_id", "block", "ids"], full=False, block_bytes=20_000)
    assert out.columns == ["doc_id", "block", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(rows)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = Counter((i, hashlib.sha256(",".join(map(str, model.encode(t or ""))).encode()).hexdigest()) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.ids_sha256) for r in out.collect()) == want
    whole = {(r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode(docs.where("doc_id < 20"), ["doc_id"], full=True).collect()}
    assert whole == {(i, tuple(model.encode(t or "")), model.decode(model.encode(t or ""))) for i, t, *_ in rows if i is not None and i < 20}


def test_segments_are_counted(monkeypatch):
    import pyarrow as pa

    asked = []

    class Counting(pieces.Pieces):
        def segment(self, new):
            asked.extend(new)
            return super().segment(new)

    monkeypatch.setattr(pieces, "Pieces", Counting)
    words = [["the", "of", "", "water"][b:] + [f"own{b}"] for b in range(3)]
    blocks = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(words)], names=["block", "words"])
    entries = sorted((r for b in pieces.deal_entries(4)([blocks]) for r in b.to_pylist()), key=lambda r: r["bucket"])
    table = pa.Table.from_pylist(entries)

    class Raw:
        value = pieces.check_model(pieces.default_model())

    got = [r for b in pieces.segment_buckets(Raw)(table.to_batches(max_chunksize=2)) for r in b.to_pylist()]
    assert Counter((r["block"], c) for r in got for c in np.cumsum(pieces.spread(r["codes"])).tolist()) == Counter((b, c) for b, ws in zip((7, 8, 9), words) for c in range(len(ws)))
    assert Counter(asked) == Counter({w for ws in words for w in ws})


# 10


def test_mixing(spark, tmp_path):
    got = {r["doc_id"]: r for r in query(spark, tmp_path, registry.QUERIES["op10_mixing"], ROWS)}
    name = lambda x: "none" if x is None else x
    domain = lambda s: "web" if (p := zlib.crc32(s.encode()) % 10) < 5 else "books" if p < 8 else "reference"
    docs = {i: (domain(name(s)), name(la), name(s), len(words_of(t))) for i, t, la, s, _ in ROWS}
    tokens = Counter()
    for d, la, s, n in docs.values():
        tokens[d, la, s] += n

    def fill(budget, caps, weights):
        out, rest, left = {}, sorted(caps, key=lambda k: (caps[k] / weights(k), k)), budget
        while rest and caps[rest[0]] * sum(map(weights, rest)) <= left * weights(rest[0]):
            out[rest[0]] = caps[rest[0]]
            left -= caps[rest.pop(0)]
        total = sum(map(weights, rest))
        return out | {k: left * weights(k) // total for k in rest}

    cap = {k: n * mixing.EPOCHS for k, n in tokens.items() if n}

    def level(prefix):
        out = Counter()
        for k, c in cap.items():
            if k[: len(prefix)] == prefix:
                out[k[: len(prefix) + 1]] += c
        return out

    root = min(sum(tokens.values()) * mixing.SHARE[0] // mixing.SHARE[1], sum(cap.values()))
    budget = {}
    for d, b1 in fill(root, level(()), lambda k: mixing.DOMAINS.get(k[0], mixing.DEFAULT)).items():
        for la, b2 in fill(b1, level(d), lambda k: mixing.LANGS.get(k[1], mixing.DEFAULT)).items():
            budget |= fill(b2, level(la), lambda k: mixing.DEFAULT)
    want = {}
    for leaf, b in budget.items():
        epoch, rest = divmod(b, tokens[leaf])
        key = lambda i: hashlib.md5(f"{mixing.SEED}:{epoch}:{i}".encode()).hexdigest()  # noqa: B023, E731
        before = 0
        for i in sorted((i for i, x in docs.items() if x[:3] == leaf), key=key):
            if copies := epoch + (before < rest):
                want[i] = (b, copies)
            before += docs[i][3]
    assert {i: (r["leaf_budget"], r["copies"]) for i, r in got.items()} == want
    df = frame(spark, ROWS, "key bucket budget epoch mix_tokens mix__p_lang Mix_copies")
    out = mixing.mix_documents(df)
    assert set(df.columns) <= set(out.columns)
    assert {tuple(r) for r in out.select("mix_tokens", "mix__p_lang", "Mix_copies").distinct().collect()} == {("clash",) * 3}
    assert {r.doc_id: r["mix___copies"] for r in out.collect()} == {i: c for i, (_, c) in want.items()}


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 2500] + [(500 + i, t + " " + prose(random.Random(i), "en", 80) if t else t, la, s, None) for i, t, la, s, _ in secret_rows()]
    path = tmp_path / "sf"
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            if name == "secret scans":
                assert all(not base_spans(r.text) for r in docs.collect())
    order = [seen[n] for n, _ in corpus_pipeline.STAGES]
    assert all(b <= a for a, b in zip(order, order[1:])) and order[1] == order[2] and order[-1]
    got = corpus_pipeline.run(spark, str(path)).collect()
    assert {r["doc_id"] for r in got} == order[-1] and set(got[0].asDict()) >= {"doc_id", "n_tokens", "ids_sha256"}
