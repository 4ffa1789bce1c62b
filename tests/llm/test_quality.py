"""The quality stage's bands under copies, and its model at any number of n-grams."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import corpus, frame, prose, query

from lectern.llm import ngram, registry


def test_copies_leave_bands_alone(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, "fr", 60 + rng.randrange(60)), "fr", "s", 0) for i in range(40)]
    # One real text, off the median of its language, in more copies than there are other texts.
    copied = " ".join(rng.choice(["lumière", "rivière", "hiver", "maison"]) for _ in range(20)) + " " + prose(rng, "fr", 60)
    rows = clean + [(100 + i, copied, "fr", "s", 0) for i in range(60)]
    kept = {r.doc_id for r in ngram.keep_good(frame(spark, rows)).collect()}
    assert {i for i, *_ in clean} <= kept
    scored = ngram.score_documents(frame(spark, rows))
    assert {r.doc_id for r in scored.where("kept").collect()} == kept


def test_no_gram_is_dropped(spark, tmp_path, monkeypatch):
    rows = corpus(30)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    whole = query(spark, tmp_path / "a", registry.QUERIES["op1_quality"], rows)
    monkeypatch.setattr(ngram, "MAX_GRAMS", 50)  # fewer than any language has
    monkeypatch.setattr(ngram, "HELD", 100, raising=False)
    parts = query(spark, tmp_path / "b", registry.QUERIES["op1_quality"], rows)
    assert len({r["low"] for r in whole}) > 2  # several languages
    key = lambda r: r["doc_id"]
    assert sorted(parts, key=key) == sorted(whole, key=key)


def test_bytes_by_brute_force(spark):
    """The byte model against Kneser-Ney written down once more; words of one shape in other letters are told apart."""
    import math
    from collections import Counter

    rng = random.Random(6)
    texts = [prose(rng, "fr", 70) for _ in range(12)] + ["東京 大阪 " * 9, "x", ""]
    rows = [(i, t, "fr", "s", 0) for i, t in enumerate(texts)] + [(99, None, "fr", "s", 0)]
    counts = {6: Counter()}
    for t in texts:
        b = bytes(5) + t.encode()
        counts[6].update(b[i : i + 6] for i in range(len(b) - 5))
    for k in (5, 4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, by = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / max(1, n[1] + 2 * n[2])
        d[k] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))] if all(n[i] for i in (1, 2, 3, 4)) else [0, 0.5, 1, 1.5]
        for g, x in c.items():
            by.setdefault(g[:-1], []).append(x)

    def p(g):
        if not g:
            return 1 / 256
        xs, x, k = by[g[:-1]], counts[len(g)][g], len(g)
        return (x - d[k][min(x, 3)] + sum(d[k][min(y, 3)] for y in xs) * p(g[1:])) / sum(xs)

    got = {r.doc_id: r for r in ngram.score_documents(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        b = bytes(5) + t.encode()
        logp = sum(math.log10(p(b[j : j + 6])) for j in range(len(b) - 5))
        if t:
            assert math.isclose(got[i].byte_log10_ppl, -logp / (len(b) - 5), rel_tol=1e-5), i
    assert got[14].byte_log10_ppl is None and got[99].byte_log10_ppl is None


def test_words_of_one_class_are_told_apart(spark):
    """Letters that share one of the 64 classes: the class model gives both texts one perplexity, the byte model doesn't."""
    a = " ".join(["東東東東"] * 60 + [f"w{i}" for i in range(60)])
    rows = [(i, a, "zh", "s", 0) for i in range(9)] + [(10, a.replace("東", chr(ord("東") + 24)), "zh", "s", 0)]
    got = {r.doc_id: r for r in ngram.score_documents(frame(spark, rows)).collect()}
    assert got[0].log10_ppl == got[10].log10_ppl and got[10].byte_log10_ppl > got[0].byte_log10_ppl


def test_answers_carry_no_codes(spark):
    """Blocks find their n-grams' codes again: an answer has a probability of 4 bytes an n-gram at most, and every text its own score."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from lectern.llm import bytegrams

    rng = random.Random(13)
    langs = ["fr", "en", "fr", "de", "en", "xx"]
    texts = ["".join(rng.choices("abcdefghij klmnop", k=9000)) if x != "xx" else "" for x in langs]
    kept = pa.array([{"i": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([kept, pa.array(langs), pa.array(texts)], names=["kept", "lang", "text"])
    blocks = list(bytegrams.write_blocks([batch], lambda text, lang: pa.array([0] * len(text))))
    model, scores = {}, {}
    for parts in (1, 5):
        entries = [r for b in bytegrams.deal(parts)(blocks) for r in b.to_pylist()]
        entries.sort(key=lambda r: (r["part"], r["lang"]))
        rows = list(bytegrams.gather([pa.RecordBatch.from_pylist(entries)]))
        held = pa.Table.from_batches(rows)
        model = model or bytegrams.low_models(spark.createDataFrame(held.drop_columns([c for c in ("part",) if c in held.column_names])))
        answers = pa.Table.from_batches(list(bytegrams.answer(SimpleNamespace(value=model))(rows)))
        n = sum(len(bytegrams.codes_from(r["codes"])) for r in entries)
        assert sum(len(x) for r in answers.to_pylist() for x in r.values() if isinstance(x, bytes)) < 4 * n + 64 * len(answers)
        out = bytegrams.scored(False, parts)(pa.Table.from_batches(blocks), answers)
        scores[parts] = {r["kept"]["i"]: r["byte_logp"] for r in out.to_pylist()}
    assert len(scores[1]) == len(texts) and scores[1][0] < 0 == scores[1][5]
    assert np.allclose([scores[1][i] for i in range(6)], [scores[5][i] for i in range(6)], rtol=1e-6)


def test_tables_have_few_files(spark):
    """However many partitions shuffles have: rows a text stand in no more files than the scores they come from, rows a language in none."""
    from lectern.session import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = set(shared.iterdir()) if shared.exists() else set()
    try:
        for k, v in zip(held, ("60", "false")):
            spark.conf.set(k, v)
        assert ngram.score_documents(frame(spark, corpus(90)).repartition(3)).count() == len(corpus(90))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = {}
    for d in set(shared.iterdir()) - before:
        files.setdefault(d.name.rsplit("-", 1)[0], []).extend(d.rglob("part-*"))
    assert set(files) == {"byte-scores", "distinct-scores"}
    assert len(files["distinct-scores"]) <= len(files["byte-scores"]) < 10


def test_workers_forget_models(spark):
    """A worker lives on for stages that need no model: the end of a task's blocks drops those it has loaded."""
    import pyarrow as pa

    from lectern.llm import bytegrams

    texts = [prose(random.Random(i), "fr", 70) for i in range(3)]
    model = ngram.train(spark.createDataFrame([("fr", t) for t in texts], "lang string, text string"))
    kept = pa.array([{"i": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([kept, pa.array(["fr"] * len(texts)), pa.array(texts)], names=["kept", "lang", "text"])
    for _ in range(2):
        blocks = list(bytegrams.write_blocks([batch], ngram.scorer(model), ngram.forget_parts))
        assert blocks[0]["kept"][0].as_py()[0]["s"]["n_words"] == 70 and not ngram._loaded


def byte_run(spark, texts, langs, parts=1):
    """Entries and rows of scores of the byte model, without a Spark job but for the discounts."""
    from types import SimpleNamespace

    import pyarrow as pa

    from lectern.llm import bytegrams

    kept = pa.array([{"i": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([kept, pa.array(langs), pa.array(texts)], names=["kept", "lang", "text"])
    blocks = list(bytegrams.write_blocks([batch], lambda text, lang: pa.array([0] * len(text))))
    entries = sorted((r for b in bytegrams.deal(parts)(blocks) for r in b.to_pylist()), key=lambda r: (r["part"], r["lang"]))
    rows = list(bytegrams.gather([pa.RecordBatch.from_pylist(entries)]))
    model = bytegrams.low_models(spark.createDataFrame(pa.Table.from_batches(rows).drop_columns(["part"])))
    answers = pa.Table.from_batches(list(bytegrams.answer(SimpleNamespace(value=model))(rows)))
    out = bytegrams.scored(False, parts)(pa.Table.from_batches(blocks), answers).to_pylist()
    return entries, sorted(out, key=lambda r: r["kept"]["i"])


def test_codes_are_packed_by_context(spark):
    """A part's n-grams have few endings of contexts, so steps are small where these come first: parts cost hardly more bytes than the whole."""
    from lectern.llm import bytegrams

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 8))) for _ in range(400)) for _ in range(60)]
    size = {}
    for parts in (1, 16):
        entries, _ = byte_run(spark, texts, ["en"] * len(texts), parts)
        size[parts] = sum(len(r["codes"]) for r in entries)
        assert sum(len(bytegrams.codes_from(r["codes"])) for r in entries) == len({b[i : i + 6] for b in (bytes(5) + t.encode() for t in texts) for i in range(len(b) - 5)})
    assert size[16] < 1.25 * size[1]  # 1.53 in the order of the text


def test_long_texts_are_cut_without_a_trace(spark, monkeypatch):
    """A text longer than a step, in a word or between words, scores as in one piece."""
    import numpy as np

    from lectern.llm import bytegrams

    texts = ["", prose(random.Random(1), "en", 900), "x", "a" * 900 + " b", prose(random.Random(2), "en", 40), " \n ".join("déjà vu" for _ in range(300)), ""]
    langs = ["en", "en", "fr", "en", "fr", "fr", "de"]
    _, whole = byte_run(spark, texts, langs)
    for step in (7, 256, 1000):
        monkeypatch.setattr(bytegrams, "STEP", step)
        _, cut = byte_run(spark, texts, langs, 3)
        assert [(r["byte_symbols"], r["byte_even_symbols"]) for r in cut] == [(r["byte_symbols"], r["byte_even_symbols"]) for r in whole]
        for name in ("byte_logp", "byte_even_logp"):
            assert np.allclose([r[name] for r in cut], [r[name] for r in whole], rtol=1e-6, atol=1e-9)
