"""Fixtures of the corpus operators: awkward rows, and runs of a query over a table of our own."""

from __future__ import annotations

import random

WORDS = {
    "en": "the of and to house river walking seldom brightness winter garden opened table morning".split(),
    "fr": "le la les des maison rivière marcher souvent lumière hiver jardin ouverte table matin".split(),
    "de": "der die das und haus fluss gehen selten helligkeit winter garten geöffnet tisch morgen".split(),
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS[lang]) + rng.choice(["", "", "", "s", "en", "ly", "e"])
        out.append(w.capitalize() + "" if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    """Prose in three languages with copies, near copies, shared passages, and awkward texts at the end."""
    rng = random.Random(seed)
    langs = list(WORDS)
    texts = [(prose(rng, langs[i % 3], rng.randrange(60, 160)), langs[i % 3]) for i in range(n)]
    passage = prose(rng, "en", 70)
    for i in range(0, n, 7):
        texts[i] = (texts[i][0] + "\n" + passage + "\n" + texts[i][0][:40], texts[i][1])
    texts += [texts[1], texts[1], (texts[2][0].replace(" ", "  ", 1), texts[2][1]), (texts[4][0].rsplit(" ", 1)[0], texts[4][1])]
    texts += [(None, "en"), ("", "fr"), (" \t\n", None), ("!!! 123 ###", "en"), ("x", None), ("a" * 700, "de"), ("word " * 3000, "en"), ("Ünïcode — 東京   \x1c mixed\x0bspace", "de"), ("ab" * 400 + " tail", "fr")]
    return [(i, t, la, f"src{i % 4}" if i % 11 else None, None if t is None else len(t)) for i, (t, la) in enumerate(texts)]


def frame(spark, rows, extra: str = ""):
    """The rows as documents; ``extra`` adds columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    for name in extra.split():
        df = df.withColumn(name, F.lit("clash"))
    return df


def query(spark, tmp_path, run, rows, table: str = "documents", schema: str = DOCS):
    """A registered query over a folder that holds ``rows`` as ``table``."""
    path = tmp_path / f"sf{random.randrange(1 << 60)}"
    spark.createDataFrame(rows, schema).write.parquet(str(path / f"{table}.parquet"))
    return [r.asDict() for r in run(spark, str(path)).collect()]


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]
