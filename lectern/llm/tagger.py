"""Operator 4: language identification with a linear-chain conditional random field.

Words of a text form a chain whose labels are languages.  A word's features are hashed: the word itself, its prefixes and
suffixes of 1 to 3 characters, its character 1- to 3-grams with boundary marks, and the lexicons it is in (the ``LEXICON`` most
frequent words of each language's sample; a word in none has a feature of its own).  Start weights and transitions between neighbouring labels
are learned too.  Forward-backward gives each word's posterior over labels, so code-switched text is labelled word by
word; a document's language is the label with the largest mean posterior over its words with letters, and that mean is the score.

Training is gradient ascent (AdaGrad, ``STEPS`` full passes) on the conditional log-likelihood of a bounded sample: at most ``SAMPLE``
labelled rows of each language, distinct texts, those with the lowest md5 of their doc_id.  The sample stays in the shared folder; every partition
runs forward-backward over the whole texts of its rows and emits its part of the exact gradient, summed by distinct feature; Spark adds the parts up, and
the driver holds one row of numbers for each hashed feature (2^``SPACE_BITS`` at most).  Every language with a labelled row is a label.  Chains
are ``CHAIN`` documents laid end to end, so that switches occur in training.

Prediction is one pass without a shuffle.  Emission scores are computed once for each distinct word of a batch with numpy,
and forward-backward runs over many texts in step.  Null texts and texts without a letter: ``und`` with score 0.  No labelled rows: ``und``.
Very long texts are whole chains; repeated rows give repeated results and count once in the sample; a null doc_id isn't
held out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents, materialize, share_code

SPACE_BITS, SAMPLE, LEXICON, CHAIN, PARTS = 18, 200, 2000, 3, 16
STEPS, RATE, DECAY = 6, 0.5, 1e-6
STEP_WORDS = 400_000
RESULT = "struct<lang_pred: string, score: double>"


def points_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of ``_word_`` for all words in a row, and each one's length."""
    low = [f"\x02{w.lower()}\x03" for w in words]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.fromiter(map(len, low), np.int64, len(low))


def _hash(x: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(kind * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def entry_of(word: str) -> str:
    """A word's form in lexicons: lower case, without what stands before its first and behind its last letter."""
    low = word.lower()
    if low.isalpha():
        return low
    letters = [i for i, c in enumerate(low) if c.isalpha()]
    return low[letters[0] : letters[-1] + 1] if letters else ""


def word_features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs of the words' affixes, n-grams and lexicon entries, ordered by kind."""
    x, size = points_of(words)
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(words)), size)
    place = np.arange(len(x)) - np.repeat(start, size)
    back = np.repeat(end, size) - 1 - np.arange(len(x))
    owners, feats = [owner], [_hash(x, 1)]
    gram = x
    with np.errstate(over="ignore"):
        for n in (2, 3):
            gram = gram[:-1] * np.uint64(1_000_003) + x[n - 1 :]
            fine = place[: len(gram)] + n <= np.repeat(size, size)[: len(gram)]
            owners.append(owner[: len(gram)][fine])
            feats.append(_hash(gram[fine], n))
        powers = np.uint64(1_000_003) ** np.arange(int(size.max(initial=1)), dtype=np.uint64)
        whole = np.add.reduceat(x * powers[place], start)
        owners.append(np.arange(len(words)))
        feats.append(_hash(whole, 4))
        for n in (1, 2, 3):  # affixes: the mark with its n neighbours
            for kind, inside in ((4 + n, place <= n), (7 + n, back <= n)):
                part = np.where(inside, x * powers[np.where(kind < 8, place, back) % len(powers)], np.uint64(0))
                owners.append(np.arange(len(words)))
                feats.append(_hash(np.add.reduceat(part, start), kind))
    listed = [lexicon.get(entry_of(w), (-1,)) for w in words]
    owners.append(np.repeat(np.arange(len(words)), np.fromiter(map(len, listed), np.int64, len(words))))
    feats.append(_hash(np.fromiter((j + 2 for js in listed for j in js), np.uint64), 11))
    return np.concatenate(owners), np.concatenate(feats)


def _steps(e: np.ndarray, lengths: np.ndarray, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of chains laid end to end, all in step, longest first; and the forward scales."""
    k = e.shape[1]
    order = np.argsort(-lengths, kind="stable")
    first, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty(len(e))
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    prev = np.zeros((0, k))
    for i, m in enumerate(live):
        at = first[:m] + i
        now = e[at] * (s if i == 0 else prev[:m] @ t)
        total = now.sum(axis=1)
        prev = now / total[:, None]
        alpha[at], scale[at] = prev, total
    nxt = np.ones((len(size), k))
    for i in range(len(live) - 1, -1, -1):
        m = live[i]
        at = first[:m] + i
        b = np.ones((m, k))
        if i + 1 < len(live) and (c := live[i + 1]):
            b[:c] = (nxt[:c] * e[at[:c] + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[at], nxt = b, b
    return alpha, beta, scale


def posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label posteriors at every word of chains laid end to end, by scaled forward-backward."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    alpha, beta, _ = _steps(e, lengths, np.exp(trans - trans.max()), np.exp(start - start.max()))
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


class Field:
    """Labels, hashed emission weights, transition and start weights, and lexicons (word to numbers of labels)."""

    def __init__(self, labels: list[str], lexicon: dict[str, tuple[int, ...]] | None = None):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon or {}
        self.weights = np.zeros((1 << SPACE_BITS, k))
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label: the sum of its features' weights over the root of their number."""
        owner, feat = word_features(words, self.lexicon)
        n = np.bincount(owner, minlength=len(words))
        out = np.stack([np.bincount(owner, self.weights[feat, k], len(words)) for k in range(self.weights.shape[1])], axis=1)
        return out / np.sqrt(n)[:, None]

    def gradient(self, chains: list[list[str]], gold: list[list[int]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Conditional log-likelihood of labelled chains and its exact gradient: used features, their rows, transitions, starts."""
        k = len(self.labels)
        ids: dict[str, int] = {}
        where = np.fromiter((ids.setdefault(w, len(ids)) for c in chains for w in c), np.int64)
        y = np.fromiter((j for ys in gold for j in ys), np.int64)
        lengths = np.fromiter(map(len, chains), np.int64, len(chains))
        owner, feat = word_features(list(ids), self.lexicon)
        norm = 1 / np.sqrt(np.bincount(owner, minlength=len(ids)))
        by_word = np.stack([np.bincount(owner, self.weights[feat, j], len(ids)) for j in range(k)], axis=1) * norm[:, None]
        scores = by_word[where]
        top = scores.max(axis=1, keepdims=True)
        e, t, s = np.exp(scores - top), np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())
        alpha, beta, scale = _steps(e, lengths, t, s)
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        first = np.cumsum(lengths) - lengths
        inner = np.ones(len(y), bool)
        inner[first + lengths - 1] = False
        i = np.flatnonzero(inner)
        ahead = e[i + 1] * beta[i + 1]
        z = ((alpha[i] @ t) * ahead).sum(axis=1, keepdims=True)
        pairs = t * ((alpha[i] / z).T @ ahead)  # expected transitions: forward message, weight, emission and backward message
        moves, begin = np.zeros((k, k)), np.bincount(y[first], minlength=k)
        np.add.at(moves, (y[i], y[i + 1]), 1)
        log_z = np.log(scale).sum() + top.sum() + len(i) * self.trans.max() + len(first) * self.start.max()
        value = scores[np.arange(len(y)), y].sum() + (moves * self.trans).sum() + (begin * self.start).sum() - log_z
        miss = np.eye(k)[y] - p
        g = np.stack([np.bincount(where, miss[:, j], len(ids)) for j in range(k)], axis=1) * norm[:, None]
        used, at = np.unique(feat, return_inverse=True)
        rows = np.stack([np.bincount(at, g[owner, j], len(used)) for j in range(k)], axis=1)
        return float(value), used, rows, moves - pairs, begin - p[first].sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            docs, n = [], 0
            while at < len(texts) and (not docs or n < STEP_WORDS):
                docs.append(lettered(texts[at] or ""))
                n += len(docs[-1])
                at += 1
            words = [w for d in docs for w in d]
            if not words or not self.labels:
                out += [("und", 0.0)] * len(docs)
                continue
            ids: dict[str, int] = {}
            where = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            lengths = np.fromiter(map(len, docs), np.int64, len(docs))
            p = posteriors(self.emissions(list(ids))[where], lengths[lengths > 0], self.trans, self.start)
            owner = np.repeat(np.arange(len(docs)), lengths)
            mean = np.stack([np.bincount(owner, p[:, j], len(docs)) for j in range(p.shape[1])], axis=1) / np.maximum(lengths, 1)[:, None]
            for row, m in zip(mean, lengths):
                j = int(row.argmax())
                out.append((self.labels[j], min(1.0, float(row[j]))) if m else ("und", 0.0))
        return out


def lettered(text: str) -> list[str]:
    """The words of a text that have a letter."""
    return [w for w in text.split() if w.isalpha() or any(map(str.isalpha, w))]


def chains_of(batches, labels: list[str]):
    """Chains of ``CHAIN`` documents, and their labels, from batches (lang, text); about ``STEP_WORDS`` words at once."""
    number = {x: i for i, x in enumerate(labels)}
    chains, gold, n = [], [], 0
    words, ys, docs = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own = lettered(text)
            words, ys, docs = words + own, ys + [number[lang]] * len(own), docs + 1
            if docs == CHAIN and words:
                chains.append(words)
                gold.append(ys)
                n += len(words)
                words, ys, docs = [], [], 0
                if n > STEP_WORDS:
                    yield chains, gold
                    chains, gold, n = [], [], 0
    if words:
        chains.append(words)
        gold.append(ys)
    if chains:
        yield chains, gold


def part_gradient(field):
    """Batches (lang, text) to rows (cell, g0, g1, ...): features from 0 on, -1 - i for transitions from i, -1 - labels for starts."""

    def run(batches):
        f = field.value
        k = len(f.labels)
        total = {}
        for chains, gold in chains_of(batches, f.labels):
            _, used, rows, moves, begin = f.gradient(chains, gold)
            cells = np.concatenate([used, -1 - np.arange(k + 1)])
            rows = np.concatenate([rows, moves, begin[None]])
            total = (cells, rows) if not total else (np.concatenate([total[0], cells]), np.concatenate([total[1], rows]))
        if total:
            cells, at = np.unique(total[0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), *(pa.array(np.bincount(at, total[1][:, j], len(cells))) for j in range(k))], names=["cell", *(f"g{j}" for j in range(k))])

    return run


def sample_of(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of at most ``sample`` distinct texts a language, with the lowest md5 of their doc_id; in the shared folder."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("rank"), F.xxhash64("text").alias("key"))
    # Rows are chosen without their texts; a window with a limit keeps ``sample`` rows of each partition at most.
    once = rows.groupBy("lang", "key").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("rank", "key"))
    picked = once.withColumn("place", place).where(F.col("place") <= sample).select(F.col("lang").alias("l"), F.col("key").alias("k"))
    # The chosen rows are bounded by ``sample`` a language.
    met = rows.join(F.broadcast(picked), (F.col("lang") == F.col("l")) & (F.col("key") == F.col("k")), "left_semi").dropDuplicates(["lang", "key"])
    return materialize(met.repartition(PARTS, "key").sortWithinPartitions("key").select("lang", "text"), "labelled")


def lexicons(chosen: DataFrame, labels: list[str]) -> dict[str, tuple[int, ...]]:
    """Word to the labels whose ``LEXICON`` most frequent words it is among."""

    def words(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = [e for w in lettered(text) if (e := entry_of(w))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string())], names=["lang", "word"])

    counts = chosen.mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= LEXICON)
    out: dict[str, tuple[int, ...]] = {}
    for r in top.select("lang", "word").orderBy("lang", "word").collect():  # at most LEXICON rows a language
        out[r.word] = (*out.get(r.word, ()), labels.index(r.lang))
    return out


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS, rate: float = RATE) -> Field:
    """Fit on rows (doc_id, text, lang) with a language; the sample is bounded by ``sample`` rows a language."""
    spark = docs.sparkSession
    share_code(spark)
    chosen = sample_of(docs, sample)
    labels = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    field = Field(labels, lexicons(chosen, labels))
    k = len(labels)
    if not k:
        return field
    schema = "cell int, " + ", ".join(f"g{j} double" for j in range(k))
    seen, seen_t, seen_s = np.full_like(field.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        held = spark.sparkContext.broadcast(field)
        got = chosen.mapInArrow(part_gradient(held), schema).groupBy("cell").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(k)]).toArrow()
        if not len(got):
            break
        cell, rows = got["cell"].to_numpy(), np.stack([got[f"g{j}"].to_numpy() for j in range(k)], axis=1)
        used = cell[cell >= 0]
        grad = rows[cell >= 0] - DECAY * field.weights[used]
        seen[used] += grad**2
        field.weights[used] += rate * grad / np.sqrt(seen[used])
        moves, begin = np.zeros((k, k)), np.zeros(k)
        moved = (cell < 0) & (cell >= -k)
        moves[-1 - cell[moved]] = rows[moved]
        begin += rows[cell == -1 - k].sum(axis=0)
        seen_t += moves**2
        seen_s += begin**2
        field.trans += rate * moves / np.sqrt(seen_t)
        field.start += rate * begin / np.sqrt(seen_s)
        held.destroy()
    discard(chosen)
    return field


def predict_column(text: Column, field: Field, spark: SparkSession) -> Column:
    share_code(spark)
    held = spark.sparkContext.broadcast(field)

    def run(text: pa.Array) -> pa.Array:
        rows = held.value.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(text)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    field = train(docs.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), predict_column(F.col("text"), field, spark).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
