"""Operator 7: a hidden Markov language model trained by Baum-Welch over partitions.

Tokens are the lower-cased (A-Z) words of a text and one end.  Every word belongs to a class: a word that makes up one in ``OWN`` of all
training words or more (and has ``LONGEST`` bytes at most) is a class of its own (so there are ``OWN`` of them at most, and the same ones whatever the corpus's size);
all others share ``TAILS`` classes by the checksum of their last three bytes.  The model is

    P(text) = sum over state paths of  start * transitions * P(class | state)  times the product of P(word | class),

with P(word | class) = (c + a) / (n + a * (v + 1)) for a class of n training tokens and v training words: the words that
training doesn't know are one event of their class, as they are one event of the base's unigram model.

Work on the corpus, all of it over every row:

1. words of the training texts are counted by partition and summed (the table grows with the corpus and is never collected);
2. the most frequent words, with their counts, go to the workers (``VOCAB`` at most; the others' counts come by a join, with the same results);
   each text becomes a sequence of class numbers and a list of its other words with their numbers; both are written to the shared folder;
3. Baum-Welch: in each of ``PASSES`` passes workers run scaled forward-backward over every whole training sequence and emit
   expected counts by class and transition; Spark adds them up and the driver re-estimates (``OWN + TAILS`` rows of ``STATES``
   numbers at most).  A sequence longer than ``LONG`` is worked on in pieces side by side, with the messages at their borders
   carried over by the pieces' transfer matrices, so it counts as the one sequence that it is;
4. scaled forward recursion over whole sequences gives the exact likelihood of the class sequence (long ones by transfer matrices likewise);
5. the other words meet the count table in a join on the word and are summed by row.

Null and empty texts are a lone end.  A null doc_id isn't held out.  Rows are told apart by a row number, so repeated
rows and doc_ids give a row each.  No training rows: counts are zero, the base is the uniform of one event, and the model says the
same as an untrained one.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialize, share_code, slices

STATES, VOCAB, OWN, TAILS, ALPHA = 8, 200_000, 48_000, 4_096, 0.1
PASSES, LONGEST, FLUSH, PRIOR = 4, 64, 200_000, 50.0
STEP_TOKENS, LONG, PIECE = 1_000_000, 2048, 256
END = b""


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


def count_words(batches):
    """(word, n) of batches with a text column; flushed at ``FLUSH`` distinct words."""
    held: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in (part for whole in batches for part in slices(whole, "text")):
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            if text:
                held.update(text.lower().split())
                if len(held) > FLUSH:
                    yield flush()
    yield flush()


class Lexicon:
    """Frequent words with their counts and classes, and the totals of all classes."""

    def __init__(self, words: list[bytes], n: np.ndarray, ends: int, tokens: int, distinct: int, tails: dict[int, tuple[int, int]]):
        """words: by falling count; ends: training rows; tokens, distinct: of all training words; tails: class to (tokens, words), own words included."""
        own = int(np.searchsorted(-n * OWN, -tokens, side="right"))  # words with n / tokens >= 1 / OWN
        self.words, self.own, self.tails = [END, *words], OWN, TAILS  # workers know these by the lexicon
        n = np.concatenate(([ends], n)).astype(np.float64)
        self.tokens = tokens + ends
        base_den = self.tokens + ALPHA * (distinct + (ends > 0) + 1)
        self.log_den = float(np.log10(base_den))
        self.base = np.log10(n + ALPHA) - self.log_den
        self.known = n > 0
        tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
        for c, (t, v) in tails.items():
            tail_n[c], tail_v[c] = t, v
        tail = np.array([tail_class(w, TAILS) for w in words], np.int64) if words else np.zeros(0, np.int64)
        np.subtract.at(tail_n, tail[:own], n[1 : own + 1])
        np.subtract.at(tail_v, tail[:own], 1)
        self.classes = 1 + OWN + TAILS
        self.class_of = np.concatenate(([0], np.arange(1, own + 1), 1 + OWN + tail[own:])).astype(np.uint16)
        self.tail_den = np.log10(tail_n + ALPHA * (tail_v + 1))
        self.within = np.zeros(len(n))
        self.within[own + 1 :] = np.log10(n[own + 1 :] + ALPHA) - self.tail_den[tail[own:]]
        prior = np.zeros(self.classes)  # unused classes of own words stay at zero
        prior[: own + 1] = n[: own + 1] + ALPHA
        prior[1 + OWN :] = tail_n + ALPHA * (tail_v + 1)
        self.prior = prior / prior.sum()


class Table(dict):
    """Word to its place in the lexicon; other words give -1 less their tail class."""

    tails = TAILS

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_class(word, self.tails)


_tables: list[tuple[int, Table]] = []


def encode(version: int, lexicon: Lexicon):
    """Batches (doc_id, held_out, text) to rows with sums over the lexicon's words, class numbers and other words."""

    def run(batches):
        if not _tables or _tables[0][0] != version:
            _tables[:] = [(version, Table(zip(lexicon.words, range(len(lexicon.words)))))]
            _tables[0][1].tails = lexicon.tails
        find = _tables[0][1].__getitem__
        for batch in (part for whole in batches for part in slices(whole, "text")):
            docs = [(t or b"").lower().split() + [END] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            size = np.fromiter(map(len, docs), np.int64, len(docs))
            at = np.fromiter((i for d in docs for i in map(find, d)), np.int32, int(size.sum()))
            first, known = np.cumsum(size) - size, at >= 0
            place, tail = np.where(known, at, 0), np.where(known, 0, -1 - at)
            ids = np.where(known, lexicon.class_of[place], 1 + lexicon.own + tail).astype(np.uint16)
            base = np.add.reduceat(np.where(known, lexicon.base[place], -lexicon.log_den), first)
            within = np.add.reduceat(np.where(known, lexicon.within[place], -lexicon.tail_den[tail]), first)
            n_known = np.add.reduceat((known & lexicon.known[place]).astype(np.int64), first)
            rare, rare_n = [], []
            strange = np.add.reduceat((~known).astype(np.int64), first)
            for d, doc in enumerate(docs):
                c = Counter(doc[i] for i in np.flatnonzero(~known[first[d] : first[d] + size[d]]).tolist()) if strange[d] else {}
                rare.append(list(c))
                rare_n.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(n_known), pa.array(base), pa.array(within), pa.array([ids[a : a + n].tobytes() for a, n in zip(first, size)], pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "within_sum", "ids", "rare", "rare_n"],
            )

    return run


class Hmm:
    """start (states), trans (states x states), emit (classes and a padding class x states)."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans = start, trans
        self.emit = np.concatenate([emit, np.ones((1, emit.shape[1]))])

    @classmethod
    def seed(cls, prior: np.ndarray, states: int) -> Hmm:
        """The unigram model with a fixed noise for each state, and states that tend to stay."""
        emit = prior[:, None] * np.random.default_rng(11).gamma(2.0, 0.5, (len(prior), states))
        even = np.full(states, 1 / states)
        return cls(even, 0.8 * np.eye(states) + 0.2 / states, emit / np.maximum(emit.sum(axis=0), 1e-300))

    def update(self, prior: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> Hmm:
        """The model of expected counts, with a Dirichlet prior of ``PRIOR`` unigram tokens for each state."""
        k = len(start)
        e = emit + PRIOR * prior[:, None]
        t = trans + 1.0 / k
        return Hmm((start + 1 / k) / (start + 1 / k).sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=0))

    def expected(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected start, transition and emission counts of whole sequences."""
        k, pad = len(self.start), len(self.emit) - 1
        self._emit32, self._trans32 = self.emit.astype(np.float32), self.trans.astype(np.float32)
        sums = np.zeros(k), np.zeros((k, k)), np.zeros((k, pad + 1))
        begin, ones = self.start.astype(np.float32), np.ones(k, np.float32)
        short = [d for d in docs if 0 < len(d) <= LONG]
        before, inner, behind = [np.tile(begin, (len(short), 1))], [np.zeros(len(short), bool)], [np.tile(ones, (len(short), 1))]
        long = [[d[lo : lo + PIECE] for lo in range(0, len(d), PIECE)] for d in docs if len(d) > LONG]
        if long:
            x, y = self._borders(long)
            before.append(x)
            behind.append(y)
            inner += [np.arange(len(pieces)) > 0 for pieces in long]
        seqs = short + [p for pieces in long for p in pieces]
        if seqs:
            self._sweep(seqs, np.concatenate(before), np.concatenate(inner), np.concatenate(behind), sums)
        start, moves, cells = sums
        return start, moves, cells[:, :pad]

    def _sweep(self, seqs: list[np.ndarray], before: np.ndarray, inner: np.ndarray, behind: np.ndarray, sums) -> None:
        """Add the expected counts of sequences, all in step.

        before: start weights, or (inner) the forward message of the token before; behind: the backward message at the last token, up to scale.
        """
        start, moves, cells = sums
        emit, trans = self._emit32, self._trans32
        ones = np.ones(emit.shape[1], np.float32)
        size = np.fromiter(map(len, seqs), np.int64, len(seqs))
        order = np.argsort(-size, kind="stable")
        size, inner, before, behind = size[order], inner[order], before[order], behind[order]
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # sequences that have a token t
        first = np.cumsum(live) - live
        flat = np.concatenate([seqs[i] for i in order])
        rank, place = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.empty(len(flat), np.int64)
        ids[first[place] + rank] = flat  # token by token, so each step reads one stretch
        e = emit[ids]
        alpha, scale = np.empty_like(e), np.empty((len(e), 1), np.float32)
        a = np.where(inner[:, None], before @ trans, before)
        for t, (lo, m) in enumerate(zip(first.tolist(), live.tolist())):
            a = (a if t == 0 else a[:m] @ trans) * e[lo : lo + m]
            s = scale[lo : lo + m]
            s[:, 0] = a @ ones
            a /= s
            alpha[lo : lo + m] = a
        ends = first[size - 1] + np.arange(len(size))
        last = behind / (alpha[ends] * behind).sum(axis=1, keepdims=True)
        b = last[: live[-1]]
        for t in range(len(live) - 1, -1, -1):
            lo, m = int(first[t]), int(live[t])
            if len(b) < m:  # sequences that end here
                b = np.concatenate((b, last[len(b) : m]))
            g = e[lo : lo + m] * b / scale[lo : lo + m]
            if t:
                was = int(first[t - 1])
                moves += self.trans * (alpha[was : was + m].T @ g)
                b_next = g @ trans.T
            else:
                moves += self.trans * ((before * inner[:, None]).T @ g)
            alpha[lo : lo + m] *= b  # from here on the posterior
            b = b_next if t else b
        start += alpha[: len(size)][~inner].sum(axis=0)
        gamma = alpha.T
        for j in range(len(gamma)):
            cells[j] += np.bincount(ids, gamma[j], cells.shape[1])

    def _borders(self, docs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The messages at the borders of sequences' pieces, from the pieces' transfer matrices: what ``_sweep`` takes for all of them."""
        k = len(self.start)
        pieces = [p for d in docs for p in d]
        head = np.concatenate([np.arange(len(d)) == 0 for d in docs])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        ids = np.zeros((int(size.max()), len(pieces)), np.int64)
        for i, at in enumerate(order):
            ids[: size[at], i] = pieces[at]
        live = np.searchsorted(-size[order], -np.arange(len(ids)), side="left")
        # A head's matrix starts behind the start weights, the others' with a transition.
        m = np.where(head[order][:, None, None], np.eye(k), self.trans) * self.emit[ids[0]][:, None, :]
        for t in range(1, len(ids)):
            n = live[t]
            now = (m[:n].reshape(-1, k) @ self.trans).reshape(n, k, k)
            now *= self.emit[ids[t, :n]][:, None, :]
            m[:n] = now / now.sum(axis=(1, 2), keepdims=True) if t % 8 == 7 else now
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        m = m[back] / m[back].sum(axis=(1, 2), keepdims=True)
        before, behind = np.empty((len(pieces), k)), np.ones((len(pieces), k))
        at = 0
        for d in docs:
            before[at] = v = self.start
            for i in range(at + 1, at + len(d)):
                v = v @ m[i - 1]
                before[i] = v = v / v.sum()
            for i in range(at + len(d) - 2, at - 1, -1):
                w = m[i + 1] @ behind[i + 1]
                behind[i] = w / w.sum()
            at += len(d)
        return before.astype(np.float32), behind.astype(np.float32)

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each (non-empty) sequence by the scaled forward recursion."""
        out = np.zeros(len(docs))
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        for i in np.flatnonzero(size > LONG):
            out[i] = self._long(docs[i])
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(-size[short], kind="stable")]
        if not len(short):
            return out
        flat = np.concatenate([docs[i] for i in short])
        n = size[short]
        first, total = np.cumsum(n) - n, np.zeros(len(short))
        ones = np.ones(len(self.start))
        alive = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        a = np.zeros((0, len(ones)))
        for t, m in enumerate(alive.tolist()):
            a = (self.start if t == 0 else a[:m] @ self.trans) * self.emit[flat[first[:m] + t]]
            s = a @ ones
            total[:m] += np.log10(s)
            a /= s[:, None]
        out[short] = total
        return out

    def _long(self, ids: np.ndarray, width: int = 256) -> float:
        k = len(self.start)
        v = self.start * self.emit[ids[0]]
        total, v = np.log10(v.sum()), v / v.sum()
        pieces = -(-(len(ids) - 1) // width)
        rest = np.full(pieces * width, len(self.emit) - 1, np.int64)
        rest[: len(ids) - 1] = ids[1:]
        rest = rest.reshape(pieces, width)
        m, logs = np.broadcast_to(np.eye(k), (pieces, k, k)).copy(), np.zeros(pieces)
        for t in range(width):
            m = (m.reshape(-1, k) @ self.trans).reshape(pieces, k, k) * self.emit[rest[:, t]][:, None, :]
            s = m.sum(axis=(1, 2))
            logs += np.log10(s)
            m /= s[:, None, None]
        for x, y in zip(m, logs):  # padding is at the end, where it keeps the sum of a row
            v = v @ x
            total, v = total + np.log10(v.sum()) + y, v / v.sum()
        return float(total)


def expect(model: Hmm):
    """Batches with ids to rows (cell, c0, c1, ...): classes from 0 on, -1 - i for transitions of state i, -1 - states for starts."""

    def run(batches):
        k = len(model.start)
        sums = None
        for docs in grouped(batches):
            got = model.expected(docs)
            sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
        if sums is None:
            return
        start, moves, cells = sums
        used = np.flatnonzero(cells.any(axis=0))
        cell = np.concatenate([used, -1 - np.arange(k + 1)]).astype(np.int32)
        rows = np.concatenate([cells[:, used].T, moves, start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(rows[:, j]) for j in range(k))], names=["cell", *(f"c{j}" for j in range(k))])

    return run


def grouped(batches):
    """Lists of sequences with about ``STEP_TOKENS`` tokens."""
    docs, n = [], 0
    for batch in (part for whole in batches for part in slices(whole, "ids")):
        for raw in batch.column("ids").to_pylist():
            docs.append(np.frombuffer(raw, np.uint16))
            n += len(docs[-1])
            if n > STEP_TOKENS:
                yield docs
                docs, n = [], 0
    if docs:
        yield docs


def train(sequences: DataFrame, prior: np.ndarray, states: int = STATES, passes: int = PASSES) -> Hmm:
    """Baum-Welch over all rows (ids), ``passes`` times."""
    model = Hmm.seed(prior, states)
    schema = "cell int, " + ", ".join(f"c{j} double" for j in range(states))
    for _ in range(passes):
        counts = sequences.select("ids").mapInArrow(expect(model), schema).groupBy("cell").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(states)])
        got = counts.toArrow()  # at most one row a class, state and start
        if not len(got):
            break
        cell, rows = got["cell"].to_numpy(), np.stack([got[f"c{j}"].to_numpy() for j in range(states)], axis=1)
        emit, moves = np.zeros((len(prior), states)), np.zeros((states, states))
        emit[cell[cell >= 0]] = rows[cell >= 0]
        moved = (cell < 0) & (cell >= -states)
        moves[-1 - cell[moved]] = rows[moved]
        model = model.update(prior, rows[cell == -1 - states].sum(axis=0), moves, emit)
    return model


def build_lexicon(counts: DataFrame, ends: int) -> tuple[Lexicon, Column]:
    """The lexicon of (word, n), and the condition on (word, n) of being in it."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    cut, kept = 0, 0
    for r in counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        kept += r.words
        if kept > VOCAB:  # a bound: more words than this are never collected
            cut = r.n
            break
    inside = (F.col("n") > cut) & (F.octet_length("word") <= LONGEST)
    got = counts.where(inside).toArrow()
    order = sorted(zip((-got["n"].to_numpy()).tolist(), got["word"].to_pylist()))
    tail = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")) % TAILS
    tails = {r.tail: (r.n, r.v) for r in counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # TAILS rows at most
    return Lexicon([w for _, w in order], np.array([-n for n, _ in order], np.int64), ends, total.n, total.v, tails), inside


def score(model: Hmm):
    """Batches with ids to their rows with ``class_lp`` for ids."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "ids")):
            docs = [np.frombuffer(raw, np.uint16) for raw in batch.column("ids").to_pylist()]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(model.log10(docs), pa.float64())], names=[*names, "class_lp"])

    return run


def score_documents(docs: DataFrame, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    share_code(spark)
    docs = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    learned = docs.where("not held_out")
    counts = materialize(learned.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    lexicon, inside = build_lexicon(counts, learned.count())
    held = spark.sparkContext.broadcast(lexicon)
    run = lambda batches, v=int(np.random.default_rng().integers(1 << 62)): encode(v, held.value)(batches)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_sum double, within_sum double, ids binary, rare array<binary>, rare_n array<long>")
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "sequences")
    model = train(rows.where("not held_out").select("ids"), lexicon.prior, states)
    others = rows.where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip(F.col("rare").alias("w"), F.col("rare_n").alias("m"))).alias("x")).select("key", F.col("x.w").alias("w"), F.col("x.m").alias("m"))
    met = others.join(counts.where(~inside), F.col("w") == F.col("word"), "left")
    c = F.coalesce("n", F.lit(0))
    rare = met.groupBy("key").agg(F.sum(F.col("m") * F.log10(c + ALPHA)).alias("rare_lp"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("rare_known")).withColumnRenamed("key", "k")
    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "within_sum"]
    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_sum double, within_sum double, class_lp double"
    scored = rows.select(*names, "ids").mapInArrow(score(model), schema).join(rare, F.col("key") == F.col("k"), "left")
    more = F.coalesce("rare_lp", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + more).alias("base_score"), (F.col("class_lp") + F.col("within_sum") + more).alias("score"),
    )


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihood of every document."""
    return score_documents(documents(spark, sf_dir))
