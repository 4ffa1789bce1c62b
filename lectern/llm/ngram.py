"""Operator 1: quality rules with N-gram perplexity bands.

The language model works on the symbols of whole texts: letters, digits and classes of other characters, 64 in all, with one
boundary symbol for each stretch of white space.  Each symbol is predicted from the ``ORDER - 1`` before it, across words.
(Word n-grams don't fit the disk limit: their distinct trigrams alone are larger than the input, see the README.)
Spark counts the highest-order n-grams of every language over all texts (each partition adds up its own first) and derives from them the
continuation counts of the lower orders.  Probabilities are interpolated modified Kneser-Ney with the three discounts of each order and
language taken from the counts of counts of all n-grams.

The model is stored as sorted hash arrays: the 64-bit mix of (language, order, n-gram) in one sorted array, with log
probability and log back-off weight beside it; look-up is a binary search, backing off while an n-gram is missing.
All n-grams and all languages are kept.  The model is collected and broadcast in parts of whole languages, of ``MAX_GRAMS`` n-grams of the
highest order or one language each (64^4 at the very most), so that neither the driver nor a worker holds all at once: a worker loads the parts
that its texts need and drops those used least recently beyond ``HELD`` slots.  Languages are independent of each other, so the parts
change no score.

A document's perplexity is taken over the symbols of its text.  For each language the median and the median absolute
deviation of log10 perplexity over the distinct texts that pass the base rules give a lower and an upper band ``WIDTH`` robust deviations away;
documents outside are rejected.  Copies count once, and the deviation is at least that which texts have within themselves: half the
difference between their even and odd words, averaged over the language's texts.  Bands are statistics of all texts, counted by cells
of 1 / ``GRID``, so every run gives the same ones; at this width they leave ordinary prose alone.

Classes of symbols say little about words, so a second model judges the bytes of whole texts as they are (``bytegrams``: order 6, all n-grams, no
classes), with bands of its own made in the same way.  A document is kept if it lies within both.

Base rules and counts: see ``FEATURES``.  Null and empty texts have no words and fail the base rules.  A null language is
the language ``und``.  Very long texts are handled whole (some 20 bytes a character), repeated rows alike, empty tables give empty results,
extra columns are kept by ``keep_good`` and ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bytegrams import byte_scores
from lectern.llm.common import discard, documents, materialize, no_wider, share_code

ORDER, BITS = 4, 6
MAX_GRAMS, WIDTH, GRID = 1_500_000, 8.0, 1 << 14
#: Characters handled at once, n-grams that a partition adds up before it passes them on, languages whose bands are broadcast.
STEP, FLUSH, FEW = 2_000_000, 2_000_000, 4096
HELD = 4_000_000  # a part of MAX_GRAMS has about this many slots with its lower orders and contexts
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCORED = f"struct<{FEATURES}, base_failed boolean, n_symbols_scored long, logp double, even_symbols long, even_logp double>".replace(" long", ": bigint").replace(" boolean", ": boolean").replace(" double", ": double")

#: Symbol of each code point below 0x3000: 0 boundary, 1-26 letters, 27 digit, 28 sentence marks, 29 other ASCII, 30 quote or hyphen, 31-54 hashed letters beyond ASCII, 55-62 the marks of SYMBOLS, 63 other.
_SYMBOL = np.full(0x3000, 63, np.uint8)
for _c in range(0x3000):
    _x = chr(_c)
    if _c < 128:
        _SYMBOL[_c] = ord(_x.lower()) - 96 if _x.isalpha() else 27 if _x.isdigit() else 28 if _x in ".,;:!?" else 55 + SYMBOLS.index(_x) if _x in SYMBOLS else 30 if _x in "'\"-()" else 29
    elif _x.isalpha():
        _SYMBOL[_c] = 31 + ord(_x.lower()[0]) % 24
for _x in SPACE:
    _SYMBOL[ord(_x)] = 0


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the highest order at every symbol of the texts, how many each text has, and whether they belong to an odd word.

    A run of one mark counts once: its length says nothing, and would make littered text look predictable.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    s = np.where(points < 0x3000, _SYMBOL[np.minimum(points, 0x2FFF)], (31 + points % 24).astype(np.uint8))
    keep = np.ones(len(s), bool)
    keep[1:] = (points[1:] != points[:-1]) | (s[1:] < 28) & (s[1:] > 0) | ((s[1:] > 30) & (s[1:] < 55))
    keep[1:] &= (s[1:] > 0) | (s[:-1] > 0)
    begin = (np.cumsum(lengths) - lengths)[lengths > 0]
    keep[begin] = s[begin] > 0  # a text starts at a boundary anyway
    size = np.add.reduceat(keep, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    whole = np.zeros(len(texts), np.int64)
    whole[lengths > 0] = size
    s = s[keep]
    first = (np.cumsum(whole) - whole)[whole > 0]
    stop = np.cumsum(whole)[whole > 0]
    code = s.astype(np.int32)
    for back in range(1, ORDER):
        prior = np.zeros(len(s), np.int32)
        prior[back:] = s[:-back]
        for j in range(back):  # boundary symbols pad the start of a text
            at = first + j
            prior[at[at < stop]] = 0
        code |= prior << BITS * back
    odd = np.cumsum(s == 0, dtype=np.int64)
    if len(first):
        odd -= np.repeat(odd[first], stop - first)
    return code, whole, odd % 2 == 1


def features(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text with these words."""
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    marks = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if n >= 3:
        ids: dict[str, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        pair = w[:-1] * len(ids) + w[1:]
        if len(ids) > 1 << 20:  # keeps the next product within 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(ids) + w[2:]
        ordered = np.sort(window)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            hit = np.isin(window, twice)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeated = int(cover.sum())
    return n, chars, marks, len(lines) - len(set(lines)), repeated


def words_of(text: str) -> list[str]:
    """Words by ASCII white space only; ``str.split`` would cut at Unicode spaces too."""
    return text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode("utf-8", "surrogatepass").split()]


def steps(items: list[str]):
    """(from, to) of stretches of about ``STEP`` characters, one text at least."""
    at = 0
    while at < len(items):
        to, n = at, 0
        while to < len(items) and (to == at or n + len(items[to]) <= STEP):
            n += len(items[to])
            to += 1
        yield at, to
        at = to


def counted(codes: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their numbers."""
    at, found = pd.factorize(codes)
    return found, np.bincount(at, weight, len(found)).astype(np.int64)


def count_grams(batches):
    """Counts of highest-order n-grams by language of (lang, text) batches, added up until a language has ``FLUSH`` of them."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows(lang):
        codes, n = counted(*(np.concatenate(x) for x in zip(*held.pop(lang))))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for lo, hi in steps(texts):
                held.setdefault(lang, []).append(counted(symbols_of(texts[lo:hi])[0]))
            if sum(len(c) for c, _ in held[lang]) > FLUSH:
                yield rows(lang)
    for lang in list(held):
        yield rows(lang)


def mix(lang: np.ndarray | int, order: int, code: np.ndarray) -> np.ndarray:
    """The 64-bit hash of an n-gram (splitmix; one to one on its input, so no two n-grams share a slot)."""
    with np.errstate(over="ignore"):
        x = np.asarray(code, np.uint64) | np.uint64(order << 56) | np.asarray(lang, np.uint64) << np.uint64(40)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(mul)
        return x ^ x >> np.uint64(31)


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of counts ``n``; where counts of counts are missing, the usual half, one and one and a half."""
    n1, n2, n3, n4 = (int((n == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class Model:
    """Sorted hash arrays of the n-grams of all languages."""

    def __init__(self, langs: list[str], counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
        """counts: (language's number, order) to sorted codes and counts (continuation counts below the highest order)."""
        self.langs = {x: i for i, x in enumerate(langs)}
        keys, logp, logb = [], [], []
        for lang in range(len(langs)):
            lower_codes, lower = np.arange(1 << BITS), np.full(1 << BITS, 1 / (1 << BITS))
            tables = []
            for order in range(1, ORDER + 1):
                codes, n = counts.get((lang, order), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                d = discounts(n)[np.minimum(n, 3)]
                ctx, at = np.unique(codes >> BITS, return_inverse=True)
                total = np.bincount(at, n, len(ctx))
                gamma = np.bincount(at, d, len(ctx)) / total
                base = lower[np.searchsorted(lower_codes, codes & (1 << BITS * max(1, order - 1)) - 1)] if len(codes) else np.zeros(0)
                p = (n - d) / total[at] + gamma[at] * base
                tables.append((codes, p, ctx, gamma))
                lower_codes, lower = codes, p
            for order, (codes, p, ctx, gamma) in enumerate(tables, 1):
                keys += [mix(lang, order, codes), mix(lang, 8 + order, ctx)]  # 8 + order: a context's back-off weight
                logp += [np.log10(p), np.log10(np.maximum(gamma, 1e-300))]
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(every)
        self.keys, self.values = every[order], np.concatenate(logp)[order].astype(np.float32) if keys else np.zeros(0, np.float32)

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return self.keys[at] == hashes, self.values[at]

    def score(self, lang: str, code: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last symbol given the others; a language without a model uses the first."""
        number = self.langs.get(lang, 0)
        out, todo = np.zeros(len(code)), np.arange(len(code))
        if not len(self.keys):
            return out - np.log10(1 << BITS)
        for order in range(ORDER, 0, -1):
            part = code[todo] & (1 << BITS * order) - 1
            found, value = self.get(mix(number, order, part))
            out[todo[found]] += value[found]
            todo, part = todo[~found], part[~found]
            if not len(todo):
                return out
            known, weight = self.get(mix(number, 8 + order, part >> BITS))
            out[todo[known]] += weight[known]
        out[todo] -= np.log10(1 << BITS)
        return out

    def text_scores(self, lang: str, texts: list[str]) -> list[tuple[int, float, int, float]]:
        """Symbols and log10 probability of each text, and the same of its even words."""
        code, size, odd = symbols_of(texts)
        at, found = pd.factorize(code)
        value = self.score(lang, found.astype(np.int64))[at]
        some = size > 0
        first = (np.cumsum(size) - size)[some]

        def cut(x: np.ndarray) -> list:
            """Sums by text, which no other text of the batch can change."""
            out = np.zeros(len(size), x.dtype)
            if len(first):
                out[some] = np.add.reduceat(x, first)
            return out.tolist()

        return list(zip(size.tolist(), cut(value), cut((~odd).astype(np.int64)), cut(np.where(odd, 0, value))))


class Parts:
    """Models of some languages each, broadcast one by one."""

    def __init__(self, held: list, langs: list[list[str]]):
        self.held, self.where = held, {x: i for i, part in enumerate(langs) for x in part}
        self.version = held[0]._jbroadcast.id()

    def of(self, lang: str) -> int:
        """The part that scores ``lang``; languages without a model take the first."""
        return self.where.get(lang, 0)


def collect_counts(top: DataFrame, langs: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The counts that ``Model`` takes, of ``top`` (lang, code, n) in these languages."""
    levels, code = [top.select("lang", F.lit(ORDER).alias("order"), "code", "n")], top
    for order in range(ORDER - 1, 0, -1):
        code = code.groupBy("lang", F.col("code").bitwiseAND((1 << BITS * order) - 1).alias("code")).agg(F.count("*").alias("n"))
        levels.append(code.select("lang", F.lit(order).alias("order"), "code", "n"))
    out: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for level in levels:
        got = level.withColumn("lang", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1).toArrow()  # one part: see the module's docstring
        lang, order, codes, n = (got[c].to_numpy() for c in ("lang", "order", "code", "n"))
        for i in range(len(langs)):
            mine = np.flatnonzero(lang == i)
            if len(mine):
                by = mine[np.argsort(codes[mine])]
                out[i, int(order[by[0]])] = codes[by].astype(np.int64), n[by].astype(np.int64)
    return out


def train(docs: DataFrame) -> Parts:
    """Count all texts of ``docs`` (lang, text) with Spark and build the model."""
    spark = docs.sparkSession
    share_code(spark)
    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    top = rows.select("lang", "text").mapInArrow(count_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = materialize(no_wider(top, rows), "grams")
    named = {r.lang: r.grams for r in top.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("grams")).orderBy(F.desc("n"), "lang").collect()}  # a row a language
    parts: list[list[str]] = [[]]
    for lang, grams in named.items():
        if parts[-1] and sum(named[x] for x in parts[-1]) + grams > MAX_GRAMS:
            parts.append([])
        parts[-1].append(lang)
    held = []
    for langs in parts:
        mine = top.where(F.col("lang").isin(langs)) if len(parts) > 1 else top
        held.append(spark.sparkContext.broadcast(Model(langs, collect_counts(mine, langs) if langs else {})))
    discard(top)
    return Parts(held, parts)


#: The parts that a worker has loaded, by version and number, least recently used first.
_loaded: dict[tuple[int, int], object] = {}


def load_part(held: list, version: int, number: int, most: int) -> Model:
    """A part's model; beyond ``most`` slots the others are dropped, least recently used first, and those of other versions always."""
    _loaded.pop((version, number), None)
    model = held[number].value
    size = sum(len(b.value.keys) for k, b in _loaded.items() if k[0] == version) + len(model.keys)
    for k in list(_loaded):
        if k[0] != version or size > most:
            old = _loaded.pop(k)
            size -= len(old.value.keys) if k[0] == version else 0
            del old._value  # the broadcast's file stays
    _loaded[version, number] = held[number]
    return model


def forget_parts() -> None:
    """Drop all parts: a worker lives on for other stages, which need no model."""
    for held in _loaded.values():
        held.__dict__.pop("_value", None)  # the broadcast's file stays
    _loaded.clear()


def score_texts(texts: list[str | None], langs: list[str | None], model: Model):
    """FEATURES, base_failed, scored symbols and log10 probability of each text and of its even words."""
    out = [None] * len(texts)
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang or "und", []).append(i)
    for lang, mine in by_lang.items():
        own = [texts[i] or "" for i in mine]
        for lo, hi in steps(own):
            for i, text, (n, logp, even, even_logp) in zip(mine[lo:hi], own[lo:hi], model.text_scores(lang, own[lo:hi])):
                f = features(text, words_of(text))
                out[i] = (*f, f[0] < 50 or 100 * f[4] > 50 * f[0], n, logp, even, even_logp)
    return out


def scorer(model: Parts):
    """A function of Arrow arrays of texts and languages to structs of FEATURES, base_failed, n_symbols_scored, logp, and the last two of even words."""
    held, version, most = model.held, model.version, HELD
    where = model.where
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_symbols_scored", "logp", "even_symbols", "even_logp"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]

    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        texts, langs = text.to_pylist(), lang.to_pylist()
        rows, number = [None] * len(texts), [where.get(x or "und", 0) for x in langs]
        for part in sorted(set(number)):  # part by part, so that each is loaded once a batch
            mine = [i for i, n in enumerate(number) if n == part]
            for i, row in zip(mine, score_texts([texts[i] for i in mine], [langs[i] for i in mine], load_part(held, version, part, most))):
                rows[i] = row
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def medians(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """lang and the exact median of ``value`` on a grid of 1 / ``GRID``: values are counted by cell first, so no task takes a language's rows."""
    cells = rows.groupBy("lang", F.round(value * GRID).alias("cell")).agg(F.count("*").alias("n"))
    return cells.groupBy("lang").agg((F.percentile("cell", 0.5, F.col("n")) / GRID).alias(name))


def by_language(table: DataFrame, name: str) -> DataFrame:
    """A table of a row a language, to be joined to rows of which one language may hold most: ``FEW`` rows go through the driver and are broadcast, without files."""
    few = table.limit(FEW + 1).toArrow()
    return F.broadcast(table.sparkSession.createDataFrame(few, table.schema)) if few.num_rows <= FEW else materialize(table, name)


BYTES = ["byte_symbols", "byte_logp", "byte_even_symbols", "byte_even_logp"]
BYTE_PPL = "-byte_logp / nullif(byte_symbols, 0)"


def distinct_scores(scored: DataFrame) -> DataFrame:
    """One row (lang, text_hash, ppl, own, byte_ppl, byte_own) a text that passes the base rules: log10 perplexity, and half the difference of its halves in cells, by both models."""
    part = lambda logp, n: -logp / F.nullif(n, F.lit(0))
    made = []
    for prefix, names in (("", ["n_symbols_scored", "logp", "even_symbols", "even_logp"]), ("byte_", BYTES)):
        n, logp, even_n, even_logp = map(F.col, names)
        own = F.abs(part(even_logp, even_n) - part(logp - even_logp, n - even_n)) / 2
        made += [F.min(part(logp, n)).alias(f"{prefix}ppl"), F.min(F.round(own * GRID).cast("long")).alias(f"{prefix}own")]
    good = scored.where("not base_failed").groupBy("lang", "text_hash").agg(*made)  # copies count once
    return materialize(no_wider(good, scored), "distinct-scores")


def bands(good: DataFrame, prefix: str, width: float = WIDTH) -> DataFrame:
    """A language's name, low and high of log10 perplexity by the model ``prefix``, from ``distinct_scores``."""
    good = good.select("lang", F.col(f"{prefix}ppl").alias("ppl"), F.col(f"{prefix}own").alias("own"))
    mid = by_language(medians(good, F.col("ppl"), "mid"), "medians")
    far = good.join(mid.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l"))
    away = medians(far, F.abs(F.col("ppl") - F.col("mid")), "mad").withColumnRenamed("lang", "l")
    within = good.groupBy("lang").agg((F.sum("own") / F.count("own") / GRID).alias("own")).withColumnRenamed("lang", "m")
    # A mean or median absolute deviation to a standard deviation; 0.001 serves only texts that do not vary at all.
    reach = F.lit(width) * F.greatest(F.col("mad") * 1.4826, F.col("own") * 1.2533, F.lit(0.001))
    met = mid.join(away, F.col("lang") == F.col("l")).join(within, F.col("lang") == F.col("m"))
    limits = met.select(F.col("lang").alias(f"{prefix or 'band_'}lang"), (F.col("mid") - reach).alias(f"{prefix}low"), (F.col("mid") + reach).alias(f"{prefix}high"))
    return by_language(limits, f"{prefix}bands")


def score_documents(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, the base columns, ``kept``, and of both models perplexity (log10 a symbol) and its bands, of every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs)
    lang = F.coalesce("lang", F.lit("und"))
    kept = F.struct("doc_id", lang.alias("lang"), F.xxhash64("text").alias("text_hash"))
    rows = byte_scores(docs.select(kept.alias("kept"), lang.alias("lang"), "text"), scorer(model), SCORED, done=forget_parts)
    rows = rows.select("kept.doc_id", "kept.lang", "kept.text_hash", "kept.s.*", *BYTES)
    texts = distinct_scores(rows)
    met = rows.join(bands(texts, "", width), F.col("lang") == F.col("band_lang"), "left").withColumn("log10_ppl", -F.col("logp") / F.nullif(F.col("n_symbols_scored"), F.lit(0)))
    met = met.join(bands(texts, "byte_", width), F.col("lang") == F.col("byte_lang"), "left").withColumn("byte_log10_ppl", F.expr(BYTE_PPL))
    good = ~F.col("base_failed") & F.coalesce(F.col("log10_ppl").between(F.col("low"), F.col("high")) & F.col("byte_log10_ppl").between(F.col("byte_low"), F.col("byte_high")), F.lit(False))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", good.alias("kept")]
    return met.select(*base, "log10_ppl", "low", "high", "byte_log10_ppl", "byte_low", "byte_high")


def keep_good(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns; texts are scored once and stored with their scores."""
    model = train(docs.select("text", "lang"))
    names = docs.columns
    lang = F.coalesce("lang", F.lit("und"))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]
    kept = F.struct(*others, lang.alias("lang"), F.xxhash64("text").alias("text_hash"))
    scored = byte_scores(docs.select(kept.alias("kept"), lang.alias("lang"), "text"), scorer(model), SCORED, with_text=True, done=forget_parts)
    texts = distinct_scores(scored.select("kept.lang", "kept.text_hash", "kept.s.*", *BYTES))
    met = scored.where("not kept.s.base_failed").join(bands(texts, "", width), F.col("kept.lang") == F.col("band_lang")).join(bands(texts, "byte_", width), F.col("kept.lang") == F.col("byte_lang"))
    ppl = -F.col("kept.s.logp") / F.nullif(F.col("kept.s.n_symbols_scored"), F.lit(0))
    good = met.where(ppl.between(F.col("low"), F.col("high")) & F.expr(BYTE_PPL).between(F.col("byte_low"), F.col("byte_high")))
    return good.select(*((F.col("text") if c == "text" else F.col(f"kept.c{i}")).alias(c) for i, c in enumerate(names)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity verdict of every document."""
    return score_documents(documents(spark, sf_dir))
