"""Operator 5: secret scans by rules and a battery of randomness tests, native columns only.

Rules (kinds assign, access, hex) are regular expressions.  Besides them, each run of 20 or more base64 characters
is a candidate if an encoding can be inferred: hex, base32, base36 or base64, each with letters *and* digits (a word
or a number has no encoding).  A run without an encoding is a candidate by its parts of 20 or more letters and digits
(``sk_live_...``).  A candidate's characters become symbols of that alphabet and meet three tests of the
hypothesis that they are drawn at random: chi-squared uniformity over the alphabet (Wilson-Hilferty), runs above
and below the alphabet's middle (Wald-Wolfowitz) and serial correlation at lag one.  The least of the three p-values,
corrected for three tests (Sidak), is the candidate's score: spread evenly for random strings, near zero for structured ones.

A discovery is a string that looks random; a false one is structured all the same.  What structured strings score is
measured on the corpus: every distinct text gives, for each length band, a null string of the band's least length
(so the tests have no more power over it than over candidates), cut out of its words run together at a place set by the text's hash
written in one of the four encodings and closed by a number, as identifiers are.  A candidate's p-value is conformal: one more than the null strings
of its encoding and band that score as high or higher, over one more than all of them.  Benjamini and Hochberg's procedure at ``RATE`` over
the distinct candidates of each encoding and length band then bounds the expected share of false discoveries there, so short strings have to
score higher than long ones, and a lone string in a small corpus is never a discovery.  Scores are counted in cells (``CELLS`` to a factor of ten, rounded against
the candidate); the cells of the bands (4 encodings x 6 bands x 97 at most) are all that reaches the driver.

Spans are (kind, start, end) in code points, end exclusive.  Added spans have kind ``random``; those inside a rule's
span are left out.  Null and empty texts have no spans (the hash of the empty string).  Positions come from running sums
over blocks of ``BLOCK`` matches, and redaction cuts a text in blocks likewise, so a long text with many matches stays cheap.
Repeated rows give repeated results and count once in every statistic; an empty table gives an empty result; extra columns are kept by ``redact`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents, free_prefix, materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (regex, group, least length of the group).  A minimum within the regex finds the same spans as dropping short runs
#: where a match is a whole run (access, hex); for assign it wouldn't, since a short match still uses its characters up.
RULES = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
#: Only texts with a match of these are cut up at all.
HINTS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "random": "[A-Za-z0-9+/_-]{20}"}
CANDIDATE, PART = "[A-Za-z0-9+/_-]{20,}={0,2}", "[A-Za-z0-9]{20,}"
ENCODINGS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Length bands, by twice the binary logarithm; the last one holds all longer strings.  Cells of scores: CELLS to a factor of ten, DEPTH factors.
FIRST_BAND, LAST_BAND, RATE, BLOCK, CELLS, DEPTH = 8, 13, 0.05, 256, 8, 12
KINDS = ["assign", "access", "hex", "random"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's argument is evaluated once, a repeated expression isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(items: Column, zero: Column | None = None) -> Column:
    return F.aggregate(items, F.lit(0) if zero is None else zero, lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """Exclusive running sums of an array of ints, blockwise."""
    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda j: F.slice(lengths, j * BLOCK + 1, F.lit(BLOCK)))
    inner = lambda b, base: F.transform(b, lambda x, i: base + _sum(F.slice(b, F.lit(1), i)))
    return let(blocks, lambda bs: let(F.transform(bs, lambda b: _sum(b)), lambda sums: F.flatten(F.transform(bs, lambda b, j: let(_sum(F.slice(sums, F.lit(1), j)), lambda base: inner(b, base))))))


def _peak_before(ends: Column) -> Column:
    """Exclusive running maxima of an array of ints, blockwise; zero where nothing stands before."""
    starts = F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda j: F.slice(ends, j * BLOCK + 1, F.lit(BLOCK)))
    peak = lambda items: F.coalesce(F.array_max(items), F.lit(0))
    inner = lambda b, base: F.transform(b, lambda x, i: F.greatest(base, peak(F.slice(b, F.lit(1), i))))
    return let(blocks, lambda bs: let(F.transform(bs, peak), lambda tops: F.flatten(F.transform(bs, lambda b, j: let(peak(F.slice(tops, F.lit(1), j)), lambda base: inner(b, base))))))


def matches(text: Column, kind: str, regex: str, group: int, least: int) -> Column:
    """Array of (start, end, word) of the leftmost non-overlapping matches whose ``group`` has ``least`` characters or more."""
    gaps = F.transform(F.split(text, regex, -1), F.length)
    found = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"), F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("parts"))
    steps = lambda v: F.zip_with(F.slice(v["gaps"], F.lit(1), F.size(v["hits"])), v["hits"], lambda g, h: g + F.length(h))
    ends = lambda s: F.zip_with(_before(s), s, lambda a, b: a + b)
    row = lambda e, h, p: F.struct((e - F.length(h)).alias("start"), e.alias("end"), p.alias("word"))
    placed = lambda v, at: F.transform(v["hits"], lambda h, i: row(F.get(at, i), h, F.get(v["parts"], i)))
    whole = let(found, lambda v: F.when(F.size(v["hits"]) > 0, let(steps(v), lambda s: let(ends(s), lambda at: F.filter(placed(v, at), lambda x: F.length(x["word"]) >= least)))))
    return F.coalesce(F.when(text.rlike(HINTS[kind]), whole), F.array().cast("array<struct<start: int, end: int, word: string>>"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for the standard normal, absolute error below 1e-7 (Abramowitz and Stegun 26.2.17)."""

    def tail(x: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) / 2.5066282746310002 * let(1 / (1 + 0.2316419 * x), poly)

    return let(z, lambda v: let(F.abs(v), lambda x: F.when(v >= 0, tail(x)).otherwise(1 - tail(x))))


def encoding_of(word: Column) -> Column:
    """hex, base32, base36 or base64 for strings with letters and digits of such an alphabet, else null."""
    lower, upper = word.rlike("[a-z]"), word.rlike("[A-Z]")
    return (
        F.when(~word.rlike("[0-9]") | ~(lower | upper), F.lit(None).cast("string"))
        .when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(word.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(word.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").when(lower & upper & word.rlike("^[A-Za-z0-9+/_-]+=*$"), "base64")
    )


def battery(symbols: Column, k: Column) -> Column:
    """p of an array of at least two symbols of an alphabet of ``k``."""

    def test(x: Column) -> Column:
        n, free = F.size(x).cast("double"), k.cast("double") - 1
        # In sorted order the n-th of equal symbols adds 2 n - 1, which makes the square of their number.
        step = lambda a, v: let(F.when(v == a["last"], a["run"] + 1).otherwise(1), lambda r: F.struct(v.alias("last"), r.alias("run"), (a["total"] + 2 * r - 1).alias("total")))
        squares = F.aggregate(F.sort_array(x), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total")), step, lambda a: a["total"])
        chi = k / n * squares - n
        p1 = _normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        next_ = lambda items: F.slice(items, F.lit(2), F.size(items) - 1)
        front = lambda items: F.slice(items, F.lit(1), F.size(items) - 1)
        zero = F.lit(0.0)

        def runs_test(up: Column) -> Column:
            runs = 1 + _sum(F.zip_with(front(up), next_(up), lambda a, b: (a != b).cast("int")))
            ups = _sum(up).cast("double")
            z = lambda both: let(both * (both - n) / (n * n * (n - 1)), lambda v: F.when(v > 0, 2 * _normal_tail(F.abs((runs - both / n - 1) / F.sqrt(v)))).otherwise(0.0))
            return let(ups, lambda u: let(2 * u * (n - u), z))

        def serial_test(mean: Column) -> Column:
            cov = _sum(F.zip_with(front(x), next_(x), lambda a, b: (a - mean) * (b - mean)), zero)
            var = _sum(F.transform(x, lambda v: (v - mean) * (v - mean)), zero)
            return let(var, lambda s: F.when(s > 0, 2 * _normal_tail(F.abs((cov / s + 1 / n) * F.sqrt(n)))).otherwise(0.0))

        p2 = let(F.transform(x, lambda v: (v * 2 >= k).cast("int")), runs_test)
        p3 = let(_sum(x) / n, serial_test)
        return let(F.greatest(zero, F.least(p1, p2, p3)), lambda p: 1 - F.pow(1 - p, F.lit(3.0)))

    return let(symbols, test)


def band_of(length: Column) -> Column:
    return F.least(F.lit(LAST_BAND), F.floor(F.log2(length) * 2)).cast("int")


def score_of(word: Column, encoding: Column) -> Column:
    """The battery's p of a string in its encoding."""
    alphabet = F.lit("")
    for name, letters in ENCODINGS.items():
        alphabet = F.when(encoding == name, F.lit(letters)).otherwise(alphabet)
    plain = F.translate(F.regexp_replace(word, "=+$", ""), "-_", "+/")
    plain = F.when(encoding.isin("hex", "base36"), F.lower(plain)).otherwise(plain)
    symbols = let(alphabet, lambda a: F.transform(F.split(plain, ""), lambda c: F.expr("0") + F.instr(a, c) - 1))
    return battery(symbols, F.length(alphabet))


def tested(words: Column) -> Column:
    """Array of (start, end, word, encoding, band, p) of those of ``words`` (start, end, word) that have an encoding."""

    def one(x: Column, encoding: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"), encoding.alias("encoding"), band_of(F.length(x["word"])).alias("band"), score_of(x["word"], encoding).alias("p"))

    coded = F.filter(words, lambda x: encoding_of(x["word"]).isNotNull())
    return F.transform(coded, lambda x: let(encoding_of(x["word"]), lambda e: one(x, e)))


def null_run(text: Column) -> Column:
    """(encoding, run): the text's words run together, written in one of the encodings."""
    names = list(ENCODINGS)
    encoding = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(text, F.lit("encoding")), F.lit(4)) + 1).cast("int"))
    low = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    camel = F.regexp_replace(F.initcap(text), "[^A-Za-z0-9]+", "")
    letters = "abcdefghijklmnopqrstuvwxyz"
    folded = "".join("0123456789abcdef"[i % 16] for i in range(26))
    written = (
        F.when(encoding == "hex", F.translate(low, letters, folded)).when(encoding == "base32", F.translate(F.upper(low), "0189", "ABCD")).when(encoding == "base36", low).otherwise(camel)
    )
    return F.struct(encoding.alias("encoding"), written.alias("run"))


def null_strings(null: Column, key: Column) -> Column:
    """Array of (encoding, band, p): one string of ``null`` (encoding, run) for each length band, at places set by ``key``."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(max(20, -int(-(2 ** (b / 2)) // 1))).alias("size")) for b in range(FIRST_BAND, LAST_BAND + 1)])
    fits = F.filter(bands, lambda b: b["size"] <= F.length(null["run"]))
    place = lambda b: F.pmod(F.xxhash64(key, b["band"]), (F.length(null["run"]) - b["size"] + 1).cast("long")).cast("int")
    # Digits 2 to 7 are in every alphabet: a number of four makes an identifier of the words.
    number = lambda b: F.translate(F.lpad(F.pmod(F.xxhash64(key, b["band"], F.lit(1)), F.lit(10_000)).cast("string"), 4, "0"), "0189", "3456")
    string = lambda b: F.concat(F.substring(null["run"], place(b) + 1, b["size"] - 4), number(b))
    return F.transform(fits, lambda b: F.struct(null["encoding"].alias("encoding"), b["band"].alias("band"), score_of(string(b), null["encoding"]).alias("p")))


def rule_spans(text: Column) -> Column:
    """Sorted (start, rank of the kind, end) of the rules' matches."""
    def ranked(rank: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))

    parts = [F.transform(matches(text, kind, *rule), ranked(rank)) for rank, (kind, rule) in enumerate(RULES.items())]
    return F.array_sort(F.concat(*parts))


def candidates_of(runs: Column, parts: Column) -> Column:
    """The tested runs, and the tested parts that lie in none of them."""
    return F.concat(runs, F.filter(parts, lambda x: ~F.exists(runs, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))))


def scanned(docs: DataFrame, nulls: bool, p: str) -> DataFrame:
    """``docs`` with base, random (start, end, word, encoding, band, p) and, with ``nulls``, key and null (encoding, band, p), all behind the prefix ``p``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [F.xxhash64(text).alias(f"{p}key"), null_run(text).alias(f"{p}run")] if nulls else []
    out = docs.select("*", rule_spans(text).alias(f"{p}base"), matches(text, "random", CANDIDATE, 0, 20).alias(f"{p}runs"), matches(text, "random", PART, 0, 20).alias(f"{p}parts"), *more)
    out = out.withColumn(f"{p}runs", tested(F.col(f"{p}runs"))).withColumn(f"{p}parts", tested(F.col(f"{p}parts")))
    if nulls:
        out = out.withColumn(f"{p}null", null_strings(F.col(f"{p}run"), F.col(f"{p}key"))).drop(f"{p}run")
    return out.withColumn(f"{p}random", candidates_of(F.col(f"{p}runs"), F.col(f"{p}parts"))).drop(f"{p}runs", f"{p}parts")


def cell_of(p: Column) -> Column:
    """0 for the highest scores."""
    return F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DEPTH))) * CELLS).cast("int")


def thresholds(candidates: DataFrame, nulls: DataFrame, rate: float = RATE) -> dict[str, int]:
    """The last cell that each band (``encoding:band``) accepts.

    candidates: rows (word, encoding, band, p), each string counts once; nulls: rows (text_key, encoding, band, p), each text counts once.
    """
    once = candidates.groupBy("word").agg(F.first("encoding").alias("encoding"), F.first("band").alias("band"), F.first("p").alias("p"))
    seen = once.groupBy("encoding", "band", cell_of(F.col("p")).alias("cell")).agg(F.count("*").alias("n"))
    null = nulls.groupBy("text_key", "encoding", "band").agg(F.first("p").alias("p")).groupBy("encoding", "band", cell_of(F.col("p")).alias("cell")).agg(F.count("*").alias("n"))
    cells: dict[tuple[str, int], dict[int, list[int]]] = {}
    for r in seen.withColumn("kind", F.lit(0)).union(null.withColumn("kind", F.lit(1))).collect():  # 4 encodings x 6 bands x 97 cells at most, of two kinds
        cells.setdefault((r.encoding, r.band), {}).setdefault(r.cell, [0, 0])[r.kind] += r.n
    out = {}
    for (encoding, band), counts in cells.items():
        m, n = (sum(x[kind] for x in counts.values()) for kind in (0, 1))
        found = random = 0
        for cell in sorted(counts):
            found, random = found + counts[cell][0], random + counts[cell][1]
            if counts[cell][0] and m * (1 + random) / (1 + n) <= rate * found:
                out[f"{encoding}:{band}"] = cell
    return out


def all_spans(base: Column, candidates: Column, levels: dict[str, int]) -> Column:
    """Sorted spans of the rules and of the candidates that their band accepts and no rule's span holds."""
    level = F.lit(-1)
    if levels:
        known = F.create_map(*[F.lit(v) for item in sorted(levels.items()) for v in item])
    pick = lambda x: F.coalesce(F.try_element_at(known, F.concat_ws(":", x["encoding"], x["band"].cast("string"))), level) if levels else level
    free = lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    kept = F.filter(candidates, lambda x: (cell_of(x["p"]) <= pick(x)) & free(x))
    added = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(len(RULES)).alias("rank"), x["end"].alias("end")))
    return F.array_sort(F.concat(base, added))


def join_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, scan_base and scan_spans (start, rank in KINDS, end) of every row of ``docs`` (doc_id, text)."""
    found = materialize(scanned(docs.select("doc_id", "text"), True, "lectern_").drop("text"), "scanned")
    levels = thresholds(found.select(F.inline("lectern_random")), found.select(F.col("lectern_key").alias("text_key"), F.inline("lectern_null")))
    return found.select("doc_id", F.col("lectern_base").alias("scan_base"), all_spans(F.col("lectern_base"), F.col("lectern_random"), levels).alias("scan_spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans of ``text`` replaced by ``mark``; a null text stays null.

    Texts are scanned twice (for the thresholds, then row by row), so that none is shuffled or stored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tests = materialize(scanned(docs.select("text"), True, "lectern_").select("lectern_key", "lectern_null", F.transform("lectern_random", lambda x: x.dropFields("start", "end")).alias("r")), "tests")
    levels = thresholds(tests.select(F.inline("r")), tests.select(F.col("lectern_key").alias("text_key"), F.inline("lectern_null")))
    discard(tests)

    def block(part: Column) -> Column:
        """What some consecutive spans leave of the text between the first one's ``done`` and the last one's end, cut out once."""
        base, end = F.get(part, F.lit(0))["done"], F.greatest(F.array_max(F.transform(part, lambda y: y["end"])), F.get(part, F.lit(0))["done"])
        keep = lambda held, at, x: F.when(x["start"] >= x["done"], F.concat(F.substring(held, x["done"] - at + 1, x["start"] - x["done"]), F.lit(mark))).otherwise("")
        return let(F.struct(base.alias("at"), F.substring(text, base + 1, end - base).alias("held")), lambda h: F.concat_ws("", F.transform(part, lambda x: keep(h["held"], h["at"], x))))

    def cut(spans: Column) -> Column:
        ends = F.transform(spans, lambda y: y["end"])
        placed = F.zip_with(spans, _peak_before(ends), lambda x, d: F.struct(x["start"].alias("start"), x["end"].alias("end"), d.alias("done")))
        blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda j: block(F.slice(p, j * BLOCK + 1, F.lit(BLOCK))))
        tail = F.substring(text, F.array_max(ends) + 1, F.length(text))
        return F.when(F.size(spans) > 0, F.concat(F.concat_ws("", let(placed, blocks)), tail)).otherwise(F.col("text"))

    p = free_prefix(docs.columns)
    out = scanned(docs, False, p).withColumn(f"{p}spans", all_spans(F.col(f"{p}base"), F.col(f"{p}random"), levels))
    return out.withColumn("text", cut(F.col(f"{p}spans"))).select(docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, with the counts and the hash of the rules' spans."""
    count = lambda r: F.size(F.filter("scan_base", lambda x: x["rank"] == r)).cast("long")
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(join_spans(F.col("scan_base")).cast("binary"), 256).alias("base_sha256"), join_spans(F.col("scan_spans")).alias("spans"))
