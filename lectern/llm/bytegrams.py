"""Byte n-grams of whole texts, by language: the second model of operator 1.

The symbols are the bytes of a text as they are, so no two texts look alike to the model, and each byte is predicted from the ``ORDER - 1``
before it, across words; zero bytes stand before a text's start.  Interpolated modified Kneser-Ney, all n-grams kept.
The model grows with the corpus, so no process ever holds it.  Its sorted arrays are dealt out by language and by the last three bytes of
the context, and meet the texts block by block:

1. Texts are packed into blocks of about ``BLOCK_BYTES``, written as a table bucketed by block.
2. The distinct n-grams of every block go to their parts, sorted by their contexts from the last byte back and packed as steps, which are small
   in that order.  All n-grams whose contexts end in the same three bytes share a part, so counts, continuation counts, context totals and back-off weights of orders above 3 are whole there.
   Counts of counts and orders 3 and less (256^3 n-grams of a language at the very most) are summed over all parts and broadcast.
3. Every part answers each block with the probabilities of the block's n-grams, in their order and without their codes, which the block
   finds in its texts again; the block adds the probabilities up over its texts.

Null and empty texts have no symbols.  Languages are independent.  Any columns of the caller travel in one struct.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, drop_table, materialize, share_code, shared_dir, slices, trim

ORDER, LOW, BITS = 6, 3, 8
BLOCK_BYTES, STEP = 16 << 20, 1 << 21
PAD = bytes(ORDER - 1)
SCORES = "byte_symbols long, byte_logp double, byte_even_symbols long, byte_even_logp double"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def pack(values: np.ndarray) -> bytes:
    """An array of fixed width as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps_of(codes: np.ndarray) -> bytes:
    return pack(np.diff(codes, prepend=0).astype("<i8"))


def codes_from(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<i8"))


def grams(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Codes of the n-grams that end at each byte of ``data[lo:hi]``: that byte lowest, then the context, its last byte highest."""
    code = np.zeros(hi - lo, "<i8")
    planes = code.view(np.uint8).reshape(-1, 8)
    planes[:, 0] = data[lo:hi]
    for back in range(1, ORDER):
        at = max(0, back - lo)  # only the first window lacks bytes before it, and those are zeros
        planes[at:, ORDER - back] = data[lo + at - back : hi - back]
    return code


def lowered(codes: np.ndarray) -> np.ndarray:
    """The n-grams without their first bytes."""
    return codes >> 2 * BITS << BITS | codes & (1 << BITS) - 1


def summed(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their numbers, or sums of ``n``."""
    if n is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n[order], first) if len(first) else n


def levels(codes: np.ndarray, n: np.ndarray, top: int, low: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codes and (continuation) counts of the orders ``top`` to ``low``."""
    out = {top: (codes, n)}
    for order in range(top - 1, low - 1, -1):
        out[order] = summed(lowered(out[order + 1][0]))
    return out


def of_counts(n: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2, D3+; where counts of counts are missing, the usual half, one and one and a half."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def raised(by_order: dict, d: dict[int, np.ndarray], lower: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and probabilities of the highest order, interpolated order by order from ``lower``, those below the lowest."""
    for order in sorted(by_order):
        codes, n = by_order[order]
        off = d[order][np.minimum(n, 3)]
        at = np.cumsum(np.diff(codes >> BITS, prepend=-1) != 0) - 1  # sorted codes have their contexts together
        total = np.bincount(at, n)
        base = lower[1][np.searchsorted(lower[0], lowered(codes))]
        lower = codes, (n - off) / total[at] + (np.bincount(at, off) / total)[at] * base
    return lower


def write_blocks(batches, score, done=None):
    """Batches (kept, lang, text) to blocks: texts by language, each after its pad; kept gets what ``score`` says of text and language as ``s``.

    ``score`` runs here, for a UDF before this one would be a second Python process beside it; ``done`` gives back what it holds at the end.
    """

    def block(kept, langs, texts):
        lang = pa.concat_arrays(langs)
        order = pc.sort_indices(lang)
        lang, own = lang.take(order).to_pylist(), pa.concat_arrays(texts).take(order)
        names = sorted(set(lang), key=lang.index)
        data = b"".join(x for t in own for x in (PAD, t.as_py()))
        sizes = pc.binary_length(own).to_numpy(zero_copy_only=False).astype("<i8")
        rows = pa.concat_arrays(kept).take(order)
        one = lambda items, kind=None: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items if kind is None else pa.array(items, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65]), one(rows), one(names, pa.string()), one([lang.count(x) for x in names], pa.int32()), pa.array([pack(sizes)]), pa.array([zstandard.ZstdCompressor(level=3).compress(data)]), pa.array([len(data)])],
            names=["block", "kept", "langs", "rows", "sizes", "data", "n_bytes"],
        )

    kept, langs, texts, size = [], [], [], 0
    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts.append(pc.fill_null(batch.column("text").cast(pa.large_binary()), b""))
        lang, own = batch.column("lang").cast(pa.string()), batch.column("kept")
        kept.append(pa.StructArray.from_arrays([*own.flatten(), score(batch.column("text"), lang)], [*(f.name for f in own.type), "s"]))
        langs.append(lang)
        size += texts[-1].nbytes
        if size >= BLOCK_BYTES:
            yield block(kept, langs, texts)
            kept, langs, texts, size = [], [], [], 0
            trim()
    if texts:
        yield block(kept, langs, texts)
    if done:
        done()
    trim()


def segments(langs, rows, sizes: bytes, data: bytes):
    """(lang, bytes, starts and sizes of its texts) of a block."""
    whole, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), unpack(sizes, "<i8")
    text = byte = 0
    for lang, n in zip(langs, rows):
        own = size[text : text + n]
        starts = np.cumsum(own + len(PAD)) - own
        end = byte + int(own.sum()) + n * len(PAD)
        yield lang, whole[byte:end], starts, own
        text, byte = text + n, end


def symbols(starts: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a segment belong to texts and not to pads."""
    real = np.ones(length, bool)
    for k in range(1, len(PAD) + 1):
        real[starts - k] = False
    return real


def by_step(data: np.ndarray, starts: np.ndarray):
    """The codes of a segment's n-grams, step by step."""
    real = symbols(starts, len(data))
    for lo in range(0, len(data), STEP):
        yield grams(data, lo, min(lo + STEP, len(data)))[real[lo : lo + STEP]]


def stretches(starts: np.ndarray, size: np.ndarray):
    """(from, to, first text, one past the last) of whole texts of about ``STEP`` bytes; a longer one is cut every ``STEP`` bytes, apart from others."""
    ends, first = starts + size, 0
    while first < len(size):
        lo = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, lo + STEP, side="right")))
        hi = int(ends[last - 1])
        for at in range(lo, hi, STEP):
            yield at, min(at + STEP, hi), first, last
        first = last


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The parts of n-grams, by the last three bytes of their contexts."""
    with np.errstate(over="ignore"):
        ends = (codes >> BITS * (ORDER - LOW)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((ends >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # 16 bits are sorted by radix


ENTRIES = "part int, lang string, block long, codes binary, counts binary"


def deal(parts: int):
    """Blocks to ENTRIES."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for lang, data, starts, size in segments(r["langs"], r["rows"], r["sizes"], r["data"]):
                    if not size.any():
                        continue
                    codes, n = summed(*(np.concatenate(x) for x in zip(*map(summed, by_step(data, starts)))))
                    part = part_of(codes, parts)
                    order = np.argsort(part, kind="stable")
                    cuts = np.flatnonzero(np.diff(part[order])) + 1
                    for mine in np.split(order, cuts):
                        out.append((int(part[mine[0]]), lang, r["block"], steps_of(codes[mine]), pack(n[mine].astype("<i8"))))
                if out:
                    kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "lang", "block", "codes", "counts"])

    return run


PARTS = "part int, lang string, blocks array<long>, codes array<binary>, counts array<binary>, of_counts array<long>, low_codes binary, low_counts binary"


def whole_counts(codes: list[bytes], counts: list[bytes]):
    """The part's n-grams and their counts over all blocks."""
    return summed(np.concatenate([codes_from(c) for c in codes]), np.concatenate([unpack(c, "<i8") for c in counts]))


def gather(batches):
    """ENTRIES sorted by part and language to one row a part and language, with its statistics."""

    def row(key, held):
        codes, counts = [r["codes"] for r in held], [r["counts"] for r in held]
        by = levels(*whole_counts(codes, counts), ORDER, LOW)
        made = (*key, [r["block"] for r in held], codes, counts, [x for k in range(ORDER, LOW, -1) for x in of_counts(by[k][1])], steps_of(by[LOW][0]), pack(by[LOW][1].astype("<i8")))
        kinds = (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(made, kinds)], names=["part", "lang", "blocks", "codes", "counts", "of_counts", "low_codes", "low_counts"])

    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["part"], r["lang"]) != key:
                yield row(key, held)
                held = []
            key = r["part"], r["lang"]
            held.append(r)
    if held:
        yield row(key, held)


def low_rows(batches):
    for batch in batches:
        for r in batch.to_pylist():
            codes = codes_from(r["low_codes"])
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(codes), pa.string()), pa.array(codes), pa.array(unpack(r["low_counts"], "<i8"))], names=["lang", "code", "n"])


def low_models(parts: DataFrame) -> dict[str, tuple[dict[int, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """By language the discounts of orders above ``LOW``, and codes and probabilities of order ``LOW``."""
    named = F.posexplode("of_counts").alias("at", "n")
    met = parts.select("lang", named).groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()  # a dozen rows a language
    low = parts.select("lang", "low_codes", "low_counts").mapInArrow(low_rows, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = low["lang"].combine_chunks().dictionary_encode(), low["code"].to_numpy(), low["n"].to_numpy()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    out = {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        mine = np.flatnonzero(lang.indices.to_numpy(zero_copy_only=False) == i)
        mine = mine[np.argsort(code[mine])]
        by = levels(code[mine], n[mine], LOW, 1)
        lowest = np.arange(1 << BITS), np.full(1 << BITS, 1 / (1 << BITS))
        counts = {r.at: r.n for r in met if r.lang == name}
        high = {k: discounts(*(counts[4 * (ORDER - k) + j] for j in range(4))) for k in range(ORDER, LOW, -1)}
        out[name] = high, raised(by, {k: discounts(*of_counts(x)) for k, (_, x) in by.items()}, lowest)
    return out


ANSWERS = "block long, lang string, part int, logp binary"


def answer(low):
    """Rows of PARTS to ANSWERS: log10 probabilities of each block's n-grams, in the order of their codes."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d, lower = low.value[r["lang"]]
                by = levels(*whole_counts(r["codes"], r["counts"]), ORDER, LOW + 1)
                codes, p = raised(by, d, lower)
                logp = np.log10(p).astype("<f4")
                n = len(r["blocks"])
                logs = [pack(logp[np.searchsorted(codes, codes_from(c))]) for c in r["codes"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["blocks"], pa.int64()), pa.array([r["lang"]] * n, pa.string()), pa.array([r["part"]] * n, pa.int32()), pa.array(logs, pa.binary())], names=["block", "lang", "part", "logp"])

    return run


def scored(with_text: bool, parts: int):
    """A block and its answers to rows of (kept, SCORES)."""

    def texts_scores(data, starts, size, answers):
        out, steps = np.zeros((4, len(size))), []
        real = symbols(starts, len(data))
        for lo, hi, first, last in stretches(starts, size):
            at, found = pd.factorize(grams(data, lo, hi)[real[lo:hi]])
            steps.append((lo, hi, first, last, at.astype(np.int32), found))
        if not steps:
            return out
        codes = np.unique(np.concatenate([np.sort(x[-1]) for x in steps]))
        logp = np.empty(len(codes), np.float32)
        logp[np.argsort(part_of(codes, parts), kind="stable")] = np.concatenate([unpack(answers[k], "<f4") for k in sorted(answers)])
        turned = 0  # whether the last byte of the step before belongs to an odd word of a text that goes on
        for k, (lo, hi, first, last, at, found) in enumerate(steps):
            value = np.zeros(hi - lo, np.float32)
            value[real[lo:hi]] = logp[np.searchsorted(codes, found)][at]
            steps[k] = at = None
            space = _SPACE[data[lo - 1 : hi]] | ~real[lo - 1 : hi]
            odd = np.bitwise_xor.accumulate((space[1:] & ~space[:-1]).view(np.uint8))
            for i in (first + np.flatnonzero(size[first:last])).tolist():  # by text, which no other text of the block can change
                begin, end = max(int(starts[i]), lo) - lo, min(int(starts[i] + size[i]), hi) - lo
                here = turned if starts[i] < lo else odd[begin]
                even = odd[begin:end] == here
                own = value[begin:end].astype(float)
                out[:, i] += end - begin, own.sum(), even.sum(), own[even].sum()
                turned = odd[end - 1] ^ here
        return out

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        by: dict[str, dict[int, bytes]] = {}
        for r in answers.to_pylist():
            by.setdefault(r["lang"], {})[r["part"]] = r["logp"]
        kept, numbers, texts = [], [], []
        for r, rows in zip(block.select(["langs", "rows", "sizes", "data"]).to_pylist(), block["kept"].combine_chunks()):
            kept.append(rows.values)
            for lang, data, starts, size in segments(r["langs"], r["rows"], r["sizes"], r["data"]):
                numbers.append(texts_scores(data, starts, size, by.pop(lang, {})))
                if with_text:
                    texts += [data[a : a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip(starts.tolist(), size.tolist())]
        del by
        trim()
        n = np.concatenate(numbers, axis=1)
        cols = [pa.concat_arrays(kept), pa.array(n[0].astype(np.int64)), pa.array(n[1]), pa.array(n[2].astype(np.int64)), pa.array(n[3])]
        names = ["kept", "byte_symbols", "byte_logp", "byte_even_symbols", "byte_even_logp"]
        return pa.Table.from_arrays([*cols, *([pa.array(texts, pa.string())] if with_text else [])], names=[*names, *(["text"] if with_text else [])])

    return run


def byte_scores(rows: DataFrame, score, kind: str, with_text: bool = False, done=None) -> DataFrame:
    """``rows`` (kept, lang, text) as kept with ``score``'s struct ``s`` of the type ``kind``, and SCORES; ``with_text`` adds the text (null as empty)."""
    spark = rows.sparkSession
    share_code(spark)
    kind = f"{rows.schema['kept'].dataType.simpleString()[:-1]},s:{kind}>"
    name = f"lectern_texts_{uuid.uuid4().hex}"
    packed = rows.select("kept", "lang", "text").mapInArrow(lambda batches: write_blocks(batches, score, done), f"block long, kept array<{kind}>, langs array<string>, rows array<int>, sizes binary, data binary, n_bytes long")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())  # see pieces.encode
    packed.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    parts = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BLOCK_BYTES))
    entries = blocks.select("block", "langs", "rows", "sizes", "data").mapInArrow(deal(parts), ENTRIES)
    held = materialize(entries.repartition(parts, "part").sortWithinPartitions("part", "lang").mapInArrow(gather, PARTS), "byte-grams")
    del entries
    low = spark.sparkContext.broadcast(low_models(held))
    gc.collect()
    spark._jvm.System.gc()  # the entries' shuffle files go before the answers' come; only now, since Spark refers to a job until the next has run
    answers = held.select("part", "lang", "blocks", "codes", "counts").mapInArrow(answer(low), ANSWERS)
    met = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored(with_text, parts), f"kept {kind}, {SCORES}" + ", text string" * with_text)
    out = materialize(met, "byte-scores")
    drop_table(spark, name)
    discard(held)
    return out
