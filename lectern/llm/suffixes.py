"""Operator 2: exact removal of repeated 200-byte strings by suffix arrays of external induced sorting.

Every byte covered by a ``LEAST``-byte string that starts anywhere else too is removed.  Such strings are found in four steps:

1. *Anchors.*  Each window of ``LEAST`` bytes has an anchor: its ``GRAM``-byte piece of least hash (the leftmost of equals).  Equal
   windows have equal anchors, and consecutive windows mostly share theirs, so a text has one anchor for about 75 bytes.
   Anchors of one text alone that it holds once can't belong to a repeated window and leave (grouped minima and maxima of text numbers).
2. *Contexts.*  The bytes of all windows of a repeated anchor are its context.  Equal contexts of an anchor are counted
   before they move (``copies``); a context that occurs twice has only repeated windows.
3. *Shards.*  Distinct contexts go to shards by anchor, so equal windows meet in one shard.  A shard sorts all suffixes of its contexts
   with their common prefixes by external induced sorting (``lectern.llm.induced``); a window is repeated if a neighbour in
   that order shares ``LEAST`` bytes.  Anchors with more than ``GROUP`` distinct contexts (the rim of a passage that many
   documents hold, each with its own neighbourhood) would pile up in one shard.  Their contexts are cut into parts of ``STEP`` windows that
   are grouped by what these windows share, and decided likewise; the windows of parts that still crowd are compared one
   by one by a 128-bit hash and a grouped count.  Nothing is dropped.
4. *Spans.*  Repeated windows become spans of texts, are gathered for each distinct text and met with the texts by key (md5).
   Texts that occur twice (and have ``LEAST`` bytes) are removed whole.

Joins are on anchors, contexts and text keys and never on pairs; what a hot passage adds is linear in the rows that hold it.
Windows never cross texts.  Null texts are empty; texts below ``LEAST`` bytes lose nothing.  Very long texts are cut into
pieces that overlap by ``LEAST`` - 1 bytes for the search alone.  Repeated rows count as copies of each other and are returned each; an empty
table gives an empty result; extra columns are ignored by the query and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import induced
from lectern.llm.common import discard, documents, materialize, share_code, slices, text_bytes
from lectern.llm.induced import Shard, scratch

LEAST, GRAM, GROUP, STEP, SHARD_BYTES = 200, 50, 256, 8, 4 << 20
#: Buffers of the anchor search: positions take this many bits beside the hash.
ROOM_BITS = 20
RESULT = "struct<n_removed: bigint, n_spans: bigint, kept_sha256: string>"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(buffer: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes, by joining hashes of strings of doubling length."""
    n = len(buffer) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        part = (buffer.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
        part ^= part >> np.uint64(32)
        out, done, length = None, 0, 1
        while length <= width:
            if width & length:
                piece = part[done : done + n]
                out = piece.copy() if out is None else (out * _B + piece) * _A
                out ^= out >> np.uint64(29)
                done += length
            if length * 2 <= width:
                part = (part[:-length] * _A + part[length:]) * _B
                part ^= part >> np.uint64(31)
            length *= 2
        out *= _A
        return out ^ out >> np.uint64(32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _kept or len(_kept[0][0]) < n:
        base, inverse = int(_A), pow(int(_A), -1, 1 << 64)
        out = []
        for x in (base, inverse):
            with np.errstate(over="ignore"):
                p = np.ones(1, np.uint64)
                while len(p) < n:
                    p = np.concatenate((p, p * np.uint64(pow(x, len(p), 1 << 64))))
            out.append(p)
        _kept[:] = [tuple(out)]
    return _kept[0][0][:n], _kept[0][1][:n]


_kept: list[tuple[np.ndarray, np.ndarray]] = []
_LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


def gram_hashes(buffer: np.ndarray, width: int) -> np.ndarray:
    """64-bit polynomial hashes of all strings of ``width`` bytes, from running sums; equal strings have equal hashes."""
    n = len(buffer) - width + 1
    up, down = _powers(len(buffer) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_LETTERS[buffer] * up[:-1], out=sums[1:])
        out = sums[width:] - sums[:n]
        out *= down[:n]
        out ^= out >> np.uint64(32)
        out *= _B
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from minima of doubling widths, block by block."""
    n = len(values) - width + 1
    out = np.empty(n, values.dtype)
    for lo in range(0, n, 1 << 14):  # what a processor holds near it
        part, done = values[lo : lo + (1 << 14) + width - 1], 1
        while done * 2 <= width:
            part, done = np.minimum(part[:-done], part[done:]), done * 2
        here = out[lo : lo + (1 << 14)]
        np.minimum(part[: len(here)], part[width - done : width - done + len(here)], out=here)
    return out


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor's hash, first window, last window) for the windows of texts that fit into one buffer together."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buffer) < LEAST:
        return none, none, none, none
    hashes = gram_hashes(buffer, GRAM)
    keys = hashes >> np.uint64(ROOM_BITS) << np.uint64(ROOM_BITS)
    keys |= np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(keys, LEAST - GRAM + 1)
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    end = np.cumsum(size)
    change[end[:-1][end[:-1] < len(least)]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least)) - 1
    text = np.searchsorted(end, first, side="right")
    last = np.minimum(last, end[text] - LEAST)  # windows don't reach into the next text
    fine = np.flatnonzero(last >= first)
    first, last, text = first[fine], last[fine], text[fine]
    at = (least[first] & np.uint64((1 << ROOM_BITS) - 1)).astype(np.int64)
    base = (end - size)[text]
    return text, hashes[at].view(np.int64), first - base, last - base


def find_anchors(batches):
    """Batches (key, data) to rows (anchor, text, first, last, twice); a text is searched once in a task.

    text: the first eight bytes of its key; twice: the text has this anchor at more than one place.
    """
    seen: set[bytes] = set()
    room = 1 << ROOM_BITS
    held: list[tuple[int, int, bytes]] = []

    def flush():
        which, anchor, first, last = anchors_of([x for _, _, x in held])
        number = np.fromiter((k for k, _, _ in held), np.int64, len(held))[which]
        shift = np.fromiter((s for _, s, _ in held), np.int64, len(held))[which]
        order = np.lexsort((anchor, number))
        same = np.flatnonzero((anchor[order][1:] == anchor[order][:-1]) & (number[order][1:] == number[order][:-1]))
        twice = np.zeros(len(anchor), bool)
        twice[order[same]] = twice[order[same + 1]] = True
        cut = np.fromiter((len(x) == room - 1 for _, _, x in held), bool, len(held))[which]  # pieces of one long text don't see each other
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(number), pa.array((first + shift).astype(np.int32)), pa.array((last + shift).astype(np.int32)), pa.array(twice | cut | (shift > 0))], names=["anchor", "text", "first", "last", "twice"])

    used = 0
    for batch in (part for whole in batches for part in slices(whole, "data")):
        for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
            if len(data) < LEAST or key in seen:
                continue
            if len(seen) < 1 << 20:
                seen.add(key)
            step = room - LEAST
            for lo in range(0, len(data) - LEAST + 1, step):
                piece = data[lo : lo + step + LEAST - 1]
                if used + len(piece) > room:
                    yield flush()
                    used = 0
                held.append((int.from_bytes(key[:8], "big", signed=True), lo, piece))
                used += len(piece)
    if held:
        yield flush()


def cut_contexts(batches):
    """Batches (key, data, found) to rows (key, first, anchor, ctx, piece); a piece comes once in a task, a text's contexts too."""
    known: set[bytes] = set()
    texts: set[bytes] = set()
    for batch in (part for whole in batches for part in slices(whole, "data")):
        keys = batch.column("key").to_pylist()
        new: list[int] = []
        for i, key in enumerate(keys):
            if key not in texts:
                new.append(i)
                if len(texts) < 1 << 20:
                    texts.add(key)
        batch = batch.take(pa.array(new, pa.int64()))
        found = batch.column("found")
        text = np.repeat(np.arange(len(new)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
        places = found.flatten()
        anchor, first, last = (pc.struct_field(places, c).to_numpy(zero_copy_only=False) for c in ("anchor", "first", "last"))
        order = np.lexsort((last, first, anchor, text))
        text, anchor, first, last = text[order], anchor[order], first[order], last[order]
        size = pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False).astype(np.int64)
        fine = last + LEAST <= size[text]  # else of another text with the same number
        again = np.zeros(len(text), bool)  # copies find theirs too
        again[1:] = (text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
        fine &= ~again
        text, anchor, first, last = text[fine], anchor[fine], first[fine], last[fine]
        data = batch.column("data").to_pylist()
        contexts: list[bytes] = []
        pieces: list[bytes | None] = []
        for i, lo, hi in zip(text.tolist(), first.tolist(), (last + LEAST).tolist()):
            piece = data[i][lo:hi]
            ctx = xxhash.xxh3_128_digest(piece)
            contexts.append(ctx)
            if ctx in known:
                pieces.append(None)
                continue
            if len(known) < 1 << 20:
                known.add(ctx)
            pieces.append(piece)
        columns = [batch.column("key").take(pa.array(text)), pa.array(first, pa.int32()), pa.array(anchor, pa.int64()), pa.array(contexts, pa.binary()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "first", "anchor", "ctx", "piece"])


def sort_shard(memory: int, buffer: int, seen=None):
    """All distinct contexts (ctx, piece, copies) of a shard to rows (ctx, first, last) of repeated windows.

    Pieces go to a file as they come.  seen: accumulators that get the runs written by queues and the levels of recursion.
    """

    def run(batches):
        ids: list[bytes] = []
        copies: list[int] = []
        with scratch(memory, buffer) as files:
            shard = Shard(files)
            for batch in (part for whole in batches for part in slices(whole, "piece")):
                ids += batch.column("ctx").to_pylist()
                copies += batch.column("copies").to_pylist()
                for piece in batch.column("piece"):
                    shard.add(piece.as_py())
            if not ids:
                return
            hit, ends = shard.repeated_starts(LEAST)
            if seen is not None:
                seen[0].add(files.written)
                seen[1].add(files.deepest)
            for end, size, n in zip(ends.tolist(), shard.size, copies):
                if n > 1:  # copies repeat each other's windows
                    hit[end - size : end - LEAST + 1] = True
            # No run goes on beyond its piece: no window starts in a piece's last places.
            edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
            edge = np.concatenate(([0], edge)) if hit[0] else edge
            lo, hi = edge[::2], edge[1::2] - 1
            which = ends.searchsorted(lo, side="right")
            base = (ends - np.array(shard.size))[which]
            for k in range(0, max(len(lo), 1), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in which[part].tolist()], pa.binary()), pa.array((lo - base)[part], pa.int32()), pa.array((hi - base)[part], pa.int32())], names=["ctx", "lo", "hi"])

    return run


def cut_parts(batches):
    """Contexts of crowded anchors to parts: rows (anchor, ctx, piece, copies, parent, offset).

    A part holds the windows of a context whose distance to the anchor has the same quotient by ``STEP``; its new anchor is the
    hash of what all windows at these distances share, so equal windows meet again and the rims of a passage part.
    """
    for batch in (part for whole in batches for part in slices(whole, "piece")):
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for anchor, ctx, piece, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ctx", "piece", "copies"))):
            at = int(np.flatnonzero(gram_hashes(np.frombuffer(piece, np.uint8), GRAM).view(np.int64) == anchor)[0])
            nearest, farthest = at - (len(piece) - LEAST), at
            for j in range(nearest // STEP, farthest // STEP + 1):
                lo, hi = at - min(j * STEP + STEP - 1, farthest), at - max(j * STEP, nearest)
                core = piece[at - j * STEP : at - j * STEP + LEAST - STEP + 1]
                part = piece[lo : hi + LEAST]
                key = int.from_bytes(xxhash.xxh3_64_digest(core, j), "big", signed=True)
                for column, value in zip(rows, (key, xxhash.xxh3_128_digest(part), part, n, ctx, lo)):
                    column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["anchor", "ctx", "piece", "copies", "parent", "offset"])


def cut_windows(batches):
    """Contexts of crowded anchors to their windows: rows (h1, h2, ctx, start, copies)."""
    for batch in (part for whole in batches for part in slices(whole, "piece")):
        for ctx, piece, n in zip(*(batch.column(c).to_pylist() for c in ("ctx", "piece", "copies"))):
            buffer = np.frombuffer(piece, np.uint8)
            h1, h2 = (window_hashes(buffer, LEAST, seed).view(np.int64) for seed in (1, 77))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([ctx] * len(h1), pa.binary()), pa.array(np.arange(len(h1), dtype=np.int32)), pa.array(np.full(len(h1), n, np.int64))], names=["h1", "h2", "ctx", "start", "copies"])


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) of a text of ``size`` bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        hi = min(hi, size)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif hi > lo:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in runs:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def decided(distinct: DataFrame, seen=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated windows (ctx, lo, hi) of all anchors of (anchor, ctx, piece, copies) but crowded ones; the rows of these; a table to discard at the end."""
    size = F.octet_length("piece")
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes"), F.first("ctx").alias("ctx"), F.first(size).alias("size"), F.max("copies").alias("most"))
    groups = materialize(groups, "anchor-groups")
    # An anchor with one context needs no order: its windows are repeated if the context is.
    alone = groups.where("n = 1 and most > 1").select("ctx", F.lit(0).alias("lo"), (F.col("size") - LEAST).alias("hi"))
    shared = groups.where((F.col("n") > 1) & (F.col("n") <= GROUP))
    shards = max(1, -(-(shared.agg(F.sum("bytes").alias("b")).first().b or 0) // SHARD_BYTES))
    calm = distinct.join(shared.select("anchor"), "anchor", "left_semi").repartition(shards, "anchor").select("ctx", "piece", "copies")
    crowded = distinct.join(groups.where((F.col("n") > 1) & (F.col("n") > GROUP)).select("anchor"), "anchor", "left_semi").select("anchor", "ctx", "piece", "copies")
    return alone.union(calm.mapInArrow(sort_shard(induced.MEMORY, induced.BUFFER, seen), "ctx binary, lo int, hi int")), crowded, groups


def repeated_spans(texts: DataFrame, seen=None) -> DataFrame:
    """(key, spans array<struct<lo, hi>>) of the texts of rows (key, data) that hold repeated windows; spans may overlap."""
    spark = texts.sparkSession
    share_code(spark)
    anchors = materialize(texts.mapInArrow(find_anchors, "anchor long, text long, first int, last int, twice boolean"), "anchors")
    often = anchors.groupBy("anchor").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.max("twice").alias("t")).where("a <> b or t").select("anchor")
    # Texts meet their anchors by half of their key: a text that shares it with another one only gets contexts too many.
    found = anchors.join(often, "anchor", "left_semi").groupBy("text").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("found"))
    found = materialize(found, "found-anchors")
    discard(anchors)
    number = F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")
    met = texts.where(F.octet_length("data") >= LEAST).withColumn("text", number).join(found, "text").select("key", "data", "found")
    rows = materialize(met.mapInArrow(cut_contexts, "key binary, first int, anchor long, ctx binary, piece binary"), "contexts")
    discard(found)
    distinct = rows.groupBy("anchor", "ctx").agg(F.max("piece").alias("piece"), F.count("*").alias("copies"))
    distinct = materialize(distinct, "distinct-contexts")
    members = materialize(rows.select("key", "first", "ctx"), "members")
    discard(rows)
    size = F.octet_length("piece")
    first, crowded, groups = decided(distinct, seen)
    parts = materialize(crowded.mapInArrow(cut_parts, "anchor long, ctx binary, piece binary, copies long, parent binary, offset int"), "parts")
    small = materialize(parts.groupBy("anchor", "ctx").agg(F.max("piece").alias("piece"), F.sum("copies").alias("copies")), "distinct-parts")
    second, rest, part_groups = decided(small, seen)
    windows = materialize(rest.select("ctx", "piece", "copies").mapInArrow(cut_windows, "h1 long, h2 long, ctx binary, start int, copies long"), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
    third = windows.join(twice, ["h1", "h2"], "left_semi").select("ctx", F.col("start").alias("lo"), F.col("start").alias("hi"))
    of_parts = second.union(third).select(F.col("ctx").alias("p"), "lo", "hi").join(parts.select("ctx", "parent", "offset"), F.col("p") == F.col("ctx"))
    of_parts = of_parts.select(F.col("parent").alias("ctx"), (F.col("lo") + F.col("offset")).alias("lo"), (F.col("hi") + F.col("offset")).alias("hi"))
    verdicts = materialize(first.union(of_parts), "repeated-windows")
    discard(distinct, groups, parts, small, part_groups, windows)
    verdicts = verdicts.withColumnRenamed("ctx", "c")
    spans = members.join(verdicts, F.col("ctx") == F.col("c"))
    spans = spans.select("key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + LEAST).alias("hi"))
    copied = texts.where(F.octet_length("data") >= LEAST).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    spans = spans.union(copied.select("key", F.lit(0), F.lit((1 << 31) - 1)))
    spans = materialize(spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(members)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with repeat_data (UTF-8 bytes of text) and repeat_key (its md5)."""
    return docs.withColumn("repeat_data", text_bytes(F.col("text"))).withColumn("repeat_key", F.unhex(F.md5("repeat_data")))


def digest_column(data: Column, spans: Column) -> Column:
    def run(data: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for x, s in zip(data.to_pylist(), spans.to_pylist()):
            runs = merged([(y["lo"], y["hi"]) for y in s or ()], len(x))
            rows.append({"n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept_bytes(x, runs)).hexdigest()})
        return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    run.__annotations__ = {"data": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(data, spans)


def text_column(data: Column, spans: Column) -> Column:
    """What is left of a text; a character that loses some of its bytes is replaced by U+FFFD."""

    def run(data: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([kept_bytes(x, merged([(y["lo"], y["hi"]) for y in s or ()], len(x))).decode("utf-8", "replace") for x, s in zip(data.to_pylist(), spans.to_pylist())], pa.string())

    run.__annotations__ = {"data": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(data, spans)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with repeat_data, repeat_key and repeat_spans (null: none)."""
    rows = keyed(docs)
    spans = repeated_spans(rows.select(F.col("repeat_key").alias("key"), F.col("repeat_data").alias("data")))
    spans = spans.select(F.col("key").alias("repeat_of"), F.col("spans").alias("repeat_spans"))
    return rows.join(spans, F.col("repeat_key") == F.col("repeat_of"), "left").drop("repeat_of")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with repeated strings cut out of ``text``; all columns stay, a null text stays null."""
    cut = F.when(F.col("text").isNotNull(), text_column(F.col("repeat_data"), F.col("repeat_spans")))
    return with_spans(docs).withColumn("text", cut).select(docs.columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses, and the hash of those that it keeps."""
    rows = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    out = rows.select("doc_id", F.octet_length("repeat_data").cast("long").alias("n_bytes"), digest_column(F.col("repeat_data"), F.col("repeat_spans")).alias("r"))
    return out.select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256")
