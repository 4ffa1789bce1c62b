"""Operator 9: SentencePiece encoding and decoding through a table of distinct chunks.

The library marks each space (and the text's start) with U+2581 before it merges.  Where no piece of the
model holds a marker behind another character, no merge crosses the start of a run of markers, so a text's
ids are those of its chunks (a run of markers with what follows it) in their order.  Chunks repeat far more
than texts do:

1. *Coding.*  Texts are cut into chunks and dealt to blocks of about ``BLOCK_BYTES`` as they are read.  A block holds its distinct
   chunks once, the ``OFTEN`` most frequent first and the others in alphabetical order (which compresses best), and for each text the
   numbers of its chunks by position.  Blocks are written as a table bucketed by block (one row each), so that they need no shuffle later on.
2. *Distinct chunks.*  All blocks' chunks meet in buckets by a hash of the chunk (``SPREAD`` buckets for each block, so a bucket's size doesn't
   grow with the corpus).  A bucket is a part of the table of distinct chunks: each of them is segmented and decoded by the library
   exactly once, and its ids go back to every (block, number) that has it, packed by block (the decoded text only where it isn't the chunk).
3. *Join by position.*  The answers of a block meet its row, and ids and decoded strings are taken by number at each position.

What moves is the distinct chunks of every block and not the words: one chunk's places are as many as there are blocks at most.

``check_model`` verifies the conditions (identity normalisation, dummy prefix, no crossing piece) on the
driver and raises otherwise.  The model's bytes travel to the workers by broadcast; a model file is a fixed
input whose size is checked against ``MODEL_BYTES``.

Null and empty text: no ids, hashes of the empty string.  A very long text is a block of its own, a very long chunk an entry like any
other.  Repeated rows give repeated results, null ids stay null; an empty table gives an empty result.  ``encode`` keeps any columns
of the caller, whatever their names, inside one struct; the query ignores extra columns.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, drop_table, materialize, share_code, shared_dir, slices, trim

BLOCK_BYTES, MODEL_BYTES, OFTEN, SPREAD = 32 << 20, 32 << 20, 1 << 16, 4
MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(path: str) -> bytes:
    """The model's bytes, if chunks of it can be segmented on their own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    raw = open(path, "rb").read()
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path}: {len(raw)} bytes are too many to broadcast")
    spec = sentencepiece_model_pb2.ModelProto.FromString(raw)
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: its normalisation doesn't allow encoding by chunks")
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for i in range(model.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)):
            raise ValueError(f"{path}: piece {i} crosses a marker")
    return raw


def chunks(text: str) -> list[str]:
    """A text's chunks without their first marker."""
    if not text:
        return []
    return [x[1:] for x in CHUNKS.findall(MARK + text.replace(" ", MARK))]


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Order of the texts taken, where each one's chunks end, and all chunks; plain texts are cut by Arrow, others by ``chunks``."""
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.or_(pc.starts_with(texts, " "), pc.equal(pc.binary_length(texts), 0))))
    odd = odd.to_numpy(zero_copy_only=False)
    order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    flat, size = plain.flatten(), np.diff(plain.offsets.to_numpy())
    if odd.any():
        own = [chunks(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        flat = pa.concat_arrays([flat, pa.array([c for x in own for c in x], pa.large_string())])
        size = np.concatenate((size, np.fromiter(map(len, own), np.int64, len(own))))
    return order, np.cumsum(size).astype(np.int64), flat


def squeeze(codes: np.ndarray) -> bytes:
    """Numbers below 2^31 as compressed byte planes."""
    planes = np.ascontiguousarray(codes.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=9).compress(planes)


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def code_blocks(block_bytes: int):
    """Batches (kept, text) to blocks: (block, kept, ends, codes, words)."""

    def block(kept: list[pa.Array], sizes: list[np.ndarray], coded: list[pa.Array]) -> pa.RecordBatch:
        met = pa.chunked_array(coded).unify_dictionaries()  # one dictionary for all parts
        coded.clear()
        words = met.chunk(0).dictionary
        codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in met.chunks])
        del met
        often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")[:OFTEN]
        rare = np.ones(len(words), bool)
        rare[often] = False
        sorted_ = pc.sort_indices(words).to_numpy().astype(np.int64)
        often = np.concatenate((often, sorted_[rare[sorted_]]))
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        ends = np.cumsum(np.concatenate(sizes)).astype(np.int64)
        one = lambda items: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        number = uuid.uuid4().int >> 65  # only the attempt that is committed is ever read
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(pa.concat_arrays(kept)), pa.array([ends.tobytes()]), pa.array([squeeze(rank[codes])]), one(words.take(pa.array(often)).cast(pa.string()))],
            names=["block", "kept", "ends", "codes", "words"],
        )

    def run(batches):
        kept, sizes, coded, held = [], [], [], 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            # Each part is coded as it comes: a block holds numbers and distinct chunks, never its texts.
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            order, ends, flat = cut(texts)
            kept.append(batch.column("kept").take(pa.array(order)))
            sizes.append(np.diff(ends, prepend=0))
            coded.append(flat.dictionary_encode())
            held += texts.nbytes
            del texts, flat
            if held >= block_bytes:
                yield block(kept, sizes, coded)
                kept, sizes, coded, held = [], [], [], 0
                trim()
        if kept:
            yield block(kept, sizes, coded)
            trim()

    return run


class Pieces:
    """The library's segmentation of chunks."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.lone = [self.model.piece_to_id(MARK)]

    def segment(self, new: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids and decoded text of chunks; the library adds the first marker itself."""
        ids = self.model.encode(new, num_threads=1)
        return [x if c else self.lone for c, x in zip(new, ids)], self.model.decode(ids, num_threads=1)


ANSWER = "block long, codes binary, sizes binary, ids binary, odd array<int>, odd_text array<string>"


ENTRIES = "bucket int, block long, n int, sizes binary, data binary, codes binary"


def deal_entries(buckets: int):
    """Batches (block, words) to rows of ENTRIES: a block's chunks of a bucket, packed, with their numbers as steps."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block, row in zip(batch.column("block").to_pylist(), batch.column("words")):
                words = row.values
                if not len(words):
                    continue
                bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
                rows = []
                for part in np.split(order, cuts[1:]):
                    own = words.take(pa.array(part))
                    size = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
                    data = own.buffers()[2]
                    rows.append((int(bucket[part[0]]), block, len(part), squeeze(size), pack.compress(data.to_pybytes()[: int(size.sum())] if data else b""), squeeze(np.diff(part, prepend=0))))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "block", "n", "sizes", "data", "codes"])

    return run


def segment_buckets(raw):
    """Rows of ENTRIES sorted by bucket to rows of ANSWER; every distinct chunk of a bucket is segmented once."""

    def answers(pieces: Pieces, held: list[dict]) -> pa.RecordBatch:
        parts = []
        for r in held:
            ends = np.concatenate(([0], np.cumsum(spread(r["sizes"])))).astype(np.int64)
            parts.append(pa.LargeStringArray.from_buffers(r["n"], pa.py_buffer(ends), pa.py_buffer(zstandard.ZstdDecompressor().decompress(r["data"]))))
        coded = pa.concat_arrays(parts).dictionary_encode()
        new = coded.dictionary.to_pylist()
        ids, text = pieces.segment(new)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        first, odd = np.cumsum(size) - size, np.fromiter((a != b for a, b in zip(new, text)), bool, len(new))
        rows, lo = [], 0
        for r in held:
            at = coded.indices[lo : lo + r["n"]].to_numpy(zero_copy_only=False).astype(np.int64)
            lo += r["n"]
            own = size[at]
            spots = np.repeat(first[at] - np.cumsum(own) + own, own) + np.arange(int(own.sum()))
            strange = np.flatnonzero(odd[at])
            codes = np.cumsum(spread(r["codes"])) if len(strange) else None
            rows.append((r["block"], r["codes"], squeeze(own), squeeze(flat[spots]), [] if codes is None else codes[strange].tolist(), [text[i] for i in at[strange]]))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "codes", "sizes", "ids", "odd", "odd_text"])

    def run(batches):
        pieces, held = Pieces(raw.value), []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["bucket"] != held[0]["bucket"]:
                    yield answers(pieces, held)
                    held = []
                held.append(r)
        if held:
            yield answers(pieces, held)

    return run


def joined(full: bool):
    """A block's row and its answers to rows (kept, n_tokens, ids_sha256, decoded_sha256), or (kept, ids, decoded) with ``full``."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows, n, a, b = [], [], [], []
        if len(answers):
            codes = np.concatenate([np.cumsum(spread(x)) for x in answers["codes"].to_pylist()])
            sizes, ids = (np.concatenate([spread(x) for x in answers[c].to_pylist()]) for c in ("sizes", "ids"))
            order = np.argsort(codes)
            first, pieces = (np.cumsum(sizes) - sizes)[order], sizes[order]
            spots = np.repeat(first - np.cumsum(pieces) + pieces, pieces)
            spots += np.arange(len(ids))
            flat = ids[spots]
            del spots, ids, first, order, sizes, codes
            digits = pa.array([str(i) for i in range(int(flat.max(initial=0)) + 1)])
            shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pieces))).astype(np.int32)), digits.take(pa.array(flat))), ",")
            del flat
            other = {c: x for cs, xs in zip(answers["odd"].to_pylist(), answers["odd_text"].to_pylist()) for c, x in zip(cs, xs)}
        for kept, ends, codes, words in zip(block["kept"].combine_chunks(), block["ends"].to_pylist(), block["codes"].to_pylist(), block["words"].combine_chunks()):
            ends, codes = np.frombuffer(ends, np.int64), spread(codes)
            rows.append(kept.values)
            if not len(codes):
                shown, pieces, text = pa.array([], pa.string()), np.zeros(0, np.int64), pa.array([], pa.string())
            else:
                text = pc.binary_join_element_wise(" ", words.values, "")
                if other:
                    plain = text.to_pylist()
                    for c, x in other.items():
                        plain[c] = " " + x
                    text = pa.array(plain, pa.string())
            begin, at = np.concatenate(([0], ends[:-1])).astype(np.int64), 0
            while at < len(ends):  # a few texts at once: joined strings are as large as these texts
                to = max(at + 1, int(np.searchsorted(ends, begin[at] + (1 << 19), side="right")))
                own = codes[begin[at] : ends[to - 1]]
                edges = np.append(begin[at:to], ends[to - 1]) - begin[at]
                n += np.diff(np.concatenate(([0], np.cumsum(pieces[own])))[edges]).tolist()
                own, places = pa.array(own), pa.array(edges.astype(np.int32))
                for out, items, mark in ((a, shown, ","), (b, text, "")):
                    lines = pc.binary_join(pa.ListArray.from_arrays(places, items.take(own)), mark).to_pylist()
                    lines = lines if mark else [x[1:] for x in lines]
                    out += ([[int(y) for y in x.split(",") if y] for x in lines] if mark else lines) if full else [hashlib.sha256(x.encode()).hexdigest() for x in lines]
                at = to
        kept = pa.concat_arrays(rows)
        trim()
        if full:
            return pa.Table.from_arrays([kept, pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.string())], names=["kept", "ids", "decoded"])
        return pa.Table.from_arrays([kept, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["kept", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, keep: list[str], model: str | None = None, full: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, ids_sha256 and decoded_sha256 of ``text``, or with ``full`` its ids and decoded text."""
    spark = docs.sparkSession
    share_code(spark)
    raw = spark.sparkContext.broadcast(check_model(model or default_model()))
    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    kind = rows.schema["kept"].dataType.simpleString()
    name = f"lectern_blocks_{uuid.uuid4().hex}"
    coded = rows.mapInArrow(code_blocks(block_bytes), f"block long, kept array<{kind}>, ends binary, codes binary, words array<string>")
    # As many buckets as shuffle partitions at least, else Spark would shuffle the blocks after all.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), coded.rdd.getNumPartitions())
    coded.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    spread_over = SPREAD * max(1, blocks.count())
    entries = blocks.select("block", "words").mapInArrow(deal_entries(spread_over), ENTRIES)
    # A fixed number of partitions: rows are few and large in work, so they must not be merged by their size.
    answers = entries.repartition(spread_over, "bucket").sortWithinPartitions("bucket").mapInArrow(segment_buckets(raw), ANSWER)
    extra = "ids array<int>, decoded string" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    met = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined(full), f"kept {kind}, {extra}")
    out = materialize(met.select("kept.*", *(["ids", "decoded"] if full else ["n_tokens", "ids_sha256", "decoded_sha256"])), "encoded")
    drop_table(spark, name)
    return out


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    return encode(docs, ["doc_id"], model)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the public 32k BPE model."""
    return encode_documents(documents(spark, sf_dir))
