"""Operator 6: SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words and 3-word shingles; each shingle votes with its XXH64 on 64
bits.  Two fingerprints at distance 2 or less have a common variant within distance 1, so each *distinct*
fingerprint emits itself and its 64 one-bit variants (65 rows a fingerprint, whatever its copies) and the
shuffle on the variant brings every linked pair together.  The fingerprints at one variant are at most 65
and each is linked to the least of them, so links are linear in the rows and no link between different
fingerprints loses its component.  Links are deduplicated and verified by their distance before components
are formed.

Copies collapse to one fingerprint before any of this, so a hot text costs one row.  Null and empty texts
have fingerprint 0, linked like any other.  Fewer than 3 words: the whole sequence is the one shingle.
``component_id`` is the least non-null doc_id of the component (null if there is none).  Extra columns are
ignored; an empty table gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialize, share_code
from lectern.llm.components import components

SHINGLE, SEED, RADIUS, STEP = 3, 42, 2, 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_CELLS = (np.arange(8, dtype=np.int64) * 256)[None, :]


def majority(parts, n: int) -> int:
    """The fingerprint of ``n`` 64-bit hashes, given as big-endian bytes in parts: a bit is 1 if set in over half of them."""
    votes = np.zeros(64, np.int64)
    for part in parts:
        cells = np.frombuffer(part, np.uint8).reshape(-1, 8) + _CELLS
        votes += (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    """Fingerprint of UTF-8 bytes; ``lower`` and ``split`` of bytes know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    pairs = list(zip(starts[:n].tolist(), ends[-n:].tolist()))
    digest = xxhash.xxh64_digest
    return majority((b"".join([digest(joined[a:b], SEED) for a, b in pairs[at : at + STEP]]) for at in range(0, n, STEP)), n)


def fingerprints(texts: pa.Array) -> pa.Array:
    raw = texts.cast(pa.binary())
    out = np.fromiter((fingerprint(raw[i].as_py() or b"") for i in range(len(raw))), np.uint64, len(raw))
    return pa.array(out.view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of ``text`` as the signed long with its bits."""

    def run(batch: pa.Array) -> pa.Array:
        return fingerprints(batch)

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(text)


def links(prints: DataFrame) -> DataFrame:
    """Verified links (a > b, as signed longs) between the distinct values of ``prints.fp`` at distance ``RADIUS`` or less."""
    ball = prints.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("variant"))
    hub = F.min("fp").over(W.partitionBy("variant"))
    met = ball.select("fp", hub.alias("b")).where("fp <> b")
    return met.distinct().where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= RADIUS).select(F.col("fp").alias("a"), "b")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp) as (fp, component_id), one row for each fingerprint."""
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "prints")
    root = components(links(first.select("fp")))
    named = first.join(root, first.fp == root.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    return named.select("fp", F.col("root").alias("r")).join(least, F.col("r") == F.col("root")).select("fp", "component_id")


def simhash_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text)."""
    share_code(docs.sparkSession)
    rows = materialize(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "fingerprints")
    named = near_duplicates(rows).withColumnRenamed("fp", "f")
    return rows.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id; all columns stay."""
    share_code(docs.sparkSession)
    spark = docs.sparkSession
    rows = materialize(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "fingerprints")
    named = near_duplicates(rows).withColumnRenamed("fp", "f")
    kept = rows.join(named, F.col("fp") == F.col("f")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(kept.groupBy(F.col("doc_id").alias("simhash_kept_id")).agg(F.count("*").alias("simhash_kept_rows")), "kept")
    # The ids that stay grow with the table, so they are never broadcast, however small a table's are.
    met = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(F.col("simhash_kept_id")))
    once = met.where("simhash_kept_rows = 1")
    if kept.where("simhash_kept_rows > 1").isEmpty():  # repeated doc_ids are rare: only their rows are sorted
        return once.select(docs.columns)
    again = met.where("simhash_kept_rows > 1").withColumn("simhash_kept_n", F.row_number().over(W.partitionBy("simhash_kept_id").orderBy(F.xxhash64("text"))))
    return once.select(docs.columns).union(again.where("simhash_kept_n = 1").select(docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_documents(documents(spark, sf_dir))
