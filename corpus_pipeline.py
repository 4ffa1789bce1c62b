"""The corpus pipeline: quality rules, near-duplicates, secret scans, mixture, encoding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its predecessor kept; ``run`` writes every
result as Parquet in the shared folder and reads it again as the next stage's ``docs``.

All stages take nulls in any column, texts of any length, repeated rows, no rows at all, and further columns whatever their names.
All but the last return the columns of ``docs``; what happens to awkward rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, near, ngram, pieces, secrets
from lectern.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands.

    Null and empty texts fail the base rules and go; a null language is judged as ``und``; repeated rows share their verdict and count once in the bands.
    """
    return ngram.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of near-duplicates: Jaccard similarity 0.8 or more of five-word shingles.

    Texts without a word are copies of each other.  Of rows that repeat a doc_id one stays; null doc_ids come after all others.
    """
    return near.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text.  A null text stays null, its n_chars too."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights take from one epoch, nine tenths of all tokens at most.

    A null language or source counts as the name ``none``; a text without words has no tokens and is taken if its place lies within its leaf's prefix.
    Rows that repeat a doc_id are taken or left together.
    """
    return mixing.mix_documents(docs, share=(9, 10), epochs=1).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the token count and hashes of the encoded text; a null text is empty, repeated rows have a row each."""
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secret scans", redact_secrets), ("mixture", mixture), ("encoding", encode)]
#: SQL expresses neither the language model nor the encoder; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
