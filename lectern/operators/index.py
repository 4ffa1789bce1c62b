"""The inverted index as plain tables: postings by term bucket and document lengths.

``build`` derives them from (id, text) in one pass: a row counts its own tokens (sorted, then run lengths), so what is exploded and shuffled
is a document's distinct terms.  ``write`` stores postings by bucket, a hash of the term, sorted by term within a file: a query
reads the buckets of its terms (all of them if it has a prefix) and skips row groups by term.  A posting carries its document's length, so
no search meets the table of lengths but for the corpus totals.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions import text as T
from lectern.operators.search import idf, once, phrase_hits, term_score, text_columns
from lectern.plans.query import parse

#: SLICES: parts of a bucket that are written side by side.
BUCKETS, SLICES = 64, 16


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def run_lengths(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
    rows = lambda s: once(ends(s), lambda e: F.transform(e, lambda at, k: F.struct(F.get(s, at - 1).alias("term"), (at - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("tf"))))
    return once(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, rows(s)))


@dataclass
class Index:
    """postings (bucket, term, col, id, tf, length) and lengths (id, length); length counts the tokens of all columns."""

    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str) -> Index:
        tokens = docs.select(F.col(id_col).alias("id"), F.array(T.index_tokens(F.col(text_col)), T.words(T.expansion(F.col(text_col)))).alias("t"))
        sized = tokens.select("id", F.explode(F.array(F.struct((F.size(F.col("t")[0]) + F.size(F.col("t")[1])).alias("length"), F.transform("t", run_lengths).alias("cols")))).alias("x"))
        terms = sized.select("id", "x.length", F.posexplode("x.cols").alias("col", "runs")).select("id", "length", "col", F.explode("runs").alias("r"))
        postings = terms.select(F.pmod(F.crc32(F.encode("r.term", "UTF-8")), F.lit(BUCKETS)).cast("int").alias("bucket"), "r.term", "col", "id", "r.tf", "length")
        lengths = tokens.select("id", (F.size(F.col("t")[0]) + F.size(F.col("t")[1])).alias("length"))
        return cls(postings, lengths)

    def dealt(self) -> DataFrame:
        """Postings dealt and sorted for writing."""
        return self.postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SLICES))).sortWithinPartitions("bucket", "term", "id")

    def write(self, path: str) -> None:
        self.dealt().write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def match(self, query: str, docs: DataFrame, *, id_col: str, text_col: str, any_term: bool = False, two_columns: bool = True) -> DataFrame:
        """(id, score) of the documents that match, as ``search.bm25`` scores them.

        ``docs`` are only read for phrases of several tokens: those of its rows that hold all of a phrase's tokens are tokenised.
        """
        phrases = parse(query, any_term=any_term)
        if not phrases:
            return self.lengths.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
        columns = text_columns(text_col)[: 2 if two_columns else 1]
        weight = F.when(F.col("col") == 0, F.lit(columns[0][1])).otherwise(F.lit(columns[-1][1]))
        postings = self.postings if two_columns else self.postings.where("col = 0")
        parts = []
        for i, p in enumerate(phrases):
            if len(p.tokens) > 1:
                held = postings.where(F.col("bucket").isin([bucket_of(t) for t in p.tokens]) & F.col("term").isin(list(p.tokens)))
                ids = held.groupBy("id").agg(F.count_distinct("term").alias("k"), F.max("length").alias("length")).where(F.col("k") == len(set(p.tokens)))
                rows = docs.select(F.col(id_col).alias("d"), F.struct(*[c.alias(f"t{j}") for j, (c, _) in enumerate(columns)]).alias("t")).join(ids, F.col("d") == F.col("id"))
                f = sum((phrase_hits(F.col(f"t.t{j}"), p) * w for j, (_, w) in enumerate(columns)), F.lit(0.0))
                parts.append(rows.select("id", "length", F.lit(i).alias("i"), f.alias("f")).where("f > 0"))
                continue
            word = p.tokens[0]
            mine = F.col("term").startswith(word) if p.prefix else (F.col("bucket") == bucket_of(word)) & (F.col("term") == word)
            parts.append(postings.where(mine).select("id", "length", F.lit(i).alias("i"), (F.col("tf") * weight).alias("f")))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        n = len(phrases)
        hits = every.groupBy("id").agg(F.max("length").alias("length"), *[F.sum(F.when(F.col("i") == i, F.col("f")).otherwise(0.0)).alias(f"f{i}") for i in range(n)])
        totals = hits.agg(F.array(*[F.count_if(F.col(f"f{i}") > 0) for i in range(n)]).alias("n"))
        corpus = self.lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("average"))
        s = F.broadcast(totals.crossJoin(corpus))  # one row
        score = sum((term_score(idf(F.col("docs"), F.col("n")[i]), F.col(f"f{i}"), F.col("length"), F.col("average")) for i in range(n)), F.lit(0.0))
        if not any_term:
            for i in range(n):
                hits = hits.where(F.col(f"f{i}") > 0)
        return hits.crossJoin(s).select("id", score.alias("score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Top ``k`` of each row of ``queries`` (query_id, terms array<string>) by BM25 over both columns, any term matching.

        Query terms are distinct; documents meet queries through the postings of their terms alone.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int"))
        met = self.postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        f = F.sum(F.col("tf") * F.when(F.col("col") == 0, rules.TEXT_WEIGHT).otherwise(rules.EXPANSION_WEIGHT))
        used = met.groupBy("term", "id").agg(f.alias("f"), F.max("length").alias("length"))
        total = self.lengths.agg(F.struct(F.count("*").alias("docs"), F.avg("length").alias("average")).alias("s")).scalar()
        weight = used.groupBy("term").agg(F.count("*").alias("n")).select("term", idf(total["docs"], F.col("n")).alias("idf"))
        hits = used.join(weight, "term").select("term", "id", term_score(F.col("idf"), F.col("f"), F.col("length"), total["average"]).alias("part"))
        scored = hits.join(asked.select("query_id", "term"), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k)
