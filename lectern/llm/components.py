"""Connected components of an edge table, by alternating large and small stars.

Each round maps an edge table to one with the same components and ends when nothing changes (a logarithmic
number of rounds in practice).  Rounds are joins and grouped minima on node ids; every round's edges are
written to the shared folder, so neither lineage nor the driver grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))
    met = met.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
    return met.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a > b, integers); the root is the least node of its component."""
    edges = materialize(edges.select("a", "b"), "edges")
    seen = _mark(edges)
    while True:
        edges = materialize(_small(materialize(_large(edges), "large")), "small")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
