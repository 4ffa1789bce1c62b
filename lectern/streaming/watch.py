"""Watching folders: a stream that compares a folder's listing with the last one, and a registry of such streams.

A folder has no feed of its own on a shared file system, so each trigger lists it and what differs from the stored listing is
the change feed (created, modified and deleted files; a move is both).  The listing is a table in the watch's own folder, written by
batch number, so a repeated batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lectern.sources.files import scan
from lectern.streaming.changes import listing_diff

MOST_WATCHES = 10


@dataclass
class Watch:
    watch_id: str
    root: str
    query: StreamingQuery
    counts: dict[str, int]


class Watches:
    """Running watches by id: start, list, get, stop; ``MOST_WATCHES`` at most, one for each folder."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")
        self.held: dict[str, Watch] = {}

    def start(self, root: str, apply: Callable[[DataFrame], None], *, seconds: float = 5.0) -> Watch:
        """Call ``apply`` with the changes (source_path, action) of each trigger that has any."""
        self.list()
        if any(w.root == root for w in self.held.values()):
            raise ValueError(f"{root} is watched already")
        if len(self.held) >= MOST_WATCHES:
            raise RuntimeError(f"at most {MOST_WATCHES} watches run at once")
        ident = uuid.uuid4().hex[:12]
        base, counts = f"{self.state}/{ident}", {"upsert": 0, "delete": 0}
        empty = self.spark.createDataFrame([], "source_path string, checksum string")
        last: list[str] = []

        def batch(_: DataFrame, n: int) -> None:
            path = f"{base}/listing-{n}"
            scan(self.spark, root).select("source_path", "checksum").write.mode("overwrite").parquet(path)
            before = self.spark.read.parquet(last[0]) if last else empty
            found = listing_diff(before, self.spark.read.parquet(path))
            some = found.groupBy("action").agg(F.count("*").alias("n")).collect()  # two actions
            if some:
                apply(found)
            for r in some:
                counts[r.action] += r.n
            last[:] = [path]

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        query = ticks.writeStream.foreachBatch(batch).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").option("checkpointLocation", f"{base}/checkpoint").start()
        self.held[ident] = Watch(ident, root, query, counts)
        return self.held[ident]

    def list(self) -> list[Watch]:
        """Watches that run; ended ones leave the registry."""
        self.held = {k: w for k, w in self.held.items() if w.query.isActive}
        return list(self.held.values())

    def get(self, watch_id: str) -> Watch:
        return self.held[watch_id]

    def stop(self, watch_id: str) -> None:
        self.held.pop(watch_id).query.stop()
