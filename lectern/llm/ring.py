"""Operator 8: sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 32-bit ring; a key belongs to the arc that ends at the next
point clockwise.  A shard has room for a fixed number of rows (``floor`` or ``ceil`` of the mean, the
capacities adding up to the row count), so the law ``rows`` holds: shard counts differ by one at most.
Keys of an arc are ordered by their ring position.  A shard keeps the leading keys of its own arcs and
the rest of an arc continues clockwise to the next shards that still have room.

All of it is DataFrame work.  What reaches the driver is one count for each arc
(``shards * vnodes`` numbers, a parameter, whatever the data); the overflow is settled on these counts
and comes back as a table of arc segments, at most ``shards * vnodes * 2 + shards`` rows.  A key's rank in its arc is its rank among
the keys of the arc in one of 2^``CELL_BITS`` cells of the ring, plus the arc's count in earlier cells (at most 2^``CELL_BITS`` +
``shards * vnodes`` rows, broadcast), so no task sorts a whole arc.

Movement: one more shard takes an even share of the rows; beyond that, rows move where the rooms of others shrink and overflow shifts.

Repeated rows: equal (doc_id, size, checksum) rows are first counted, split into chunks of
``CHUNK`` copies with ring positions of their own, and expanded again at the end, so that a key that holds
a third of all rows is spread over the ring.  Null text: no bytes, checksum of the empty string.
Null doc_id: a key like any other.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialize

SHARDS, VNODES, CHUNK, CELL_BITS = 24, 64, 4096, 14
RING = 1 << 32


def point(shard: int, vnode: int) -> int:
    """Ring position of a virtual node: 32 bits of an integer mix, the same on every driver."""
    x = (shard * 0x9E3779B97F4A7C15 + vnode * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (1 << 64) - 1
    for mul in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * mul & (1 << 64) - 1
    return (x ^ x >> 33) >> 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    return sorted({point(s, v): s for s in range(shards) for v in range(vnodes)}.items())


def settle(owner: list[int], count: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot) for arcs with these owners and row counts.

    Own keys come first: a shard takes its arcs clockwise until it is full.  Then each arc's excess goes
    clockwise, arc by arc from the ring's start, to the next shards with room.
    """
    total = sum(count)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, left, out = [0] * shards, [], []

    def put(arc: int, first: int, n: int, shard: int) -> None:
        out.append((arc, first, first + n, shard, used[shard]))
        used[shard] += n

    for arc, n in enumerate(count):
        own = min(n, room[owner[arc]] - used[owner[arc]])
        if own:
            put(arc, 0, own, owner[arc])
        left.append((own, n - own))
    for arc, (first, n) in enumerate(left):
        step = arc
        while n:
            step = (step + 1) % len(owner)
            shard = owner[step]
            if take := min(n, room[shard] - used[shard]):
                put(arc, first, take, shard)
                first, n = first + take, n - take
    return out


def arc_of(position: Column, points: list[int]) -> Column:
    """Index of the first point at or after ``position``, round the ring."""
    # A high byte picks the slice of the ring, a sorted array holds the points within it.
    cells = [[] for _ in range(256)]
    for p in points:
        cells[p >> 24].append(p)
    starts = [bisect.bisect_left(points, i << 24) for i in range(256)]
    starts_sql = F.expr(f"array({', '.join(map(str, starts))})")
    cells_sql = F.expr("array(" + ", ".join(f"cast(array({', '.join(f'{p}L' for p in c)}) as array<bigint>)" for c in cells) + ")")
    cell = F.shiftright(position, 24).cast("int") + 1
    below = F.size(F.filter(F.element_at(cells_sql, cell), lambda p: p < position))
    return ((F.element_at(starts_sql, cell) + below) % len(points)).cast("int")


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) as doc_id, size, text_crc32, shard, slot; see the module's docstring."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    points = ring(shards, vnodes)
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    keys = (
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK).cast("int"))))
        .withColumn("n", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK))
        .withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32", "chunk"))
    )
    keys = materialize(
        keys.withColumn("arc", arc_of(F.col("hash").bitwiseAND(RING - 1), [p for p, _ in points])).drop("copies"), "ring-keys"
    )
    keys = keys.withColumn("cell", F.shiftright(F.col("hash").bitwiseAND(RING - 1), 32 - CELL_BITS).cast("int"))
    cells = materialize(keys.groupBy("arc", "cell").agg(F.sum("n").alias("in_cell")), "ring-cells")
    count = [0] * len(points)
    for r in cells.groupBy("arc").agg(F.sum("in_cell").alias("n")).collect():  # one row for each arc: shards * vnodes at most
        count[r.arc] = r.n
    segments = spark.createDataFrame(
        settle([s for _, s in points], count, shards), "arc int, first long, end long, shard int, slot0 long"
    )
    order = [F.col("hash").bitwiseAND(RING - 1), F.col("hash"), F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("chunk")]
    before = W.partitionBy("arc").orderBy(F.col("cell"))
    cells = cells.select(F.col("arc").alias("a"), F.col("cell").alias("c"), (F.sum("in_cell").over(before) - F.col("in_cell")).alias("earlier"))
    upto = F.sum("n").over(W.partitionBy("arc", "cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = keys.withColumn("in_cell", upto).join(F.broadcast(cells), (F.col("arc") == F.col("a")) & (F.col("cell") == F.col("c")))
    placed = placed.withColumn("last", F.col("earlier") + F.col("in_cell")).withColumn("start", F.col("last") - F.col("n"))
    placed = placed.join(F.broadcast(segments), "arc").where((F.col("start") < F.col("end")) & (F.col("last") > F.col("first")))
    lo, hi = F.greatest("start", "first"), F.least("last", "end")
    return placed.select(
        "doc_id", "size", "text_crc32", "shard",
        F.explode(F.sequence(F.col("slot0") + lo - F.col("first"), F.col("slot0") + hi - F.col("first") - 1)).alias("slot"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``."""
    out = shard_rows(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
