"""Operator 3: exact top-k search with MaxScore over postings.

Vectors hold integers; a dimension is a term: a vector is posted under it with its signed component unless that is zero.  A
shard is a block of ``SHARD`` vectors with its inverted index: for every term the numbers of its vectors, their components, the
largest and the least of them.  A list that holds more than one in ``DENSE`` of the shard's vectors is stored as a column, the others
as sorted pairs.  The index is built once, when shards are written to the shared folder.

A term's bound for a query is the most that it can add: its weight times the largest (of a negative weight: the least)
component of the shard, zero at least.  For each query and shard:

1. terms are ordered by bound; the least ones whose bounds add up to less than the threshold (the query's k-th score so
   far) are non-essential: a vector that is in none of the other lists can't enter the result;
2. the postings of the essential terms are traversed, and no others;
3. vectors whose sum and the bounds left reach the threshold are candidates.  They are probed in the remaining terms, the
   largest first, and leave as soon as their sum and what is left of the bounds stay below the threshold (ties stay in, since
   a smaller vec_id wins them).

Thresholds carry over from shard to shard of a group (about ``GROUP`` shards, so the number of groups grows with the table).  A task
holds the shards of one group and streams all blocks of queries past them; a window with a partial limit merges the k best of each group.
Queries against all rows is the stated task: only the (50 times smaller) queries are copied, once for each group.

A row is itself, whatever its vec_id: a query leaves out its own row alone, repeated rows are candidates like any others, and
rows that repeat a query's vec_id are queries of their own with results each.  Vectors that are null or hold a null or
non-finite component take no part; vectors of different lengths are compared over the shorter one (components that are
absent are zero).  Components beyond a long saturate; sums that may leave 52 bits are done in unbounded integers, and scores saturate.
An empty table gives an empty result, rows without vec_id take no part, extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialize, share_code, table

SCALE, TOP, EVERY, SHARD, BLOCK, GROUP, DENSE = 256, 5, 50, 4096, 512, 2, 4
PACKED = "ids binary, rows binary, dims int, dense binary, columns binary, first binary, at binary, size binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
KINDS = [pa.int32() if x.endswith("int") else pa.binary() for x in PACKED.split(", ")]
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v array<long>) of the rows whose vector is complete and finite; ``row`` tells rows apart once written."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, vec_ids and the vectors as one matrix, shorter ones filled with zeros."""
    rows, ids = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "vec_id"))
    lists = batch.column("v")
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return rows, ids, out


class Shard:
    """Postings of some vectors, by dimension: ``dense`` numbers the lists kept as ``columns`` (-1: pairs of ``at`` and ``size``)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, dense: np.ndarray, columns: np.ndarray, first: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.ids, self.rows, self.dims, self.dense, self.first, self.at, self.size = ids, rows, len(dense), dense, first, at, size
        self.columns = columns.reshape(-1, len(ids)) if len(ids) else columns.reshape(0, 0)
        ends = [(0, 0)] * self.dims
        for d in range(self.dims):
            values = self.columns[dense[d]] if dense[d] >= 0 else size[first[d] : first[d + 1]]
            ends[d] = (int(values.max(initial=0)), int(values.min(initial=0)))
        self.most, self.least = [x for x, _ in ends], [x for _, x in ends]
        self.floats = self.columns.astype(np.float64)

    @classmethod
    def of(cls, rows: np.ndarray, ids: np.ndarray, data: np.ndarray) -> Shard:
        n, dims = data.shape
        many = (data != 0).sum(axis=0) * DENSE > n
        dense = np.where(many, np.cumsum(many) - 1, -1)
        term, at = np.nonzero(np.where(many, 0, data).T)
        first = np.searchsorted(term, np.arange(dims + 1))
        return cls(ids, rows, dense.astype(np.int32), np.ascontiguousarray(data.T[many]), first.astype(np.int64), at.astype(np.int32), data.T[term, at])

    def pack(self) -> list:
        return [self.ids.tobytes(), self.rows.tobytes(), self.dims, self.dense.tobytes(), self.columns.tobytes(), self.first.tobytes(), self.at.tobytes(), self.size.tobytes()]

    @classmethod
    def unpack(cls, ids: bytes, rows: bytes, dims: int, dense: bytes, columns: bytes, first: bytes, at: bytes, size: bytes) -> Shard:
        long = lambda x: np.frombuffer(x, np.int64)
        return cls(long(ids), long(rows), np.frombuffer(dense, np.int32), long(columns), long(first), np.frombuffer(at, np.int32), long(size))

    def length(self, term: int) -> int:
        return len(self.ids) if self.dense[term] >= 0 else int(self.first[term + 1] - self.first[term])

    def traverse(self, term: int, weight, part: np.ndarray) -> None:
        """Add a list's contributions to the sums of all vectors."""
        column = self.dense[term]
        if column >= 0:
            part += (self.floats if part.dtype == np.float64 else self.columns.astype(object))[column] * weight
        else:
            a, b = self.first[term], self.first[term + 1]
            part[self.at[a:b]] += self.size[a:b].astype(part.dtype) * weight

    def probe(self, term: int, weight, at: np.ndarray, kind) -> np.ndarray:
        """A list's contributions to the vectors ``at``: a look-up in a column, a binary search in pairs."""
        column = self.dense[term]
        if column >= 0:
            return (self.floats[column][at] if kind == np.float64 else self.columns[column][at].astype(object)) * weight
        found, size = self.at[self.first[term] : self.first[term + 1]], self.size[self.first[term] : self.first[term + 1]]
        if not len(found):
            return np.zeros(len(at), kind)
        spot = np.minimum(np.searchsorted(found, at), len(found) - 1)
        return np.where(found[spot] == at, size[spot], 0).astype(kind) * weight

    def search(self, query: list[int], own: int, k: int, best: list[tuple[int, int]], seen: Counter | None = None) -> list[tuple[int, int]]:
        """The k best (-score, vec_id) of ``best`` and this shard's rows for a query vector; ``own`` is its row.

        seen: counts essential postings traversed, postings that a full traversal would take, and probes.
        """
        terms = []
        room = 0
        for d, w in enumerate(query[: self.dims]):
            if w:
                terms.append((max(w * self.most[d], w * self.least[d], 0), d, w))
                room += abs(w) * max(self.most[d], -self.least[d])
        terms.sort()
        kind = np.float64 if room < 1 << 52 else object  # whole numbers either way
        threshold = -best[-1][0] if len(best) == k else None
        cut = left = 0
        if threshold is not None:
            while cut < len(terms) and left + terms[cut][0] < threshold:  # non-essential
                left += terms[cut][0]
                cut += 1
        part = np.zeros(len(self.ids), kind)
        for _, d, w in terms[cut:]:
            self.traverse(d, w, part)
        if seen is not None:
            seen["traversed"] += sum(self.length(d) for _, d, _ in terms[cut:])
            seen["all"] += sum(self.length(d) for _, d, _ in terms)
        alive = self.rows != own
        if threshold is not None:
            alive &= (part >= threshold - left).astype(bool)
        at = np.flatnonzero(alive)
        total = part[at]
        for bound, d, w in reversed(terms[:cut]):
            if not len(at):
                break
            total = total + self.probe(d, w, at, kind)
            left -= bound
            if seen is not None:
                seen["probed"] += len(at)
            fine = (total >= threshold - left).astype(bool)
            at, total = at[fine], total[fine]
        if len(at) > 4 * k:  # all ties with the k-th stay
            fine = total >= np.partition(total, len(total) - k)[len(total) - k]
            at, total = at[fine], total[fine]
        return sorted(best + [(-int(s), int(i)) for s, i in zip(total, self.ids[at])])[:k]


def _packed(items: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items), KINDS)], names=NAMES)


def pack(rows: int):
    """Batches of (row, vec_id, v) to shards of ``rows`` vectors."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), rows):
                yield _packed([Shard.of(*_matrix(batch.slice(lo, rows))).pack()])

    return run


def pack_queries(rows: int):
    """Batches of (row, vec_id, v) to blocks of ``rows`` vectors, in a shard's columns."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), rows):
                own, ids, data = _matrix(batch.slice(lo, rows))
                yield _packed([[ids.tobytes(), own.tobytes(), data.shape[1], b"", data.tobytes(), b"", b"", b""]])

    return run


def search_groups(k: int):
    """Rows sorted by group, shards before blocks of queries, to the k best of each query in each group."""

    def run(batches):
        shards: list[Shard] = []
        of = None
        for batch in batches:
            for group, kind, *packed in zip(*(batch.column(c).to_pylist() for c in ("group", "kind", *NAMES))):
                if group != of:
                    of, shards = group, []
                if kind == 0:
                    shards.append(Shard.unpack(*packed))
                    continue
                ids, rows = np.frombuffer(packed[0], np.int64), np.frombuffer(packed[1], np.int64)
                vectors = np.frombuffer(packed[4], np.int64).reshape(len(ids), packed[2]).tolist()
                out: list[tuple[int, int, int, int]] = []
                for query, row, vector in zip(ids.tolist(), rows.tolist(), vectors):
                    best: list[tuple[int, int]] = []
                    for shard in shards:
                        best = shard.search(vector, row, k, best)
                    out += [(row, query, i, max(LEAST, min(MOST, -s))) for s, i in best]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_row, query_id, rank, vec_id and score of the k best of ``rows`` (row, vec_id, v) for each of ``queries`` (alike), its own row left out."""
    share_code(rows.sparkSession)
    shards = materialize(rows.mapInArrow(pack(SHARD), PACKED).withColumn("number", F.monotonically_increasing_id()), "shards")
    groups = max(1, -(-shards.count() // GROUP))
    dealt = shards.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), *NAMES)
    asked = queries.mapInArrow(pack_queries(BLOCK), PACKED).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *NAMES)
    # As many partitions as groups: rows are few and work is much, so partitions must not be merged by size.
    met = dealt.unionByName(asked).repartition(2 * groups, "group").sortWithinPartitions("group", "kind")
    found = met.mapInArrow(search_groups(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every query vector."""
    rows = materialize(whole_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    out = materialize(top_k(rows, rows.where(F.col("vec_id") % EVERY == 0)).select("query_id", "rank", "vec_id", "score"), "top")
    discard(rows)
    return out


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.n <> q.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
