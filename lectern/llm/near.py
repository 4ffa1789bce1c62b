"""The pipeline's near-duplicates: five-word shingles, Jaccard similarity of ``SIMILAR`` or more, verified.

A text is lower-cased (A-Z) and cut into words and 5-word shingles, a set of 64-bit hashes (fewer than 5 words: the whole
sequence is the one shingle).  Texts with equal sets are one node, whatever their copies.

First, operator 6's method: the hashes of a node vote on a SimHash fingerprint, and the balls of the distinct fingerprints meet in the
middle, so nodes whose fingerprints differ in 2 bits or less are linked if their sets are similar (``ball_pairs``).  Most near copies
are joined here, and none of their pairs is compared again.

Pairs at 0.8 differ in 3 to 11 bits, more than balls can reach, so the rest comes from bands: each node has ``BANDS`` keys of
``ROWS`` minima each; two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99995 at 0.8.
Only this is approximate: a pair near 0.8 may be missed by balls and bands alike, and no pair below it is ever linked.

The nodes of a key that balls left apart are first compared with one of them (its hub, another for every key, so that large groups take a linear
number of comparisons), by true similarity of their whole sets.  Nodes of one key that are still in different components
are then all held against each other, so no candidate pair is left out for the sake of a hub: pair by pair in keys of up to ``FEW``
nodes, by their distances from a common centre in larger ones (``crowd_pairs``), where almost all pairs are ruled out before they are made.

Null and empty texts have the empty set, one node.  Of each component the row with the least non-null doc_id stays (repeated
ids: the least text hash); extra columns stay, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import discard, materialize, share_code
from lectern.llm.components import components

SHINGLE, BANDS, ROWS, STEP = 5, 25, 5, 1 << 12
FEW, ROUNDS = 8, 4
SIMILAR = (4, 5)
_MUL, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_FACTORS = (np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 bytes; ``lower`` and ``split`` of bytes know ASCII only, as wanted."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    s = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(len(words), SHINGLE)):
        s = (s ^ s >> _SHIFT) * _MUL + words[k : k + n]
    s = (s ^ s >> _SHIFT) * _MUL
    return np.unique(s ^ s >> np.uint64(32))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none of an empty one."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[None, at : at + STEP] * _FACTORS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _MUL
        key ^= key >> _SHIFT
    return key


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles; 0 of an empty one."""
    return simhash.majority((hashes[at : at + simhash.STEP].astype(">u8").tobytes() for at in range(0, len(hashes), simhash.STEP)), len(hashes))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def node_column(text: Column) -> Column:
    """Struct of the node (hash of the set of shingles), its fingerprint and the band keys of ``text``."""

    def run(batch: pa.Array) -> pa.Array:
        raw, nodes, prints, keys = batch.cast(pa.binary()), [], [], []
        for i in range(len(raw)):
            hashes = shingles(raw[i].as_py() or b"")
            nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
            prints.append(fingerprint(hashes))
            keys.append(band_keys(hashes))
        longs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints))
        return pa.StructArray.from_arrays([*longs, _lists(keys)], ["node", "fp", "keys"])

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "node long, fp long, keys array<long>")(text)


def set_column(text: Column) -> Column:
    """The set of shingles of ``text``."""

    def run(batch: pa.Array) -> pa.Array:
        raw = batch.cast(pa.binary())
        return _lists([shingles(raw[i].as_py() or b"") for i in range(len(raw))])

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<long>")(text)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, hashes) have a similarity of ``SIMILAR`` or more."""
    p, q = SIMILAR
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    x, y = F.size("x"), F.size("y")
    met = met.where((q * x >= p * y) & (q * y >= p * x))
    return met.where((p + q) * F.size(F.array_intersect("x", "y")) >= p * (x + y)).select("a", "b")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a > b) of ``nodes`` (node, fp): those of one fingerprint with its least node, and least nodes of fingerprints that the balls link."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "near-prints")
    same = nodes.join(prints.where("n > 1").withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("node <> least").select("node", "least")
    met = simhash.links(prints.select("fp"))
    for end in ("a", "b"):
        met = met.join(prints.select(F.col("fp").alias(f"{end}_fp"), F.col("least").alias(f"{end}_node")), F.col(end) == F.col(f"{end}_fp"))
    both = same.union(met.select("a_node", "b_node")).toDF("x", "y")
    pairs = materialize(both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "near-balls")
    discard(prints)
    return pairs


def sets_of(wanted: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, hashes) of the ``wanted`` (node, lectern_at)."""
    return materialize(wanted.join(marked.select("lectern_at", "text"), "lectern_at").select("node", set_column(F.col("text")).alias("hashes")), "near-sets")


def close_links(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """The links (a, b) that SimHash finds, verified by whole sets."""
    pairs = ball_pairs(nodes.select("node", "fp"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(nodes.select("node", "lectern_at").join(ends, "node"), marked)
    links = materialize(verified(pairs, sets), "near-links")
    discard(pairs, sets)
    return links


def crowds(part: DataFrame) -> DataFrame:
    """(crowd, node, root) of the ``part`` (key, node, root) of crowded keys; keys with the same largest component are one crowd, so a node is there once."""
    size = part.groupBy("key", "root").agg(F.count("*").alias("n"))
    named = size.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("crowd"))
    return part.join(named, "key").select("crowd", "node", "root").distinct()


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``members`` of crowds with diff, what their sets have and their crowd's centre has not or the reverse, size and slack.

    The centre is the set of all shingles that over half of the members have: fewer than twice a member's mean number.
    """
    p, q = SIMILAR
    held = materialize(members.join(sets, "node"), "near-members")
    count = held.select("crowd", F.explode("hashes").alias("hash")).groupBy("crowd", "hash").agg(F.count("*").alias("n"))
    whole = held.groupBy("crowd").agg(F.count("*").alias("members"))
    centre = count.where("n > 1").join(whole, "crowd").where("2 * n > members").groupBy("crowd").agg(F.collect_list("hash").alias("centre"))
    met = held.join(centre, "crowd", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    diff = F.concat(F.array_except("hashes", "centre"), F.array_except("centre", "hashes"))
    met = met.select("crowd", "node", "root", F.size("hashes").cast("long").alias("size"), diff.alias("diff")).withColumn("off", F.size("diff").cast("long"))
    out = materialize(met.withColumn("slack", (q - p) * F.col("size") - (p + q) * F.col("off")), "near-diffs")
    discard(held)
    return out


def crowd_pairs(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between ``members`` (crowd, node, root), and pairs of different components that may be linked: together they miss no similar pair of a crowd.

    With differences D from any set whatever, x and y differ in ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` shingles, and they are similar if that is at most
    ``(q - p) / (p + q)`` of ``|x| + |y|``.  In terms of the slack ``(q - p) |x| - (p + q) |D(x)|``:

    * two slacks of a sum of 0 or more make a link, whatever D have in common.  The member of most slack has such a link with each member that has one at all.
    * other pairs need common differences.  With each D in one order, the rarest first, the first common one can stand at place i of D(x) and j of D(y)
      only if ``2 (p + q) i - (p + q) |D(x)| - (q - p) |x|``, what the place needs, is at most y's slack, and the same with x and y exchanged.

    Places that need more slack than any node of another component has at the same difference are dropped, round by round: what one round drops lowers the most
    slack of the next.  Only the places that are left are joined.  Far fewer than pairs, as a node's own changes stand first and use its need up.
    """
    p, q = SIMILAR
    diffs = differences(members, sets)
    best = diffs.groupBy("crowd").agg(F.max(F.struct("slack", "node", "root")).alias("best"))
    met = diffs.join(best, "crowd").withColumn("joined", F.expr("slack + best.slack >= 0"))
    sure = met.where("joined and node <> best.node").select(F.greatest("node", "best.node").alias("a"), F.least("node", "best.node").alias("b")).distinct()
    met = met.withColumn("label", F.expr("if(joined, best.root, root)"))
    at = W.partitionBy("crowd", "hash")
    places = met.select("crowd", "node", "label", "slack", "off", "size", F.explode("diff").alias("hash")).withColumn("n", F.count("*").over(at)).where("n > 1")
    mine = W.partitionBy("crowd", "node")  # differences of one node alone come first and meet none
    i = F.col("off") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("n", "hash")) - 1
    places = places.withColumn("need", 2 * (p + q) * i - (p + q) * F.col("off") - (q - p) * F.col("size")).select("crowd", "hash", "node", "label", "slack", "need")
    for _ in range(ROUNDS):
        places = places.withColumn("top", F.max(F.struct("slack", "label")).over(at)).withColumn("next", F.max(F.expr("if(label <> top.label, slack, null)")).over(at))
        places = places.where("need <= if(label = top.label, next, top.slack)").drop("top", "next")
    places = materialize(places, "near-places")
    x, y = (places.select("crowd", "hash", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "label", "slack", "need"))) for end in "ab")
    met = x.join(y, ["crowd", "hash"]).where("node_a > node_b and label_a <> label_b and need_a <= slack_b and need_b <= slack_a")
    return sure, met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_components(marked: DataFrame) -> DataFrame:
    """(node, root) of every node of ``marked`` (lectern_at, text, lectern_near) that has a near-duplicate."""
    near = F.col("lectern_near")
    nodes = marked.groupBy(near["node"].alias("node")).agg(F.min("lectern_at").alias("lectern_at"), F.first(near["fp"]).alias("fp"), F.first(near["keys"]).alias("keys"))
    nodes = materialize(nodes, "near-nodes")
    close = close_links(nodes, marked)
    joined = components(close)
    keys = nodes.select("node", "lectern_at", F.explode("keys").alias("key"))
    turn = F.xxhash64("key")  # the hub is the least node in an order of its own for every key
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(turn)).alias("hub")).where("n > 1")
    crowded = materialize(keys.join(shared.select("key", F.col("hub").bitwiseXOR(turn).alias("hub")), "key"), "near-keys")
    star = crowded.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    for end in ("a", "b"):  # pairs that balls have joined need no comparison
        star = star.join(joined.select(F.col("node").alias(f"{end}_node"), F.col("root").alias(f"{end}_root")), F.col(end) == F.col(f"{end}_node"), "left")
    star = materialize(star.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b"), "near-pairs")
    wanted = crowded.groupBy("node").agg(F.min("lectern_at").alias("lectern_at"))
    sets = sets_of(wanted, marked)
    links = materialize(close.union(verified(star, sets)), "near-links")
    root = components(links)
    part = crowded.select("key", "node").join(root.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    part = materialize(part, "near-parts")
    apart = part.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    part = materialize(part.join(apart, "key"), "near-apart")
    few = part.where(F.col("n") <= FEW).select("key", "node", "root")
    other = few.select("key", F.col("node").alias("b"), F.col("root").alias("other"))
    cross = few.withColumnRenamed("node", "a").join(other, "key").where("a > b and root <> other").select("a", "b")
    crowded = materialize(crowds(part.where(F.col("n") > FEW).select("key", "node", "root")), "near-crowds")
    more = root.sparkSession.createDataFrame([], "a long, b long")
    if not crowded.isEmpty():
        more, pairs = crowd_pairs(crowded, sets)
        cross = cross.union(pairs)
    cross = materialize(cross.distinct().join(star, ["a", "b"], "left_anti"), "near-cross")
    more = materialize(more.union(verified(cross, sets)), "near-links")
    return root if more.isEmpty() else components(links.union(more))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that with the least doc_id; all columns stay, whatever their names."""
    share_code(docs.sparkSession)
    names = docs.columns
    text, ident = (F.col(f"c{names.index(c)}") for c in ("text", "doc_id"))
    marked = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("lectern_near", node_column(text)).withColumn("lectern_at", F.monotonically_increasing_id())
    marked = materialize(marked, "near-documents")
    root = near_components(marked.select("lectern_at", text.alias("text"), "lectern_near"))
    rows = marked.select("lectern_at", ident.alias("doc_id"), F.xxhash64(text).alias("h"), F.col("lectern_near")["node"].alias("n"))
    rows = rows.join(root, F.col("n") == F.col("node"), "left").select(F.coalesce("root", "n").alias("root"), F.struct(F.col("doc_id").isNull(), "doc_id", "h", "lectern_at").alias("first"))
    kept = materialize(rows.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first")["lectern_at"].alias("lectern_kept")), "kept")
    # The rows that stay grow with the table, so they are never broadcast, however small a table's are.
    return marked.join(kept.hint("merge"), F.col("lectern_at") == F.col("lectern_kept")).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
