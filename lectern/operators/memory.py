"""Memories: recall, as-of, history, supersession, reinforcement and anchors.

A memory table is a current-state view (memory_id, content, memory_type, tags, metadata, pinned, source, confidence, access_count,
created_at, updated_at, last_accessed, valid_from, valid_to, superseded_id); revisions hold closed intervals [valid_from, valid_to).  Time
is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import ranking, rules
from lectern.functions import text as T
from lectern.operators.search import bm25, text_columns

#: BLOCK: most memories of a block of ``conflicts``, of all types.
BLOCK = 131_072


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def validated(memories: DataFrame) -> DataFrame:
    """Fails the job on an empty content, an unknown type or an unknown source."""
    fine = (F.trim(F.coalesce("content", F.lit(""))) != "") & F.col("memory_type").isin(*rules.MEMORY_TYPES) & F.coalesce(F.col("source").isin(*rules.MEMORY_SOURCES), F.lit(True))
    return memories.where(F.coalesce(F.assert_true(F.coalesce(fine, F.lit(False)), "content, memory_type or source is not valid").isNull(), F.lit(True)))


def event_age(metadata: Column, updated_at: Column, as_of: Column) -> Column:
    """Days since the date in the metadata (never below zero), else since the last update."""
    dated = F.try_to_timestamp(F.get_json_object(metadata, "$.date"), F.lit("yyyy-MM-dd"))
    return F.when(dated.isNotNull(), F.greatest(days_between(dated, as_of), F.lit(0.0))).otherwise(days_between(updated_at, as_of))


def live_confidence(as_of: Column) -> Column:
    since = days_between(F.coalesce("last_accessed", "created_at"), as_of)
    return ranking.confidence(F.col("confidence"), since, F.col("access_count"), F.col("pinned"))


def scoped(memories: DataFrame, *, memory_type: str | None = None, tags: list[str] | None = None, workspace: str | None = None) -> DataFrame:
    if memory_type:
        memories = memories.where(F.col("memory_type") == memory_type)
    for tag in tags or []:
        memories = memories.where(F.array_contains("tags", tag))
    return memories if workspace is None else memories.where(F.col("workspace_id") == workspace)


def gate(query: str, content: Column, fts: Column) -> Column:
    """Near the best hit, or two shared words; short and CJK queries pass."""
    best = F.max(fts).over(W.partitionBy(F.lit(0)))  # of a candidate window
    mine = T.token_set(F.lit(query))
    enough = F.size(F.array_intersect(mine, T.token_set(content))) >= rules.GATE_SHARED
    return (fts >= best * rules.GATE_SHARE) | F.lit(query).rlike(T.CJK) | content.rlike(T.CJK) | (F.size(mine) < rules.GATE_TERMS) | enough


def recall(memories: DataFrame, query: str, as_of, *, memory_type: str | None = None, tags: list[str] | None = None, workspace: str | None = None, limit: int = 10, offset: int = 0, threshold: float = rules.LEAST_CONFIDENCE, mode: str = "rrf", explain: bool = False) -> DataFrame:
    """The page of best memories: the lexical window, then confidence, gate and fusion, then the page.

    Columns beside those of ``memories``: fts, age_days, live_confidence, score, highlight (and explain).
    """
    when = F.lit(as_of).cast("timestamp")
    found = bm25(memories.where("valid_to is null"), query, text_columns("content"), any_term=True).withColumnRenamed("score", "fts")
    found = scoped(found, memory_type=memory_type, tags=tags, workspace=workspace)
    window = rules.WINDOW if offset + limit <= rules.WINDOW else rules.DEEP_WINDOW
    top = found.orderBy(F.desc("fts"), "memory_id").limit(window)
    top = top.withColumn("live_confidence", F.round(live_confidence(when), 4)).where(live_confidence(when) >= threshold)
    top = top.withColumn("gate_passed", gate(query, F.col("content"), F.col("fts"))).where("gate_passed").drop("gate_passed")
    top = top.withColumn("age_days", event_age(F.col("metadata"), F.col("updated_at"), when))
    intent = ranking.recency_intent(query)
    if mode == "rrf":
        top = top.withColumn("explain", ranking.fusion(F.col("fts"), F.col("age_days"), F.col("live_confidence"), F.col("pinned"), intent=intent))
        top = top.withColumn("score", ranking.significant(F.col("explain.score")))
    elif mode == "legacy":
        top = top.withColumn("score", ranking.significant(ranking.legacy(F.col("fts"), F.col("age_days"), F.col("live_confidence"), F.col("pinned"), intent=intent)))
    else:
        raise ValueError(f"unknown ranking mode: {mode}")
    top = top.withColumn("highlight", T.highlight(F.col("content"), query)).orderBy(F.desc("score"), "memory_id").offset(offset).limit(limit)
    return top if explain or mode == "legacy" else top.drop("explain")


def recall_totals(memories: DataFrame, query: str, *, memory_type: str | None = None, tags: list[str] | None = None, window: int = rules.WINDOW) -> DataFrame:
    """(total, truncated): matches in all, and whether the candidate window cuts them short; ``recall(...).count()`` is what survives ranking."""
    found = scoped(bm25(memories.where("valid_to is null"), query, text_columns("content"), any_term=True), memory_type=memory_type, tags=tags)
    return found.agg(F.count("*").alias("total"), (F.count("*") > window).alias("truncated"))


def pinned(memories: DataFrame, *, limit: int = 10, offset: int = 0, **scope) -> DataFrame:
    """Pinned memories, newest first, without a search."""
    return scoped(memories.where("pinned and valid_to is null"), **scope).withColumn("score", F.lit(1.0)).orderBy(F.desc("created_at"), "memory_id").offset(offset).limit(limit)


def list_memories(memories: DataFrame, *, limit: int = 50, offset: int = 0, **scope) -> DataFrame:
    return scoped(memories.where("valid_to is null"), **scope).orderBy(F.desc("pinned"), F.desc("created_at"), "memory_id").offset(offset).limit(limit)


def recall_as_of(memories: DataFrame, revisions: DataFrame, query: str, as_of, *, memory_type: str | None = None, limit: int = 10) -> DataFrame:
    """What was held true at ``as_of``: live rows by BM25 and revisions by shared words, best first."""
    when = F.lit(as_of).cast("timestamp")
    cols = ["memory_id", "content", "memory_type", "valid_from", "valid_to"]
    inside = (F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))
    live = scoped(bm25(memories, query, text_columns("content"), any_term=True), memory_type=memory_type).where(inside)
    live = live.orderBy(F.desc("score"), "memory_id").limit(limit * 3).select(*cols, "score", F.col("valid_to").isNull().alias("still_current"))
    old = scoped(revisions.where((F.col("valid_from") <= when) & (F.col("valid_to") > when)), memory_type=memory_type).orderBy(F.desc("valid_to"), "memory_id").limit(limit * 3)
    shared = F.size(F.array_intersect(T.token_set(F.lit(query)), T.token_set(F.col("content")))).cast("double")
    old = old.select(*cols, shared.alias("score"), F.lit(False).alias("still_current")).where("score > 0")
    return live.unionByName(old).orderBy(F.desc("score"), "memory_id", "valid_from").limit(limit)


def history(revisions: DataFrame, memory_id: str) -> DataFrame:
    """Versions of a memory and those it superseded, newest first."""
    return revisions.where((F.col("memory_id") == memory_id) | (F.col("superseded_by") == memory_id)).orderBy(F.desc("valid_from"), "memory_id")


def intervals(versions: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """A version log with valid_from, valid_to (null: current) and version number of each key."""
    own = W.partitionBy(key).orderBy(time, order)
    return versions.withColumn("valid_from", F.col(time)).withColumn("valid_to", F.lead(time).over(own)).withColumn("version", F.row_number().over(own))


def latest(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key, by a grouped maximum rather than a sort."""
    picked = F.max_by(F.struct(*versions.columns), F.struct(*order))
    return versions.groupBy(*key).agg(picked.alias("v")).select("v.*")


def reinforced(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Access counts and times brought up to date from an access log (memory_id, ts); updated_at stays."""
    log = accesses.groupBy(F.col("memory_id").alias("m")).agg(F.count("*").alias("more"), F.max("ts").alias("last"))
    met = memories.join(log, F.col("memory_id") == F.col("m"), "left")
    count = F.col("access_count") + F.coalesce("more", F.lit(0))
    return met.withColumn("access_count", count).withColumn("last_accessed", F.coalesce(F.greatest("last", "last_accessed"), F.col("last_accessed"))).drop("m", "more", "last")


def blocks(rows: int) -> int:
    """Parts of a side of a grid: four as soon as they aren't tiny, more only where a part would exceed BLOCK rows."""
    return max(-(-rows // BLOCK), min(4, 1 + rows // 2000))


def conflicts(new: DataFrame, live: DataFrame, *, base: float = 0.3) -> DataFrame:
    """(new_id, old_id, overlap): the live memory that each new one (memory_id, content, memory_type) would supersede.

    Copies count once: rows of one type, one set of words and one set of dates are a group.  Groups meet in a grid of blocks by type
    (``operators.overlap``), so pairs are never shuffled.  Ties: the least id.
    """
    import pyarrow as pa

    from lectern.operators.overlap import best_two

    dates = F.array_join(F.array_sort(F.coalesce(T.dates(F.col("content")), F.array().cast("array<string>"))), "|")
    fresh = (F.col("confidence") >= rules.LEAST_CONFIDENCE) & ~F.col("pinned") & F.col("valid_to").isNull()
    held = lambda df, *more: df.select("memory_id", "memory_type", F.array_join(F.array_sort(T.token_set(F.col("content"))), " ").alias("words"), dates.alias("dates"), *more).where("words <> ''")
    a = held(new.where("memory_type <> 'episodic'"), T.supersede_threshold(F.col("content"), base).alias("least")).where("instr(words, ' ') > 0")
    a = a.groupBy("memory_type", "words", "dates", "least").agg(F.min("memory_id").alias("group"), F.collect_list("memory_id").alias("members"))
    b = held(live.where(fresh)).groupBy("memory_type", "words", "dates").agg(F.slice(F.array_sort(F.collect_set("memory_id")), 1, 2).alias("ids"))
    down, across = blocks(new.count()), blocks(live.count())
    deal = lambda n: F.pmod(F.xxhash64("words"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.select("memory_type", "words", "dates", "least", "group", deal(down).alias("i")).withColumn("j", every(across))
    right = b.withColumn("j", deal(across)).withColumn("i", every(down))
    id_new, id_old = new.schema["memory_id"].dataType.simpleString(), live.schema["memory_id"].dataType.simpleString()

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        rows, ids, overlap = best_two(x, y)
        return pa.table({"group": x["group"].take(pa.array(rows, pa.int64())), "old_id": pa.array(ids, y["ids"].type.value_type), "overlap": pa.array(overlap, pa.float64())})

    keys = ["memory_type", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"group {id_new}, old_id {id_old}, overlap double")
    met = found.join(a.select("group", F.explode("members").alias("new_id")), "group").where("new_id <> old_id")
    best = met.groupBy("new_id").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "old_id")).alias("p"))
    return best.select("new_id", "p.old_id", (-F.col("p.less")).alias("overlap"))


def superseded(memories: DataFrame, new: DataFrame, as_of, *, base: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Current state and revisions after a batch of stores that don't build on each other.

    The old row of a conflict is archived with [valid_from, as_of); the new one takes its place with confidence 1 and no accesses.
    """
    when = F.lit(as_of).cast("timestamp")
    hit = conflicts(new, memories, base=base)
    gone = hit.select(F.col("old_id"), F.col("new_id"))
    archived = memories.join(gone, F.col("memory_id") == F.col("old_id")).withColumn("valid_to", when).withColumn("superseded_by", F.col("new_id")).drop("old_id", "new_id")
    stay = memories.join(gone, F.col("memory_id") == F.col("old_id"), "left_anti")
    fresh = new.join(hit.select(F.col("new_id").alias("n"), F.col("old_id").alias("o")), F.col("memory_id") == F.col("n"), "left")
    fresh = fresh.withColumns({"superseded_id": F.col("o"), "confidence": F.lit(1.0), "access_count": F.lit(0).cast("long"), "created_at": when, "updated_at": when, "valid_from": when, "valid_to": F.lit(None).cast("timestamp"), "last_accessed": F.lit(None).cast("timestamp")}).drop("n", "o")
    return stay.unionByName(fresh.select(stay.columns)), archived


def store_in_order(log: DataFrame, *, base: float = 0.3) -> DataFrame:
    """Exact supersession of a store log (workspace_id, memory_type, seq, memory_id, content): each store sees the effect of earlier ones.

    (memory_id, superseded_id, closed_by): one ordered run for each workspace and type, since that order is the semantics.
    """
    import pandas as pd

    from lectern.operators.sequential import run_stores

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return run_stores(rows.sort_values("seq"), base)

    return log.groupBy("workspace_id", "memory_type").applyInPandas(run, "workspace_id string, memory_type string, memory_id string, superseded_id string, closed_by string")


def forget(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """Memories without those that a recall returned."""
    return memories.join(hits.select("memory_id"), "memory_id", "left_anti")


def anchored(anchors: DataFrame, new: DataFrame) -> DataFrame:
    """Anchors (memory_id, file_path, symbol, ...) after an upsert: the new one replaces that of the same memory, file and symbol (none is one too)."""
    key = F.coalesce("symbol", F.lit(""))
    rows = anchors.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)), allowMissingColumns=True).withColumn("sym", key)
    names = [c for c in rows.columns if c not in ("turn", "sym")]
    return rows.groupBy("memory_id", "file_path", "sym").agg(F.max_by(F.struct(*names), "turn").alias("v")).select("v.*")


def revalidated(anchors: DataFrame, symbols: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """``anchors_checked`` of the anchors into the changed files (source_path) alone; a whole-file anchor is missing once its file is gone."""
    return anchors_checked(anchors.join(changed.select(F.col("source_path").alias("file_path")).distinct(), "file_path", "left_semi"), symbols, files)


def anchors_checked(anchors: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Anchors (anchor_id, file_path, symbol, sig_hash, span_hash) with state and new_path.

    symbols: (file_id, name, qualified_name, sig_hash, span_hash); files: (file_id, filename, source_path).  A symbol is looked up in
    its own file first (by path or file name, qualified or simple name), then anywhere; all joins are on equality.
    """
    named = symbols.select("file_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("sym"), F.col("sig_hash").alias("now_sig"), F.col("span_hash").alias("now_span"), "qualified_name")
    placed = named.join(files.select("file_id", F.explode(F.array_distinct(F.array("source_path", "filename"))).alias("path"), F.col("source_path").alias("home")), "file_id")
    here = placed.groupBy("path", "sym").agg(F.min(F.struct("qualified_name", "now_sig", "now_span")).alias("here"))
    there = placed.groupBy("sym").agg(F.min(F.struct("home", "qualified_name")).alias("there")).withColumnRenamed("sym", "any_sym")
    known = files.select(F.explode(F.array_distinct(F.array("source_path", "filename"))).alias("known")).distinct()
    met = anchors.join(here, (F.col("file_path") == F.col("path")) & (F.col("symbol") == F.col("sym")), "left").join(there, F.col("symbol") == F.col("any_sym"), "left").join(known, F.col("file_path") == F.col("known"), "left")
    whole = F.coalesce("symbol", F.lit("")) == ""
    changed = lambda old, now: F.coalesce(F.col(old) != F.col(now), F.col(old).isNotNull() & F.col(now).isNull())
    state = (
        F.when(whole, F.when(F.col("known").isNotNull(), "current").otherwise("missing"))
        .when(F.col("here").isNull(), F.when(F.col("there").isNotNull(), "moved").otherwise("missing"))
        .when(F.col("sig_hash").isNotNull() & changed("sig_hash", "here.now_sig"), "signature_changed")
        .when(F.col("span_hash").isNotNull() & changed("span_hash", "here.now_span"), "body_changed").otherwise("current")
    )
    out = met.withColumn("state", state)
    return out.withColumn("new_path", F.when(F.col("state") == "moved", F.col("there.home"))).select(*anchors.columns, "state", "new_path")


def stale_anchors(checked: DataFrame) -> DataFrame:
    """Anchors that aren't current, gravest first."""
    grave = F.when(F.col("state") == "missing", 0).when(F.col("state") == "moved", 1).when(F.col("state") == "signature_changed", 2).otherwise(3)
    return checked.where("state <> 'current'").withColumn("gravity", grave).orderBy("gravity", "anchor_id")
