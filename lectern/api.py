"""A workspace: one folder of files and memories with its tables in a ``Store``.

Methods return DataFrames where rows are the answer and plain values where one row is.  Times are arguments (``as_of``), so that
every answer can be repeated.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions.tokenizers import Tokenizers
from lectern.operators import lines, links, memory, search, symbols, workspace
from lectern.operators.index import Index
from lectern.plans.query import safe_pattern
from lectern.sources import files as sources
from lectern.sources import local
from lectern.sources.store import Store, ingest

MEMORY = (
    "memory_id string, content string, memory_type string, tags array<string>, metadata string, pinned boolean, source string, confidence double, access_count bigint, "
    "created_at timestamp, updated_at timestamp, last_accessed timestamp, valid_from timestamp, valid_to timestamp, superseded_id string"
)


def page_id() -> Column:
    """A page's id in the index: zero-padded, so that ties stand in order of pages."""
    return F.format_string("%s#%06d", F.col("file_id"), F.col("page_number"))


class Workspace:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, store or f"{self.root}/.lectern")

    def _table(self, name: str) -> DataFrame:
        out = self.store.table(name)
        if out is None:
            raise LookupError(f"{self.root} has no {name} yet")
        return out

    # files

    def index(self, *, tags: list[str] | None = None, exclude: list[str] | None = None, as_of=None) -> dict[str, int]:
        """Bring the tables up to date with the folder: new and changed files are parsed, unchanged ones skipped, links met again."""
        found = sources.scan(self.spark, self.root, exclude=exclude)
        old = self.store.table("files")
        if old is None:
            plan = found.withColumn("status", F.lit("ingested"))
        else:
            plan = workspace.index_plan(found, old)
        summary = workspace.index_summary(plan.select("status")).first().asDict()
        todo = plan.where("status <> 'skipped'").drop("status")
        if not todo.isEmpty():
            new = ingest(todo, tags=tags, as_of=as_of)
            if old is not None:
                gone = old.join(todo.select("source_path"), "source_path", "left_semi").select("file_id")
                for name, df in new.items():
                    before = self._table(name)
                    kept = links.without_file(before, gone) if name == "links" else workspace.delete_files(before, gone)
                    new[name] = kept.unionByName(df)
                new["links"] = links.reconciled(new["links"], new["files"])
            self._commit(new)
            summary["failed"] = self._table("files").where("status = 'failed'").count()
        return summary

    def ensure_indexed(self, as_of=None) -> bool:
        """Index the folder if it has no tables yet; whether it has some now.  Errors are reported by the answer alone."""
        try:
            if self.store.table("files") is None:
                self.index(as_of=as_of)
            return True
        except Exception:  # a helper for tools that go on without an index
            return False

    def ingest_bytes(self, name: str, content: bytes, *, tags: list[str] | None = None, as_of=None) -> dict[str, int]:
        """Put a file into the folder and index it."""
        path = local.confined(self.root, name)
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(content)
        return self.index(tags=tags, as_of=as_of)

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        """Publish tables, with the index of their pages."""
        index = Index.build(tables["pages"].withColumn("page_id", page_id()), "page_id", "text")
        self.store.commit(tables | {"postings": index.dealt(), "lengths": index.lengths}, {"tokenizer": Tokenizers().fingerprint()}, {"postings": ["bucket"]})

    def delete(self, file_id: str) -> None:
        gone = self.spark.createDataFrame([(file_id,)], "file_id string")
        tables = {n: workspace.delete_files(self._table(n), gone) for n in ("files", "pages", "texts", "symbols")}
        self._commit(tables | {"links": links.without_file(self._table("links"), gone)})

    def resolve(self, name: str) -> str:
        """The file_id that a name means."""
        found = workspace.resolve_name(self._table("files"), name).limit(6).collect()
        if not found:
            raise FileNotFoundError(name)
        if found[0].ambiguous:
            raise LookupError(f"{name} may be any of {', '.join(r.file_id for r in found)}")
        return found[0].file_id

    def read(self, name: str, *, page: str | None = None, line: str | None = None, pattern: str | None = None, toc: bool = False, numbered: bool = False) -> str:
        out = lines.read(self._table("texts"), self._table("pages").drop("marker", "line_start", "line_end"), self.resolve(name), page=page, line=line, pattern=pattern, toc=toc)
        row = (out.select(lines.numbered(F.col("body")).alias("body")) if numbered else out).first()
        return "" if row is None else row.body

    def search(self, query: str, *, mode: str = "auto", path: str | None = None, glob: str | None = None, limit: int = 20, offset: int = 0, ignore_case: bool = True, context: int = 0, boost: float = 0.0, **where) -> DataFrame:
        """Full-text hits on pages, or matching lines of files when a path or glob (or mode grep) asks for them."""
        files = self._table("files").where("status = 'ready'")
        if search.route(query, path=path, glob=glob, mode=mode) == "grep":
            rows = sources.lines(self.spark, local.confined(self.root, path) if path else self.root, pattern=glob)
            return lines.grep(rows, safe_pattern(query), id_col="source_path", text_col="text", ignore_case=ignore_case, context=context, limit=limit)
        own = files.select("file_id", "filename", "source_path", "tags", "metadata", "created_at")
        pages = self._table("pages").join(own, "file_id").withColumn("page_id", page_id())
        index = Index(self._table("postings"), self._table("lengths"))
        found = index.match(query, pages, id_col="page_id", text_col="text").withColumnRenamed("id", "page_id")
        hits = search.page_of(search.filtered(pages.join(found, "page_id"), **where), query, id_col="page_id", text_col="text", limit=limit, offset=offset).drop("page_id")
        return search.backlink_boost(hits, links.backlinks(self._table("links")).withColumnRenamed("to_file_id", "file_id"), id_col="file_id", weight=boost) if boost else hits

    def context(self, query: str) -> DataFrame:
        texts = self._table("texts").join(self._table("files").where("status = 'ready'").select("file_id"), "file_id")
        return search.context_bundle(self._table("symbols"), texts, query, id_col="file_id", text_col="full_text")

    def symbols(self, query: str, *, kinds: list[str] | None = None) -> DataFrame:
        return search.symbol_search(self._table("symbols"), query, kinds=kinds)

    def backfill_symbols(self) -> None:
        texts = sources.scan(self.spark, self.root).select("source_path", F.col("content").cast("string").alias("text")).join(self._table("files").select("file_id", "source_path"), "source_path")
        old = self._table("symbols")
        self.store.commit({"symbols": old.unionByName(symbols.backfill(texts, old))})

    def glob(self, pattern: str) -> DataFrame:
        return workspace.glob(self._table("files").where("status = 'ready'"), pattern)

    def list_files(self, **options) -> DataFrame:
        return workspace.list_files(self._table("files"), **options)

    def info(self) -> DataFrame:
        return workspace.stats(self._table("files"), self.store.table("memories"))

    def doctor(self, as_of) -> DataFrame:
        return workspace.doctor(self._table("files"), self._table("pages"), self._table("pages").select("file_id"), as_of)

    # memories

    def _memories(self) -> DataFrame:
        out = self.store.table("memories")
        return self.spark.createDataFrame([], MEMORY) if out is None else out

    def _revisions(self) -> DataFrame:
        out = self.store.table("revisions")
        return self.spark.createDataFrame([], MEMORY + ", superseded_by string") if out is None else out

    def store_memory(self, content: str, as_of, *, memory_type: str = "semantic", tags: list[str] | None = None, metadata: dict | None = None, pinned: bool = False, source: str = "unknown", memory_id: str | None = None) -> str:
        """Store a fact; it may supersede an earlier one, which is kept as a revision."""
        if not content.strip() or memory_type not in rules.MEMORY_TYPES or source not in rules.MEMORY_SOURCES:
            raise ValueError("content, memory_type or source is not valid")
        ident = memory_id or uuid.uuid4().hex
        new = self.spark.createDataFrame([(ident, content, memory_type, tags or [], json.dumps(metadata or {}), pinned, source)], "memory_id string, content string, memory_type string, tags array<string>, metadata string, pinned boolean, source string")
        current, archived = memory.superseded(self._memories(), new, as_of)
        self.store.commit({"memories": current, "revisions": self._revisions().unionByName(archived)})
        return ident

    def recall(self, query: str, as_of, *, pinned_only: bool = False, **options) -> DataFrame:
        if pinned_only:
            return memory.pinned(self._memories(), **{k: v for k, v in options.items() if k in ("limit", "offset", "memory_type", "tags")})
        return memory.recall(self._memories(), query, as_of, **options)

    def recall_as_of(self, query: str, as_of, **options) -> DataFrame:
        return memory.recall_as_of(self._memories(), self._revisions(), query, as_of, **options)

    def history(self, memory_id: str) -> DataFrame:
        return memory.history(self._revisions(), memory_id)

    def reinforce(self, ids: list[str], as_of) -> None:
        log = self.spark.createDataFrame([(i,) for i in ids], "memory_id string").withColumn("ts", F.lit(as_of).cast("timestamp"))
        self.store.commit({"memories": memory.reinforced(self._memories(), log)})

    def forget(self, as_of, *, memory_id: str | None = None, query: str | None = None) -> int:
        """Delete a memory by id, or those that a recall of ``query`` returns (100 at most); how many went."""
        rows = self._memories()
        hits = rows.where(F.col("memory_id") == memory_id) if memory_id else memory.recall(rows, query or "", as_of, limit=100)
        n = hits.count()
        if n:
            self.store.commit({"memories": memory.forget(rows, hits)})
        return n

    def list_memories(self, **options) -> DataFrame:
        return memory.list_memories(self._memories(), **options)
