"""Tables of a workspace in Parquet: an append-only log of manifests, published as a whole.

Every commit writes new files below ``<root>/<table>/`` and then creates ``manifest-<version>.json``, which fails if another writer has
made that version.  Readers take the highest manifest that is complete, so they see all tables of a version or none, and a
writer that dies leaves nothing that blocks the next one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def manifest(self) -> dict:
        """{version, schema_version, tables: name to folder, properties} of the latest complete commit."""
        found = []
        if self._fs.exists(self._path()):
            names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
            found = sorted((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), reverse=True)
        for version in found:
            try:
                return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest-{version}.json").collect()))
            except json.JSONDecodeError:
                continue  # its writer died; the next commit takes the version after it
        return {"version": 0, "schema_version": SCHEMA_VERSION, "tables": {}, "properties": {}}

    def _latest(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())] if self._fs.exists(self._path()) else []
        return max([int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))], default=0)

    def table(self, name: str) -> DataFrame | None:
        folder = self.manifest()["tables"].get(name)
        return None if folder is None else self.spark.read.parquet(f"{self.root}/{folder}")

    def commit(self, tables: dict[str, DataFrame], properties: dict[str, str] | None = None, partition: dict[str, list[str]] | None = None) -> int:
        """Write the given tables as a new version and publish it; other tables keep their folders.  An error publishes nothing.

        FileExistsError: another writer has published this version in the meantime.
        """
        now = self.manifest()
        version = self._latest() + 1
        self._fs.mkdirs(self._path())
        folders = {name: f"{name}/{version}-{uuid.uuid4().hex[:8]}" for name in tables}
        for name, df in tables.items():
            df.write.partitionBy(*(partition or {}).get(name, [])).parquet(f"{self.root}/{folders[name]}")
        now = now | {"version": version, "tables": now["tables"] | folders, "properties": now["properties"] | (properties or {})}
        at = self._path(f"manifest-{version}.json")
        if self._fs.exists(at):
            raise FileExistsError(str(at))
        out = self._fs.create(at, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        return version

    def migrate(self, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], to: int) -> None:
        """Apply the steps (from version n to n + 1) up to schema version ``to``; tables and version change in one commit."""
        now = self.manifest()
        at, tables = now["schema_version"], {n: self.table(n) for n in now["tables"]}
        while at < to:
            tables = steps[at](tables)
            at += 1
        self.commit(tables, {"schema_version": str(to)})


class Registry:
    """Known workspaces of a user in one small JSON file: id (first 8 hex digits of the root's SHA-1), root, last use, the active one."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.data = json.loads(self.path.read_text()) if self.path.exists() else {"active": None, "workspaces": {}}

    @staticmethod
    def id_of(root: str) -> str:
        import hashlib

        return hashlib.sha1(root.encode()).hexdigest()[:8]

    def upsert(self, root: str, last_used: str) -> str:
        ident = self.id_of(root)
        self.data["workspaces"][ident] = {"root": root, "last_used": last_used}
        self.data["active"] = self.data["active"] or ident
        self.save()
        return ident

    def remove(self, ident: str) -> None:
        self.data["workspaces"].pop(ident, None)
        if self.data["active"] == ident:
            self.data["active"] = None
        self.save()

    def use(self, ident: str) -> None:
        if ident not in self.data["workspaces"]:
            raise KeyError(ident)
        self.data["active"] = ident
        self.save()

    def list(self) -> list[dict]:
        """The active one first, then by last use."""
        rows = [{"id": i, "active": i == self.data["active"], **w} for i, w in self.data["workspaces"].items()]
        return sorted(sorted(rows, key=lambda r: r["last_used"], reverse=True), key=lambda r: not r["active"])

    def save(self) -> None:
        new = self.path.with_suffix(".new")
        new.parent.mkdir(parents=True, exist_ok=True)
        new.write_text(json.dumps(self.data, indent=1))
        new.replace(self.path)


def ingest(found: DataFrame, *, tags: list[str] | None = None, as_of=None) -> dict[str, DataFrame]:
    """Tables of scanned files: files, pages, texts, links and symbols.  A file that can't be parsed has status failed."""
    from lectern.operators import lines, links, symbols
    from lectern.operators.workspace import document_type
    from lectern.sources.files import pages as parsed

    rows = found.withColumn("file_id", F.sha2(F.concat_ws(":", "source_path", "checksum"), 256).substr(1, 32))
    all_pages = parsed(rows).join(rows.select("file_id", "mime_type"), "file_id")
    good = all_pages.where("error is null").drop("error")
    placed = lines.page_ranges(good)
    texts = lines.assembled(good)
    outcome = all_pages.groupBy("file_id").agg(F.max("error").alias("error"), F.min_by("text", "page_number").alias("head"))
    when = F.lit(as_of).cast("timestamp") if as_of is not None else F.col("modified_at")
    files = rows.drop("content").join(outcome, "file_id", "left").withColumns({
        "status": F.when(F.col("error").isNull(), "ready").otherwise("failed"), "tags": F.array(*[F.lit(t) for t in tags or []]).cast("array<string>"),
        "document_type": document_type(F.col("filename"), F.col("mime_type"), F.col("head")), "created_at": when, "updated_at": when,
        "metadata": F.to_json(F.struct("source_path")),
    }).drop("head")
    raw = files.select("file_id", "source_path").join(good.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n").alias("text")), "file_id")
    code = rows.select("file_id", "source_path", F.col("content").cast("string").alias("text"))
    edges = links.merged(links.text_links(raw), symbols.imports(code))
    return {"files": files, "pages": placed, "texts": texts, "symbols": symbols.symbols(code), "links": links.resolved(edges, files)}
