"""Reading, searching and listing files that no index knows, within a root that paths can't leave."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lines
from lectern.operators import workspace as ws
from lectern.plans.query import safe_pattern
from lectern.sources import files as sources


def confined(root: str, path: str) -> str:
    """``path`` below ``root`` with links resolved; PermissionError for what lies outside."""
    base = Path(root).resolve()
    found = (base / path.replace("\\", "/")).resolve()
    if found != base and base not in found.parents:
        raise PermissionError(f"{path} is outside of {root}")
    return str(found)


def parsed(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Pages of one file through the parsers, without storing it."""
    at = confined(root, path)
    row = spark.read.format("binaryFile").load(at).select(F.sha2("path", 256).substr(1, 32).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), ws.mime_of(F.col("path"), F.substring("content", 1, 4)).alias("mime_type"), "content")
    return sources.pages(row).join(row.select("file_id", "mime_type"), "file_id")


def read(spark: SparkSession, root: str, path: str, *, page: str | None = None, line: str | None = None, pattern: str | None = None) -> str:
    """The assembled text of one file, or its pages, lines or matches."""
    pages = parsed(spark, root, path)
    bad = pages.where("error is not null").first()
    if bad is not None:
        raise ValueError(bad.error)
    pages = pages.drop("error")
    texts = lines.assembled(pages)
    file_id = texts.first().file_id
    row = lines.read(texts, pages, file_id, page=page, line=line, pattern=pattern).first()
    return "" if row is None else row.body


def grep(spark: SparkSession, root: str, pattern: str, *, path: str = ".", glob: str | None = None, ignore_case: bool = True, context: int = 0, limit: int | None = None) -> DataFrame:
    rows = sources.lines(spark, confined(root, path), pattern=glob)
    return lines.grep(rows, safe_pattern(pattern), id_col="source_path", text_col="text", ignore_case=ignore_case, context=context, limit=limit)


def glob(spark: SparkSession, root: str, pattern: str, *, limit: int = 500) -> DataFrame:
    """Files on disk that match, newest first."""
    return ws.glob(sources.scan(spark, confined(root, "."), keep_content=False), pattern, limit=limit)


def git_head(root: str) -> str | None:
    """The commit that a working tree stands at, read from its ``.git`` folder; None without one."""
    git = os.path.join(root, ".git")
    try:
        head = Path(git, "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        ref = head[5:]
        loose = Path(git, ref)
        if loose.exists():
            return loose.read_text().strip()
        packed = Path(git, "packed-refs").read_text().splitlines()
        return next((x.split()[0] for x in packed if x.endswith(" " + ref)), None)
    except OSError:
        return None
