"""Links between files: extraction, resolution and backlinks."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules

LINKS = "array<struct<target: string, link_type: string, context: string>>"


def html_links(html: Column) -> Column:
    """Values of href attributes in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


#: Kind of link: its pattern, the group that names the target, and whether the target is relative to the file's folder.
KINDS = {"markdown": (rules.MARKDOWN_LINK, 2, True), "wikilink": (rules.WIKI_LINK, 1, True), "path": (rules.CODE_PATH, 1, False)}
CODE_SPANS = (re.compile(r"```.*?```", re.S), re.compile(r"`[^`\n]+`"))


def masked(text: str) -> str:
    """The text with its code spans as blanks of the same length, so that places stay."""
    for span in CODE_SPANS:
        text = span.sub(lambda m: " " * len(m[0]), text)
    return text


def local_target(target: str, folder: str) -> str | None:
    """The normalised path that a link leads to from ``folder``; None for external or empty ones."""
    target = unquote(target.strip().strip("<>"))
    path = "" if re.match(rules.EXTERNAL, target) else re.split(r"[#?]", target, maxsplit=1)[0].strip().replace("\\", "/")
    found = posixpath.normpath(posixpath.join(folder, path)) if path else "."
    return None if found == "." else found


def links_of(text: str | None, source_path: str | None) -> list[dict[str, str]]:
    """Links outside code, the first of each (target, type), with up to 80 characters around."""
    text = text or ""
    home = posixpath.dirname((source_path or "").replace("\\", "/"))
    plain, found = masked(text), {}
    for kind, (regex, group, relative) in KINDS.items():
        for m in re.finditer(regex, plain):
            name = m[group].strip()
            if kind == "wikilink" and name and not posixpath.splitext(name)[1]:
                name += ".md"
            if target := local_target(name, home if relative else ""):
                context = " ".join(text[max(0, m.start() - 80) : m.end() + 80].split())
                found.setdefault((target, kind), {"target": target, "link_type": kind, "context": context})
    return list(found.values())


def text_links(files: DataFrame, *, id_col: str = "file_id", text_col: str = "text", path_col: str = "source_path") -> DataFrame:
    """(from_file_id, target, link_type, context) of all texts.

    Masking code at equal length and path arithmetic have no column expression, so a vectorised function does both.
    """

    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([links_of(t, p) for t, p in zip(texts, paths)])

    run.__annotations__ = {"texts": pd.Series, "paths": pd.Series, "return": pd.Series}
    found = F.pandas_udf(run, LINKS)(F.col(text_col), F.col(path_col))
    return files.where(F.col(text_col).rlike(r"\]\(|\[\[|/")).select(F.col(id_col).alias("from_file_id"), F.explode(found).alias("l")).select("from_file_id", "l.*")


def merged(*links: DataFrame) -> DataFrame:
    """Links of several extractors, one for each (source, target, type)."""
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.groupBy("from_file_id", "target", "link_type").agg(F.min("context").alias("context"))


def suffixes(path: Column) -> Column:
    """All trailing parts of a path that begin after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` (from_file_id, target, ...) with to_file_id.

    A target is an exact source_path, else a path's suffix (shortest path first), else a file name; each step is an
    equality join, suffixes being exploded, and every target is looked up once.
    """
    ready = files.where("status = 'ready'").select("file_id", "filename", "source_path")
    suffix = ready.where(F.instr("source_path", "/") > 0).select(F.explode(suffixes(F.col("source_path"))).alias("key"), F.lit(1).alias("step"), F.length("source_path").alias("size"), "file_id")
    exact = ready.select(F.col("source_path").alias("key"), F.lit(0).alias("step"), F.lit(0).alias("size"), "file_id")
    name = ready.select(F.col("filename").alias("key"), F.lit(2).alias("step"), F.lit(0).alias("size"), "file_id")
    book = exact.unionByName(suffix).unionByName(name).groupBy("key", "step").agg(F.min(F.struct("size", "file_id"))["file_id"].alias("file_id"))
    clean = F.regexp_replace(F.replace("target", F.lit("\\"), F.lit("/")), "^/+", "")
    wanted = links.select("target").distinct().select("target", F.explode(F.array(F.struct(F.col("target").alias("key"), F.lit(0).alias("step")), F.struct(clean.alias("key"), F.lit(1).alias("step")), F.struct(F.element_at(F.split("target", "/"), -1).alias("key"), F.lit(2).alias("step")))).alias("w")).select("target", "w.*")
    best = wanted.join(book, ["key", "step"]).groupBy("target").agg(F.min(F.struct("step", "file_id"))["file_id"].alias("to_file_id"))
    return links.join(best, "target", "left")


def reconciled(links: DataFrame, new_files: DataFrame) -> DataFrame:
    """Resolved links whose unresolved targets meet files that came later."""
    open_ = links.where("to_file_id is null").drop("to_file_id")
    return links.where("to_file_id is not null").unionByName(resolved(open_, new_files).select(links.columns))


def backlinks(links: DataFrame, *, to_col: str = "to_file_id") -> DataFrame:
    """(to_file_id, backlinks): how many links lead to each file."""
    return links.where(F.col(to_col).isNotNull()).groupBy(to_col).agg(F.count("*").alias("backlinks"))


def without_file(links: DataFrame, gone: DataFrame, *, file_col: str = "file_id") -> DataFrame:
    """Links after files are deleted: those from them leave, those to them are open again."""
    left = links.join(gone.select(F.col(file_col).alias("from_file_id")), "from_file_id", "left_anti")
    met = left.join(gone.select(F.col(file_col).alias("gone_id")), F.col("to_file_id") == F.col("gone_id"), "left")
    return met.withColumn("to_file_id", F.when(F.col("gone_id").isNull(), F.col("to_file_id"))).drop("gone_id").select(links.columns)
