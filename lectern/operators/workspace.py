"""Files of a workspace: statistics, listings, look-ups, name resolution, duplicates, checks, deletion."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions import text as T

SORTS = ("created_at", "filename", "file_size")


def mime_of(path: Column, head: Column | None = None) -> Column:
    """MIME type by magic bytes (hex of the head, if given), then by suffix."""
    # Suffixes and magic numbers of common formats.
    by_suffix = {
        "txt": "text/plain", "md": "text/markdown", "rst": "text/x-rst", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "xml": "text/xml",
        "py": "text/x-python", "js": "text/javascript", "ts": "text/typescript", "yaml": "text/yaml", "yml": "text/yaml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
        "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    }
    magic = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif"}
    out = F.lit(None).cast("string")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    for key, mime in by_suffix.items():
        out = F.when(suffix == key, mime).otherwise(out)
    out = F.coalesce(out, F.lit("application/octet-stream"))
    if head is not None:
        for key, mime in magic.items():
            out = F.when(F.startswith(F.hex(head), F.lit(key)), mime).otherwise(out)
    return out


def excluded(path: Column, extra: list[str] | None = None) -> Column:
    """Paths (relative, with slashes) that an index leaves out: listed folders and files, dot files, extra names."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    listed = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in [*rules.INDEX_SKIP_DIRS, *(extra or [])]]))
    return listed | name.isin(*rules.INDEX_SKIP_FILES) | F.startswith(name, F.lit("."))


def grep_skipped(path: Column) -> Column:
    folders = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in rules.GREP_SKIP_DIRS]))
    return folders | F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*rules.GREP_SKIP_SUFFIXES)


def is_code(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*rules.CODE_SUFFIXES)


def document_type(filename: Column, mime: Column, text: Column) -> Column:
    """Category by file name, else by the first 500 characters, else by MIME type; null if unknown."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 500)
    tests = [(filename.rlike(f"(?i){p}"), t) for p, t in rules.NAME_TYPES] + [(head.rlike(f"(?i){p}"), t) for p, t in rules.TEXT_TYPES]
    tests += [(mime == m, t) for m, t in rules.MIME_TYPES.items()] + [(F.startswith(mime, F.lit("image/")), "image")]
    return F.coalesce(*[F.when(c, F.lit(t)) for c, t in tests])


def stats(files: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """(metric, name, n): files in all, by status, ready ones by MIME type, memories by type."""
    row = lambda df, metric, name: df.groupBy(name).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), F.col(name).alias("name"), "n")
    out = files.agg(F.count("*").alias("n")).select(F.lit("files").alias("metric"), F.lit("all").alias("name"), "n")
    out = out.unionByName(row(files, "status", "status")).unionByName(row(files.where("status = 'ready'"), "mime", "mime_type"))
    return out if memories is None else out.unionByName(row(memories.where("valid_to is null"), "memory", "memory_type"))


def list_files(files: DataFrame, *, sort: str = "created_at", descending: bool = True, limit: int = 50, offset: int = 0, where: dict | None = None) -> DataFrame:
    """A page of files (at most 200) in an allowed order, ties by file_id."""
    from lectern.operators.search import filtered

    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}: {sort}")
    key = F.desc(sort) if descending else F.asc(sort)
    return filtered(files.where("status = 'ready'"), **(where or {})).orderBy(key, "file_id").offset(offset).limit(min(limit, 200))


def with_page_counts(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files with total_pages (zero without pages)."""
    n = pages.groupBy("file_id").agg(F.count("*").alias("total_pages"))
    return files.join(n, "file_id", "left").withColumn("total_pages", F.coalesce("total_pages", F.lit(0)))


def recent(files: DataFrame, k: int = 5) -> DataFrame:
    return files.where("status = 'ready'").orderBy(F.desc("updated_at"), "file_id").limit(k)


def sections(pages: DataFrame, file_id=None) -> DataFrame:
    """Distinct section titles; parts of a sheet share the sheet's name."""
    rows = pages if file_id is None else pages.where(F.col("file_id") == F.lit(file_id))
    return rows.where("section_title is not null").select(F.split("section_title", " - rows ")[0].alias("section")).distinct()


def duplicates(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Checksums that a ready file already has."""
    return checksums.join(files.where("status = 'ready'"), "checksum", "left_semi").select("checksum").distinct()


def first_by_checksum(files: DataFrame, order: str = "file_id") -> DataFrame:
    """One file for each checksum: the least in ``order``, found by a grouped minimum."""
    picked = files.groupBy("checksum").agg(F.min_by(F.struct(*files.columns), order).alias("f"), F.count("*").alias("copies"))
    return picked.select("f.*", "copies")


def similarity(name: Column, wanted: str) -> Column:
    """Ratio of matching blocks of two names, lower-cased (no column expression computes it)."""

    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else difflib.SequenceMatcher(None, wanted.lower(), n.lower()).ratio())

    run.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(name)


def trigram_similarity(name: Column, wanted: str) -> Column:
    """Shared over joint trigrams: the native alternative."""
    return T.jaccard(T.trigrams(name), T.trigrams(F.lit(wanted)))


def fuzzy(files: DataFrame, wanted: str, *, least: float = 0.3, k: int = 5, native: bool = False) -> DataFrame:
    sim = trigram_similarity(F.col("filename"), wanted) if native else similarity(F.col("filename"), wanted)
    return files.withColumn("sim", sim).where(F.col("sim") > least).orderBy(F.desc("sim"), "file_id").limit(k)


def resolve_name(files: DataFrame, wanted: str) -> DataFrame:
    """(file_id, step, ambiguous): what a name means, by the first step that finds anything.

    0 file name, 1 file_id, 2 path suffix (names with a slash), 3 similar name (alone, or more than 0.2 ahead), 4 part of the name.
    Several rows are the candidates of an ambiguous name; none: there is no such file.
    """
    ready = files.where("status = 'ready'").select("file_id", "filename", "source_path")
    exact = ready.where(F.col("filename") == wanted).select("file_id", F.lit(0).alias("step"), F.lit(0.0).alias("sim")).orderBy("file_id").limit(1)
    ident = ready.where(F.col("file_id").cast("string") == wanted).select("file_id", F.lit(1).alias("step"), F.lit(0.0).alias("sim"))
    tail = "/" + wanted.replace("\\", "/").lstrip("/")
    path = ready.where(F.endswith("source_path", F.lit(tail)) if "/" in wanted or "\\" in wanted else F.lit(False)).select("file_id", F.lit(2).alias("step"), F.lit(0.0).alias("sim"))
    near = fuzzy(ready, wanted).select("file_id", F.lit(3).alias("step"), "sim")
    part = ready.where(F.lower("filename").contains(wanted.lower())).select("file_id", F.lit(4).alias("step"), F.lit(0.0).alias("sim"))
    found = exact.unionByName(ident).unionByName(path).unionByName(near).unionByName(part)
    first = found.agg(F.min("step").alias("s")).scalar()
    rows = found.where(F.col("step") == first)
    top = rows.agg(F.max("sim").alias("s")).scalar()
    rows = rows.withColumn("ahead", rows.where(F.col("sim") + 0.2 >= top).agg(F.count("*")).scalar() == 1)
    kept = rows.where((F.col("step") != 3) | ~F.col("ahead") | (F.col("sim") == top))
    return kept.withColumn("ambiguous", kept.agg(F.count("*")).scalar() > 1).select("file_id", "step", "ambiguous")


def doctor(files: DataFrame, pages: DataFrame, lengths: DataFrame, as_of, *, stuck_minutes: int = 10) -> DataFrame:
    """(name, status, detail) of health checks: index and table of equal size, stuck files, orphaned pages."""
    when = F.lit(as_of).cast("timestamp")
    n_pages, n_index = pages.agg(F.count("*")).scalar(), lengths.agg(F.count("*")).scalar()
    stuck = files.where((F.col("status") == "processing") & (F.unix_micros(when) - F.unix_micros(F.col("updated_at").cast("timestamp")) > stuck_minutes * 60_000_000)).agg(F.count("*")).scalar()
    orphans = pages.join(files.select("file_id"), "file_id", "left_anti").agg(F.count("*")).scalar()
    one = files.sparkSession.range(1)
    line = lambda name, bad, level, detail: F.struct(F.lit(name).alias("name"), F.when(bad, level).otherwise("ok").alias("status"), detail.cast("string").alias("detail"))
    checks = F.array(line("index_matches_pages", n_pages != n_index, "error", F.concat(n_index.cast("string"), F.lit(" of "), n_pages.cast("string"))), line("stuck_files", stuck > 0, "warning", stuck), line("orphaned_pages", orphans > 0, "warning", orphans))
    return one.select(F.explode(checks).alias("c")).select("c.*")


def worst(checks: DataFrame) -> DataFrame:
    grave = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return checks.agg(F.max_by("status", grave).alias("status"))


def index_summary(plan: DataFrame) -> DataFrame:
    """Counts of an index run by outcome: (total, ingested, updated, skipped, failed)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return plan.agg(F.count("*").alias("total"), count("ingested"), count("updated"), count("skipped"), count("failed"))


def index_plan(found: DataFrame, files: DataFrame) -> DataFrame:
    """Found files (source_path, checksum) with their outcome: skipped (same checksum known), updated (same path, other checksum) or ingested."""
    known = files.where("status = 'ready'").select(F.col("checksum").alias("known_sum")).distinct()
    paths = files.where("status = 'ready'").select(F.col("source_path").alias("known_path")).distinct()
    met = found.join(known, F.col("checksum") == F.col("known_sum"), "left").join(paths, F.col("source_path") == F.col("known_path"), "left")
    status = F.when(F.col("known_sum").isNotNull(), "skipped").when(F.col("known_path").isNotNull(), "updated").otherwise("ingested")
    return met.withColumn("status", status).drop("known_sum", "known_path")


def delete_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A file-keyed table (files, pages, symbols, texts) without deleted files."""
    return table.join(gone.select("file_id"), "file_id", "left_anti")


def glob(files: DataFrame, pattern: str, *, limit: int = 500) -> DataFrame:
    """Files whose path matches a shell pattern (``**`` crosses folders), newest first, with ``truncated``."""
    regex, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            regex, i = regex + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            regex, i = regex + ".*", i + 2
        else:
            c = pattern[i]
            regex, i = regex + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".^$+{}[]()|\\" else c), i + 1
    met = files.where(F.col("source_path").rlike(f"^{regex}$"))
    total = met.agg(F.count("*")).scalar()
    return met.orderBy(F.desc("modified_at"), "source_path").limit(limit).withColumn("truncated", total > limit)
