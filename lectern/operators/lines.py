"""Lines, pages and grep: everything between a text and the part of it that a reader asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.plans.query import line_spec, page_spec, safe_pattern


def line_index(text: Column) -> Column:
    """Character offset of the start of each line."""
    sizes = F.transform(F.split(text, "\n"), lambda x: F.length(x) + 1)
    start = F.struct(F.array(F.lit(0)).alias("all"), F.lit(0).alias("at"))
    step = lambda acc, n: F.struct(F.concat(acc["all"], F.array(acc["at"] + n)).alias("all"), (acc["at"] + n).alias("at"))
    return F.aggregate(F.slice(sizes, F.lit(1), F.size(sizes) - 1), start, step, lambda acc: acc["all"])


def line_starts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, start): the line index as rows, by a running sum within each document."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "body"))
    own = W.partitionBy(id_col).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return rows.select(id_col, (F.col("at") + 1).alias("line"), F.coalesce(F.sum(F.length("body") + 1).over(own), F.lit(0)).alias("start"))


def line_slice(text: Column, first: int, last: int | None) -> Column:
    """Lines ``first`` to ``last`` (1-based, inclusive) without newlines at the end."""
    lines = F.split(text, "\n")
    n = F.size(lines) if last is None else F.lit(max(0, last - max(first, 1) + 1))
    return F.regexp_replace(F.array_join(F.slice(lines, max(first, 1), n), "\n"), r"\n+$", "")


def numbered(text: Column, first: int = 1) -> Column:
    """Lines with right-aligned numbers (width 6 or that of the last number) and a tab."""
    lines = F.split(text, "\n")
    width = F.greatest(F.lit(6), F.length((F.size(lines) + first - 1).cast("string")))
    pad = lambda x, i: F.concat(F.lpad((i + first).cast("string"), width, F.lit(" ")), F.lit("\t"), x)
    return F.array_join(F.transform(lines, pad), "\n")


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, body), lines counted from 1."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "body")).select(id_col, (F.col("at") + 1).alias("line"), "body")


def grep(docs: DataFrame, pattern: str, *, id_col: str, text_col: str, ignore_case: bool = False, context: int = 0, limit: int | None = None) -> DataFrame:
    """Lines that match a regular expression, with ``context`` lines before and after as arrays.

    Context comes from the line array of the text itself, so nothing is shuffled and only matches become rows.
    """
    regex = ("(?i)" if ignore_case else "") + safe_pattern(pattern)
    rows = docs.select(id_col, F.split(text_col, "\n").alias("all"))
    hits = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("at"), x.alias("body"))), lambda s: s["body"].rlike(regex))
    rows = rows.select(id_col, "all", F.explode(hits).alias("h")).select(id_col, "all", "h.at", "h.body")
    before = F.slice("all", F.greatest(F.lit(1), F.col("at") + 1 - context), F.least(F.lit(context), F.col("at")))
    after = F.slice("all", F.col("at") + 2, F.lit(context))
    out = rows.select(id_col, (F.col("at") + 1).alias("line"), "body", before.alias("before"), after.alias("after"))
    return out if limit is None else out.orderBy(id_col, "line").limit(limit)


def grep_terms(docs: DataFrame, pattern: str, *, id_col: str, text_col: str, context: int = 2) -> DataFrame:
    """Lines that hold every term of ``a+b`` (any case) with their neighbourhood, page mark and group breaks, as rows.

    (id, line, body, is_match, new_group, mark): mark is the last page marker at or above the line.
    """
    terms = [t.strip().lower() for t in pattern.split("+") if t.strip()]
    hit = F.lit(True)
    for term in terms:
        hit = hit & F.lower("body").contains(term)
    whole = F.lit(True)
    for term in terms:
        whole = whole & F.lower(text_col).contains(term)
    rows = exploded(docs.where(whole), id_col, text_col).withColumn("is_match", hit)
    own = W.partitionBy(id_col).orderBy("line")
    near = F.max(F.col("is_match").cast("int")).over(own.rowsBetween(-context, context)) == 1
    mark = F.last(F.when(F.trim("body").rlike(rules.PAGE_MARK), F.trim("body")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    shown = rows.withColumn("near", near).withColumn("mark", mark).where("near").drop("near")
    gap = F.col("line") - F.lag("line").over(own)
    return shown.withColumn("new_group", F.coalesce(gap > 1, F.lit(False)))


def grep_text(docs: DataFrame, pattern: str, *, id_col: str, text_col: str, context: int = 2) -> DataFrame:
    """(id, found): the rows of ``grep_terms`` rendered one a line, groups apart by ``--``."""
    rows = grep_terms(docs, pattern, id_col=id_col, text_col=text_col, context=context)
    place = F.concat(F.when(F.col("mark").isNotNull(), F.concat(F.lit("["), F.col("mark"), F.lit(", Line "))).otherwise("[Line "), F.col("line").cast("string"), F.lit("] "))
    line = F.concat(F.when(F.col("new_group"), "--\n").otherwise(""), place, F.col("body"))
    lines = F.array_sort(F.collect_list(F.struct("line", line.alias("text"))))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("found"))


def page_marker(mime: Column, number: Column, title: Column) -> Column:
    n = number.cast("string")
    sheet = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("[Sheet: "), title, F.lit("]"))).otherwise(F.concat(F.lit("[Sheet "), n, F.lit("]")))
    return F.when(mime.contains("presentation"), F.concat(F.lit("[Slide "), n, F.lit("]"))).when(mime.contains("spreadsheet") | mime.contains("csv"), sheet).otherwise(F.concat(F.lit("[Page "), n, F.lit("]")))


def page_ranges(pages: DataFrame, *, file_col: str = "file_id") -> DataFrame:
    """Pages (file_id, page_number, section_title, text, mime_type) with marker, line_start and line_end in the assembled text.

    Each page takes a marker line, a blank line, its lines and a blank line.
    """
    own = W.partitionBy(file_col).orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    n = F.size(F.split("text", "\n"))
    start = F.coalesce(F.sum(n + 3).over(own), F.lit(0)) + 3
    out = pages.withColumn("marker", page_marker(F.col("mime_type"), F.col("page_number"), F.col("section_title"))).withColumn("line_start", start.cast("int"))
    return out.withColumn("line_end", (F.col("line_start") + n - 1).cast("int"))


def assembled(pages: DataFrame, *, file_col: str = "file_id") -> DataFrame:
    """(file_id, full_text, toc, total_lines) of pages."""
    rows = page_ranges(pages, file_col=file_col)
    title = F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    entry = F.concat("marker", F.lit(" "), title, F.lit(" (lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")"))
    held = F.array_sort(F.collect_list(F.struct("page_number", F.concat("marker", F.lit("\n\n"), "text", F.lit("\n")).alias("part"), entry.alias("entry"))))
    out = rows.groupBy(file_col).agg(held.alias("p"))
    join = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "\n")
    return out.select(file_col, join("part").alias("full_text"), join("entry").alias("toc")).withColumn("total_lines", F.size(F.split("full_text", "\n")))


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """Pages by numbers, a range, a list or a part of the section title."""
    want = page_spec(spec)
    return pages.where(F.col("section_title").ilike(f"%{want}%")) if isinstance(want, str) else pages.where(F.col("page_number").isin(want))


def read(files: DataFrame, pages: DataFrame, file_id, *, page: str | None = None, line: str | None = None, pattern: str | None = None, toc: bool = False) -> DataFrame:
    """The text of a file, or its contents, pages, lines or matches: one row (file_id, body).  files: (file_id, full_text, toc)."""
    own = files.where(F.col("file_id") == F.lit(file_id))
    if toc:
        return own.select("file_id", F.col("toc").alias("body"))
    body = own.select("file_id", F.col("full_text").alias("body"))
    if page is not None:
        picked = select_pages(page_ranges(pages.where(F.col("file_id") == F.lit(file_id))), page)
        held = F.array_sort(F.collect_list(F.struct("page_number", F.concat("marker", F.lit("\n\n"), "text").alias("part"))))
        body = picked.groupBy("file_id").agg(F.array_join(F.transform(held, lambda x: x["part"]), "\n\n").alias("body"))
    if line is not None:
        body = body.select("file_id", line_slice(F.col("body"), *line_spec(line)).alias("body"))
    if pattern is not None:
        body = grep_text(body, pattern, id_col="file_id", text_col="body").select("file_id", F.col("found").alias("body"))
    return body


def overlapping_chunks(docs: DataFrame, *, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(id, chunk, body): windows of ``size`` words, each beginning ``size - overlap`` words after the one before."""
    rows = docs.select(id_col, F.filter(F.split(text_col, r"\s+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(size - overlap))
    return rows.where(F.size("w") > 0).select(id_col, "w", F.posexplode(starts).alias("chunk", "at")).select(id_col, "chunk", F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("body"))
