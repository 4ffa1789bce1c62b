"""Directories to tables: scan, parse into pages, structured sheets.

``scan`` is the binary file source with path rules as filters; parsing is a function from bytes to pages that runs where the file
is read.  Parsers for formats whose libraries are not installed are looked up by MIME type and report a failed row instead.
"""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.operators import workspace as ws

PAGE = "page_number int, section_title string, text string, content_type string"
PAGES = "file_id string, " + PAGE + ", error string"
Page = tuple[int, str | None, str, str]
MOST_PAGES, ZIP_BYTES, ZIP_RATIO, ZIP_CHECKED = 5000, 512 << 20, 200, 32 << 20

HEADING, CAPITALS = re.compile(rules.HEADING, re.M), re.compile(rules.CAPITALS)


def decoded(raw: bytes) -> str:
    """Text by the first encoding that fits: UTF-8 (with or without a mark), then Latin-1."""
    for encoding in ("utf-8-sig", "latin-1"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def chunks(text: str, size: int = rules.CHUNK_CHARS) -> list[str]:
    """Paragraphs gathered to chunks of about ``size`` characters; a longer paragraph is a chunk of its own."""
    if len(text) <= size:
        return [text]
    out: list[list[str]] = [[]]
    room = size
    for paragraph in re.split(r"\n\s*\n", text):
        if out[-1] and len(paragraph) > room:
            out.append([])
            room = size + 2  # the first paragraph of a later chunk counts without its separator
        out[-1].append(paragraph)
        room -= len(paragraph) + 2
    return ["\n\n".join(x) for x in out]


def title_of(chunk: str) -> str | None:
    """The first Markdown heading, else a line in capitals among the first five."""
    if m := HEADING.search(chunk):
        return m[1].strip()
    return next((x for x in map(str.strip, chunk.split("\n")[:5]) if len(x) > 3 and CAPITALS.match(x)), None)


def parse_text(raw: bytes, name: str) -> list[Page]:
    return [(i, title_of(c), c, "text") for i, c in enumerate(chunks(decoded(raw)), 1)]


def parse_html(raw: bytes, name: str) -> list[Page]:
    """Visible text of a page; its title is the section title of the first chunk."""
    text = decoded(raw)
    title = re.search(r"<title[^>]*>(.*?)</title>", text, re.S | re.I)
    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", text)
    text = re.sub(r"(?i)<(?:br|/p|/div|/h\d|/li|/tr)[^>]*>", "\n", text)
    text = html.unescape(re.sub(r"<[^>]+>", " ", text))
    text = "\n".join(" ".join(x.split()) for x in text.split("\n")).strip()
    pages = [(i, title_of(c), c, "text") for i, c in enumerate(chunks(re.sub(r"\n{3,}", "\n\n", text)), 1)]
    return [(1, html.unescape(title[1]).strip(), *pages[0][2:]), *pages[1:]] if title and pages else pages


def sheet_rows(raw: bytes) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(decoded(raw))) if r]


def parse_csv(raw: bytes, name: str) -> list[Page]:
    """Pages of 100 rows as text tables that repeat the header every 50 rows."""
    rows = sheet_rows(raw)
    if not rows:
        return []
    head, body = " | ".join(rows[0]), rows[1:]
    out: list[Page] = []
    for lo in range(0, max(1, len(body)), rules.SHEET_ROWS):
        part = body[lo : lo + rules.SHEET_ROWS]
        lines = []
        for i, row in enumerate(part):
            if i % rules.HEADER_EVERY == 0:
                lines.append(head)
            lines.append(" | ".join(row))
        title = None if len(body) <= rules.SHEET_ROWS else f"Data - rows {lo + 2}-{lo + 1 + len(part)}"  # the header is row 1
        out.append((len(out) + 1, title, "\n".join(lines or [head]), "table"))
    return out


def guard_zip(raw: bytes) -> None:
    """Office containers whose content would unpack beyond bounds are refused."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        total = sum(i.file_size for i in z.infolist())
    if total > ZIP_BYTES or total > ZIP_CHECKED and total > ZIP_RATIO * max(1, len(raw)):
        raise ValueError(f"container unpacks to {total} bytes")


def parse_docx(raw: bytes, name: str) -> list[Page]:
    guard_zip(raw)
    import docx

    doc = docx.Document(io.BytesIO(raw))
    text = "\n\n".join(p.text for p in doc.paragraphs)
    tables = ["\n".join(" | ".join(c.text for c in r.cells) for r in t.rows) for t in doc.tables]
    return [(i, title_of(c), c, "text") for i, c in enumerate(chunks("\n\n".join([text, *tables])), 1)]


def parse_pptx(raw: bytes, name: str) -> list[Page]:
    guard_zip(raw)
    import pptx

    out = []
    for i, slide in enumerate(pptx.Presentation(io.BytesIO(raw)).slides, 1):
        title = slide.shapes.title.text if slide.shapes.title else None
        body = [s.text_frame.text for s in slide.shapes if s.has_text_frame]
        body += ["\n".join(" | ".join(c.text for c in r.cells) for r in s.table.rows) for s in slide.shapes if s.has_table]
        notes = slide.notes_slide.notes_text_frame.text if slide.has_notes_slide else ""
        out.append((i, title, "\n".join([*body, *([f"Notes: {notes}"] if notes else [])]), "slide"))
    return out


def workbook(raw: bytes) -> dict[str, list[list[str]]]:
    guard_zip(raw)
    import openpyxl

    book = openpyxl.load_workbook(io.BytesIO(raw), read_only=True, data_only=True)
    cell = lambda v: "" if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)
    return {s.title: [[cell(v) for v in r] for r in s.iter_rows(values_only=True)] for s in book.worksheets}


def parse_xlsx(raw: bytes, name: str) -> list[Page]:
    out: list[Page] = []
    for sheet, rows in workbook(raw).items():
        text = io.StringIO()
        csv.writer(text).writerows(rows)
        out += [(len(out) + 1 + i, t, x, k) for i, (_, t, x, k) in enumerate(parse_csv(text.getvalue().encode(), sheet))]
    return out


def parse_pdf(raw: bytes, name: str) -> list[Page]:
    import fitz

    with fitz.open(stream=raw, filetype="pdf") as doc:
        return [(i, title_of(t), t, "text") for i, t in enumerate((p.get_text() for p in doc), 1)]


def parse_image(raw: bytes, name: str) -> list[Page]:
    return [(1, None, f"[Image: {name}, {len(raw)} bytes]", "image")]


#: Parsers by MIME type, then by its main type.
PARSERS: dict[str, Callable[[bytes, str], list[Page]]] = {
    "text/html": parse_html, "text/csv": parse_csv, "text/*": parse_text, "application/json": parse_text, "application/pdf": parse_pdf, "image/*": parse_image,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": parse_docx, "application/vnd.openxmlformats-officedocument.presentationml.presentation": parse_pptx,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": parse_xlsx,
}


def register_parser(mime: str, parser: Callable[[bytes, str], list[Page]]) -> None:
    PARSERS[mime] = parser


def parser_for(mime: str) -> Callable[[bytes, str], list[Page]] | None:
    return PARSERS.get(mime) or PARSERS.get(mime.split("/")[0] + "/*")


def parse(raw: bytes, mime: str, name: str) -> list[Page]:
    parser = parser_for(mime)
    if parser is None:
        raise ValueError(f"no parser for {mime}")
    pages = parser(raw, name)
    if len(pages) > MOST_PAGES:
        raise ValueError(f"{len(pages)} pages are more than {MOST_PAGES}")
    return pages


def scan(spark: SparkSession, root: str, *, exclude: list[str] | None = None, keep_content: bool = True) -> DataFrame:
    """(source_path, filename, file_size, modified_at, mime_type, checksum, content) of the files below ``root`` that an index takes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?" + re.escape(base) + "/", "")
    rows = rows.withColumn("source_path", relative).where(~ws.excluded(F.col("source_path"), exclude))
    out = rows.select("source_path", F.element_at(F.split("source_path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), ws.mime_of(F.col("source_path"), F.substring("content", 1, 4)).alias("mime_type"), F.sha2("content", 256).alias("checksum"), "content")
    return out if keep_content else out.drop("content")


def pages(files: DataFrame) -> DataFrame:
    """(file_id, page_number, section_title, text, content_type, error) of files (file_id, filename, mime_type, content); a failure is a row with an error."""
    parsers = dict(PARSERS)

    def run(batches):
        PARSERS.update(parsers)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out += [(r.file_id, *p, None) for p in parse(bytes(r.content), r.mime_type, r.filename)]
                except Exception as e:  # a broken file must not end the scan of the others; it becomes a failed row
                    out.append((r.file_id, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["file_id", "page_number", "section_title", "text", "content_type", "error"])

    return files.select(F.col("file_id").cast("string").alias("file_id"), "filename", "mime_type", "content").mapInPandas(run, PAGES)


def chunk_column(text: Column) -> Column:
    """Chunks of a text as an array: the greedy fold as a column expression."""
    parts = F.split(text, r"\n\s*\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("used"))

    def step(acc, p):
        full = acc["open"].isNotNull() & (acc["used"] + F.length(p) > rules.CHUNK_CHARS)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p)).alias("open"),
            F.when(full, F.length(p)).otherwise(acc["used"] + F.length(p) + 2).alias("used"),
        )

    folded = F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.when(F.length(text) <= rules.CHUNK_CHARS, F.array(text)).otherwise(folded)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, page_number, values) of a CSV file with a header, 100 rows a page.

    Rows are numbered within the partitions that read them; a partition's offset comes from the counts of those before it.
    """
    rows = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    pairs = F.struct(*[F.col(f"`{c}`").alias(c) for c in rows.columns])
    at = F.monotonically_increasing_id()
    numbered = rows.select(pairs.alias("values"), F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at"))
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    number = F.col("at") + F.col("before") + 1
    met = numbered.join(F.broadcast(offsets), F.col("part") == F.col("p"))
    return met.select(number.alias("row_number"), (F.floor((number - 1) / rules.SHEET_ROWS) + 1).cast("int").alias("page_number"), "values")


def structured(raw: bytes, mime: str, name: str, sheet: str | None = None) -> dict:
    """{sheets: [{name, columns, rows, total_rows}]} of a CSV file or workbook."""
    tables = {name: sheet_rows(raw)} if mime == "text/csv" else workbook(raw)
    found = {n: r for n, r in tables.items() if sheet is None or n == sheet}
    return {"sheets": [{"name": n, "columns": r[0] if r else [], "rows": r[1:], "total_rows": max(0, len(r) - 1)} for n, r in found.items()]}


def lines(spark: SparkSession, root: str, *, pattern: str | None = None) -> DataFrame:
    """(source_path, text) of the files that a grep reads: listed folders, suffixes and large files left out, bad bytes replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (rows.option("pathGlobFilter", pattern) if pattern else rows).load(root)
    relative = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?" + re.escape(root.rstrip("/")) + "/", "")
    rows = rows.where(F.col("length") <= rules.GREP_MOST_BYTES).withColumn("source_path", relative).where(~ws.grep_skipped(F.col("source_path")))
    return rows.select("source_path", F.col("content").cast("string").alias("text"))
