"""Symbols and imports of source code, by table functions over texts."""

from __future__ import annotations

import ast
import hashlib
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules

SYMBOLS = {"name": "string", "kind": "string", "qualified_name": "string", "start_line": "int", "end_line": "int", "signature": "string", "docstring": "string", "sig_hash": "string", "span_hash": "string"}
IMPORTS = {"target": "string", "link_type": "string", "context": "string"}

# Declarations and imports of JavaScript and TypeScript.
JS_PATTERNS = (
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\("),
)
JS_IMPORT = r"""(?:import\s+(?:.+?\s+from\s+)?|export\s+.+?\s+from\s+)['"]([^'"]+)['"]|require\(['"]([^'"]+)['"]\)"""
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _row(name: str, kind: str, qualified: str, first: int, last: int, signature: str, doc: str, lines: list[str]) -> dict:
    return {"name": name, "kind": kind, "qualified_name": qualified, "start_line": first, "end_line": last, "signature": signature, "docstring": doc, "sig_hash": _hash(signature), "span_hash": _hash("\n".join(lines[first - 1 : last]))}


def python_symbols(text: str) -> list[dict]:
    """Classes, functions and methods of Python code in order of appearance; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while todo:
        node, outer = todo.pop()
        inner = outer
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            inner = (*outer, node.name)
            if isinstance(node, ast.ClassDef):
                kind, signature = "class", node.name
            else:
                kind, a = ("method" if outer else "function"), node.args
                shown = [x.arg for x in (*a.posonlyargs, *a.args)]
                shown += [f"*{a.vararg.arg}"] if a.vararg else []
                shown += [x.arg for x in a.kwonlyargs]
                shown += [f"**{a.kwarg.arg}"] if a.kwarg else []
                signature = f"{node.name}({', '.join(shown)})"
            out.append(_row(node.name, kind, ".".join(inner), node.lineno, node.end_lineno or node.lineno, signature, ast.get_docstring(node) or "", lines))
        todo += [(x, inner) for x in reversed(list(ast.iter_child_nodes(node)))]
    return out


def script_symbols(text: str) -> list[dict]:
    """Classes and functions of JavaScript or TypeScript by declaration lines."""
    lines, out = text.split("\n"), []
    for kind, regex in JS_PATTERNS:
        for m in re.finditer(regex, text, re.M):
            line = text.count("\n", 0, m.start()) + 1
            out.append(_row(m[1], kind, m[1], line, line, m[1], "", lines))
    return out


def python_imports(text: str, source_path: str) -> list[dict]:
    """Candidate files of each import: a module and a package."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    modules = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            modules += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            modules.append(("." * node.level + (node.module or ""), node.lineno))
    out: dict[str, dict] = {}
    for module, line in modules:
        name = module.lstrip(".")
        dots, base = len(module) - len(name), name.replace(".", "/")
        if dots:
            folders = [x for x in posixpath.dirname(source_path).split("/") if x]
            base = posixpath.normpath("/".join([*folders[: max(0, len(folders) - dots + 1)], *([base] if base else [])]) or ".")
        if base and base != ".":
            for target in (f"{base}.py", f"{base}/__init__.py"):
                out.setdefault(target, {"target": target, "link_type": "import", "context": f"import {module} (line {line})"})
    return list(out.values())


def script_imports(text: str, source_path: str) -> list[dict]:
    """Candidate files of each relative import or require."""
    out: dict[str, dict] = {}
    for m in re.finditer(JS_IMPORT, text, re.S):
        name = m[1] or m[2] or ""
        if name.startswith("."):
            base = posixpath.normpath(posixpath.join(posixpath.dirname(source_path), name))
            line = text.count("\n", 0, m.start()) + 1
            for target in [base] if posixpath.splitext(base)[1] else [base + e for e in JS_ENDINGS]:
                out.setdefault(target, {"target": target, "link_type": "import", "context": f"import {name} (line {line})"})
    return list(out.values())


def symbols_of(text: str | None, path: str | None) -> list[dict]:
    """Symbols of a file by its suffix."""
    suffix = posixpath.splitext(path or "")[1].lower()
    return python_symbols(text or "") if suffix == ".py" else script_symbols(text or "") if suffix in rules.CODE_SUFFIXES else []


def imports_of(text: str | None, path: str | None) -> list[dict]:
    """Imports of a file by its suffix."""
    suffix = posixpath.splitext(path or "")[1].lower()
    return python_imports(text or "", path or "") if suffix == ".py" else script_imports(text or "", path or "") if suffix in rules.CODE_SUFFIXES else []


def extract(text: str | None, path: str | None) -> tuple[list[dict], list[dict]]:
    """(symbols, imports) of a file by its suffix."""
    return symbols_of(text, path), imports_of(text, path)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many parts as a shuffle has."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _found(files: DataFrame, read: Callable[[str | None, str | None], list[dict]], fields: dict[str, str], ident: str, text_col: str, path_col: str) -> DataFrame:
    """Rows (``ident``, fields) that ``read`` finds in code files.

    Parsing costs far more than its input's bytes tell, so files are dealt to as many parts as a shuffle has, and flat columns come back.
    """
    from lectern.operators.workspace import is_code

    rows = files.where(is_code(F.col(path_col))).select(F.col("file_id").alias(ident), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for r in read(t, p)]
            columns = [pa.array([r[c] for _, r in found], pa.int32() if kind == "int" else pa.string()) for c, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], names=[ident, *fields])

    schema = ", ".join([f"{ident} {files.schema['file_id'].dataType.simpleString()}", *[f"{c} {kind}" for c, kind in fields.items()]])
    return dealt(rows).mapInArrow(run, schema)


def symbols(files: DataFrame, *, text_col: str = "text", path_col: str = "source_path") -> DataFrame:
    """(file_id, name, kind, qualified_name, start_line, end_line, signature, docstring, sig_hash, span_hash) of code files."""
    return _found(files, symbols_of, SYMBOLS, "file_id", text_col, path_col)


def imports(files: DataFrame, *, text_col: str = "text", path_col: str = "source_path") -> DataFrame:
    """(from_file_id, target, link_type, context) of code files."""
    return _found(files, imports_of, IMPORTS, "from_file_id", text_col, path_col)


def backfill(files: DataFrame, known: DataFrame, **columns) -> DataFrame:
    """Symbols of code files that have none yet."""
    return symbols(files.join(known.select("file_id").distinct(), "file_id", "left_anti"), **columns)


def in_document(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Symbols of pages (file_id, page_number, ...) with lines counted in the assembled document; pages: as from ``page_ranges``."""
    at = pages.select("file_id", "page_number", F.col("line_start").alias("page_at"))
    return found.join(at, ["file_id", "page_number"]).withColumn("start_line", F.col("start_line") + F.col("page_at") - 1).withColumn("end_line", F.col("end_line") + F.col("page_at") - 1).drop("page_at")
