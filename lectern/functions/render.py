"""Plain-text renderings of collected rows for readers and prompts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

FENCE = "```"


def defused(text: str) -> str:
    """Stored text whose fences can't close the fence around it."""
    return text.replace(FENCE, "'''")


def preview(text: str, most: int = 500) -> str:
    return text if len(text) <= most else text[:most].rstrip() + "..."


def one_line(text: str) -> str:
    return " ".join(text.split())


def recall_block(rows: Iterable[Mapping], query: str) -> str:
    """Recalled memories inside a fence, marked as data."""
    body = [f"{i}. [{r['memory_type']}] {one_line(defused(preview(r.get('highlight') or r['content'])))} (score {r['score']:.3g})" for i, r in enumerate(rows, 1)]
    return "\n".join([f"Memories for: {one_line(query)}", FENCE, *(body or ["none"]), FENCE])


def profile(rows: Iterable[Mapping]) -> str:
    """Memories by type as a Markdown list, pinned ones first."""
    groups: dict[str, list[Mapping]] = {}
    for r in rows:
        groups.setdefault(r["memory_type"], []).append(r)
    out = []
    for kind in sorted(groups):
        out.append(f"## {kind}")
        out += [f"- {'(pinned) ' if r['pinned'] else ''}{one_line(preview(r['content']))}" for r in sorted(groups[kind], key=lambda r: not r["pinned"])]
    return "\n".join(out)


def evidence(hits: Iterable[Mapping]) -> str:
    """Numbered search hits with file, page and snippet."""
    return "\n\n".join(f"[{i}] {h['filename']}" + (f", page {h['page_number']}" if h.get("page_number") else "") + f"\n{defused(h['highlight'])}" for i, h in enumerate(hits, 1))
