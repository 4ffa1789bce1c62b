"""Query strings to phrases: pure Python, run once on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from lectern.functions import rules

@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; with ``prefix`` the (only) token matches any token that starts with it."""

    tokens: tuple[str, ...]
    prefix: bool = False


def folded(text: str) -> str:
    """Lower case without the diacritics of Latin letters, as the index folds."""
    out = []
    for c in text.lower():
        d = unicodedata.normalize("NFD", c)
        out.append(d[0] if len(d) > 1 and d[0].isascii() else c)
    return "".join(out)


def query_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", folded(text)))


def terms(query: str) -> list[str]:
    """White-space terms without punctuation at their edges and without quotes."""
    stripped = (t.strip(rules.TERM_EDGES).replace('"', "").replace("'", "") for t in query.split())
    return [t for t in stripped if t]


def stem(term: str) -> str | None:
    """The term without the first listed suffix that leaves three characters; None if there is none."""
    if len(term) < 4 or not term.isalpha():
        return None
    return next((term[: -len(s)] for s in rules.SUFFIXES if term.lower().endswith(s) and len(term) - len(s) >= 3), None)


def parse(query: str, *, any_term: bool = False) -> list[Phrase]:
    """Phrases of a query.  ``any_term`` is the OR form: stopwords leave (unless nothing is left) and stems come as prefixes."""
    found = terms(query)
    if any_term:
        found = [t for t in found if t.lower() not in rules.STOPWORDS] or found
    out: list[Phrase] = []
    for term in found:
        out.append(Phrase(query_words(term)))
        if any_term and (root := stem(term)):
            out.append(Phrase(query_words(root), prefix=True))
    return [p for p in out if p.tokens]


def safe_pattern(pattern: str) -> str:
    """``pattern`` if it compiles and holds no quantified group with a quantifier inside."""
    if re.search(rules.NESTED_QUANTIFIER, pattern):
        raise ValueError(f"nested quantifiers may take forever: {pattern}")
    re.compile(pattern)
    return pattern


def page_spec(spec: str) -> list[int] | str:
    """``3``, ``3-7`` or ``1,3,5`` as page numbers; anything else is a section title."""
    spec = spec.strip()
    if re.fullmatch(r"\d+(,\d+)*", spec):
        return [int(x) for x in spec.split(",")]
    if m := re.fullmatch(r"(\d+)-(\d+)", spec):
        return list(range(int(m[1]), int(m[2]) + 1))
    return spec


def line_spec(spec: str) -> tuple[int, int | None]:
    """``a-b``, ``n`` or ``a-`` (to the end) as first and last line."""
    m = re.fullmatch(r"(\d+)(-(\d*))?", spec.strip())
    if not m:
        raise ValueError(f"not a range of lines: {spec}")
    return int(m[1]), int(m[1]) if m[2] is None else int(m[3]) if m[3] else None
