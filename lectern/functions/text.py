"""Tokens, token sets, expansions, highlights and dates as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import rules

CJK = "[\\u4e00-\\u9fff\\u3040-\\u309f\\u30a0-\\u30ff\\uac00-\\ud7af]"
NOT_CJK = CJK.replace("[", "[^", 1)
HYPHENED = r"[\p{L}\p{N}_]++(?:-[\p{L}\p{N}_]++)+"
HUMP = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
CAMEL_EDGE = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


@cache
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into an ASCII letter and marks, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), *_accents())


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(run: Column) -> Column:
    """Overlapping pairs of characters, then the single characters; a lone character is itself."""
    ones = F.filter(F.split(run, ""), lambda c: c != "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.concat(pairs, ones))


def segmented(token: Column) -> Column:
    """A token with CJK characters as its parts: CJK runs by bigrams, others whole."""
    parts = F.regexp_extract_all(token, F.lit(f"{CJK}+|{NOT_CJK}+"), F.lit(0))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(CJK), bigrams(p)).otherwise(F.array(p))))


def hyphen_words(text: Column) -> Column:
    return F.when(text.contains("-"), F.regexp_extract_all(text, F.lit(HYPHENED), F.lit(0))).otherwise(F.array().cast("array<string>"))


def index_tokens(text: Column) -> Column:
    """Tokens as an index holds them: all words, the parts of hyphened words once more, CJK runs by bigrams."""
    plain = F.when(text.contains("-"), F.concat(words(text), F.flatten(F.transform(hyphen_words(text), words)))).otherwise(words(text))
    cut = lambda t: F.flatten(F.transform(t, lambda x: F.when(x.rlike(CJK), segmented(x)).otherwise(F.array(x))))
    whole = F.get(F.transform(F.array(plain), lambda t: F.when(text.rlike(CJK), cut(t)).otherwise(t)), F.lit(0))
    return F.coalesce(whole, F.array().cast("array<string>"))


def camel_parts(token: Column) -> Column:
    """Parts of a camelCase identifier; empty for other tokens."""
    parts = F.split(token, CAMEL_EDGE)
    mixed = token.rlike(r"\p{Lu}") & token.rlike(r"\p{Ll}")
    return F.when(mixed & (F.size(parts) > 1), parts).otherwise(F.array().cast("array<string>"))


def expansion(text: Column) -> Column:
    """Distinct lower-cased parts of all camelCase identifiers of a text, in order, joined by spaces."""
    names = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), lambda n: n.rlike(HUMP))
    parts = F.array_distinct(F.transform(F.flatten(F.transform(names, camel_parts)), F.lower))
    return F.when(text.rlike(HUMP), F.array_join(parts, " ")).otherwise("")


def token_set(text: Column) -> Column:
    """Distinct lower-cased words of more than two characters that aren't stopwords."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
    return F.array_except(split, F.array(*[F.lit(w) for w in rules.STOPWORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint tokens of two token sets; zero if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dates(text: Column) -> Column:
    """Distinct explicit dates in lower case, with slashes as hyphens."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + rules.DATE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda d: F.replace(F.lower(d), F.lit("/"), F.lit("-"))))


def distinct_events(a: Column, b: Column) -> Column:
    """Both texts are dated and share no date."""
    x, y = dates(a), dates(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def supersede_threshold(content: Column, base: float = 0.3) -> Column:
    signalled = content.rlike("(?i)" + rules.UPDATE_SIGNAL)
    return F.when(signalled, min(base, rules.SIGNALLED_OVERLAP)).otherwise(max(base, rules.PLAIN_OVERLAP))


def highlight(text: Column, query: str, radius: int = rules.HIGHLIGHT_RADIUS) -> Column:
    """``radius`` characters on both sides of the earliest hit of any query term, else the head of the text."""
    terms = query.lower().split()
    head = F.substring(text, 1, rules.HIGHLIGHT_HEAD)
    if not terms:
        return head
    low = F.lower(text)
    hits = [F.nullif(F.locate(t, low), F.lit(0)) for t in terms]
    hit = hits[0] if len(hits) == 1 else F.least(*hits)
    start, end = F.greatest(F.lit(0), hit - 1 - radius), F.least(F.length(text), hit - 1 + radius)
    body = F.substring(text, start + 1, end - start)
    marked = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(hit.isNull(), head).otherwise(marked)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two spaces before and one behind."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
