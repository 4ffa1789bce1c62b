"""DuckDB SQL of text rules and of BM25, for the oracles of ``catalog``."""

from __future__ import annotations

from lectern.functions import rules
from lectern.plans.query import Phrase, parse

STOPS = "[" + ", ".join(f"'{w}'" for w in rules.STOPWORDS) + "]"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({x})), '[\\p{{L}}\\p{{N}}]+')"


def hyphen_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)+')"


def index_tokens(x: str) -> str:
    return f"list_concat({words(x)}, flatten(list_transform({hyphen_words(x)}, lambda h: {words('h')})))"


def camel(x: str) -> str:
    """A token with spaces at its humps."""
    return f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"


def expansion(x: str) -> str:
    """Parts of identifiers with humps (with repeats; sets don't care, lists of an expansion are distinct)."""
    mixed = f"list_filter(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9]*'), lambda w: regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') AND contains({camel('w')}, ' '))"
    return f"list_distinct(flatten(list_transform({mixed}, lambda w: string_split(lower({camel('w')}), ' '))))"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w)))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def hits(tokens: str, p: Phrase) -> str:
    if p.prefix:
        return f"len(list_filter({tokens}, lambda w: starts_with(w, '{p.tokens[0]}')))"
    if len(p.tokens) == 1:
        return f"len(list_filter({tokens}, lambda w: w = '{p.tokens[0]}'))"
    same = " AND ".join(f"{tokens}[i + {k}] = '{t}'" for k, t in enumerate(p.tokens))
    return f"len(list_filter(range(1, len({tokens}) - {len(p.tokens) - 2}), lambda i: {same}))"


def bm25(source: str, ident: str, text: str, query: str, *, any_term: bool = False, two: bool = True, keep: str = "") -> str:
    """CTEs ending in ``scored`` (ident, keep, score): matches of ``query`` in ``source``."""
    phrases = parse(query, any_term=any_term)
    f = [hits("t0", p) + (f" + {rules.EXPANSION_WEIGHT} * " + hits("t1", p) if two else "") for p in phrases]
    names = [f"f{i}" for i in range(len(phrases))]
    raw = [f"ln((docs - n{i} + 0.5) / (n{i} + 0.5))" for i in range(len(phrases))]
    part = [f"(CASE WHEN {r} > 0 THEN {r} ELSE {rules.LEAST_IDF} END) * {n} * {rules.K1 + 1} / ({n} + {rules.K1} * (1 - {rules.B} + {rules.B} * len_ / avg_))" for r, n in zip(raw, names)]
    match = (" OR " if any_term else " AND ").join(f"{n} > 0" for n in names)
    extra = f", {keep}" if keep else ""
    return f"""toks AS (SELECT {ident}{extra}, {index_tokens(text)} AS t0, {expansion(text) if two else '[]'} AS t1 FROM {source}),
freq AS (SELECT {ident}{extra}, len(t0) + len(t1) AS len_, {', '.join(f'{x} AS {n}' for x, n in zip(f, names))} FROM toks),
tot AS (SELECT count(*) AS docs, avg(len_) AS avg_, {', '.join(f'count(*) FILTER ({n} > 0) AS n{i}' for i, n in enumerate(names))} FROM freq),
scored AS (SELECT {ident}{extra}, {' + '.join(part)} AS score FROM freq, tot WHERE {match})"""


def confidence(base: str, days: str, accesses: str, pinned: str) -> str:
    return f"CASE WHEN {pinned} OR {days} <= 0 THEN {base} ELSE {base} * pow(1 + {rules.FORGETTING_FACTOR} * ({days}) / ({rules.STABILITY_DAYS} * (1 + 0.5 * ln(1 + {accesses}))), -{rules.FORGETTING_POWER}) END"


def days(earlier: str, later: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"
