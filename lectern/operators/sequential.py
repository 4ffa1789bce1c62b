"""The ordered form of supersession: one group's stores in turn."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import pandas as pd

from lectern.functions import rules
from lectern.operators.overlap import SHARED

_SIGNAL, _DATE = re.compile(rules.UPDATE_SIGNAL, re.I), re.compile(rules.DATE, re.I)
_STOP = frozenset(rules.STOPWORDS)


def token_set(text: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"\W+", text.lower()) if len(w) > 2 and w not in _STOP)


def date_set(text: str) -> frozenset[str]:
    return frozenset(m.group().lower().replace("/", "-") for m in _DATE.finditer(text))


def run_stores(rows: pd.DataFrame, base: float) -> pd.DataFrame:
    """(workspace_id, memory_type, memory_id, superseded_id, closed_by) of one group's ordered stores.

    Live memories are found by their rarest words (``overlap``'s prefixes, in the group's own order of rarity), so common words meet nobody.
    """
    texts, named = rows.content.tolist(), [token_set(x) for x in rows.content]
    number = {w: n for n, (w, _) in enumerate(sorted(Counter(chain.from_iterable(named)).items(), key=lambda x: x[1]))}
    sets = [frozenset(number[w] for w in x) for x in named]
    del named
    dates = [date_set(x) for x in texts]
    least = [min(base, rules.SIGNALLED_OVERLAP) if _SIGNAL.search(x) else max(base, rules.PLAIN_OVERLAP) for x in texts]
    types, idents = rows.memory_type.tolist(), rows.memory_id.tolist()
    asks = [kind != "episodic" and len(x) > 1 for kind, x in zip(types, sets)]
    by_word: dict[float, dict[int, set[int]]] = {t: {} for t, ask in zip(least, asks) if ask}

    def prefix(n: int, t: float) -> list[int]:
        words = sorted(sets[n])
        return words[: max(0, len(words) - math.ceil(t * len(words) - 1e-9) + SHARED)]

    def drop(n: int) -> None:
        for t, index in by_word.items():
            for w in prefix(n, t):
                index[w].discard(n)

    live: dict[str, int] = {}
    out, closed = [], {}
    for n, (words, when, t, ident) in enumerate(zip(sets, dates, least, idents)):
        old = None
        if asks[n]:
            size, best, index = len(words), 0.0, by_word[t]
            met = Counter(chain.from_iterable(index.get(w, ()) for w in prefix(n, t)))
            floor = max(1, min(SHARED, math.ceil(t * size - 1e-9)))
            for m in sorted(m for m, k in met.items() if k >= floor):
                shared = len(words & sets[m])
                overlap = shared / (size + len(sets[m]) - shared)
                if overlap >= t and overlap > best and not (when and dates[m] and not when & dates[m]):
                    best, old = overlap, m
        if old is not None:
            drop(old)
            del live[idents[old]]
            closed[idents[old]] = ident
        if ident in live:  # stored anew under its own name
            drop(live[ident])
        live[ident] = n
        for t, index in by_word.items():
            for w in prefix(n, t):
                index.setdefault(w, set()).add(n)
        out.append((None if old is None else idents[old], ident))
    done = rows[["workspace_id", "memory_type", "memory_id"]].reset_index(drop=True)
    done["superseded_id"] = pd.Series([x for x, _ in out], dtype=object)
    done["closed_by"] = pd.Series([closed.get(x) for _, x in out], dtype=object)
    return done
