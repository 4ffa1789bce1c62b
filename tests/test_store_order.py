"""Ordered stores against all pairs, and the sets that they compare."""

from __future__ import annotations

import random

import pandas as pd
from test_supersede import fits, texts

from lectern.operators import sequential


def test_stores_in_order_ask_rare_words_alone(monkeypatch):
    """Common words meet nobody: sets compared grow with those that overlap, not with the square of the stores."""
    r = random.Random(3)
    common = [f"common{i}" for i in range(8)]
    rows = [("w", "semantic", n, f"m{n}", " ".join(common + [f"own{r.randrange(10**9)}" for _ in range(20)])) for n in range(400)]
    df = pd.DataFrame(rows, columns=["workspace_id", "memory_type", "seq", "memory_id", "content"])
    met = 0

    class Counting(frozenset):
        def __and__(self, other):
            nonlocal met
            met += 1
            return frozenset.__and__(self, other)

    monkeypatch.setattr(sequential, "token_set", lambda text, f=sequential.token_set: Counting(f(text)))
    monkeypatch.setattr(sequential, "frozenset", Counting, raising=False)
    assert sequential.run_stores(df, 0.3).superseded_id.isna().all()
    assert met < 400


def test_stores_in_order_are_those_of_all_pairs():
    for seed in range(12):
        rows = [("w", "semantic", n, f"m{n}", t) for n, t in enumerate(texts(seed))]
        live, want = {}, {}
        for _, _, n, m, t in rows:
            met = [(-v, k) for k, (_, b) in live.items() if (v := fits(t, b)) is not None]
            want[m] = live.pop(min(met)[1])[0] if met else None
            live[n] = (m, t)
        df = pd.DataFrame(rows, columns=["workspace_id", "memory_type", "seq", "memory_id", "content"])
        got = sequential.run_stores(df, 0.3)
        assert dict(zip(got.memory_id, got.superseded_id.where(got.superseded_id.notna(), None))) == want
