"""Supersession against all pairs: copies, signals, dates, ties; candidates never travel as pairs."""

from __future__ import annotations

import random

import pytest

from lectern.functions import rules
from lectern.operators import memory, overlap, sequential

TAILS = ["", "", "", " 2024-01-02", " 2024/03/04", " Jan 5, 2024", " switched to"]


def texts(seed: int, n: int = 120) -> list[str]:
    """Texts of few words, half of them altered copies of earlier ones."""
    r = random.Random(seed)
    words = [f"w{i:03d}" for i in range(r.choice([8, 30, 80]))]
    out: list[str] = []
    for _ in range(n):
        t = r.choice(out).split() if out and r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            if t:
                t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t) + r.choice(TAILS))
    return out


def fits(a: str, b: str) -> float | None:
    """The overlap by which ``a`` supersedes ``b``, if it does."""
    x, y, p, q = sequential.token_set(a), sequential.token_set(b), sequential.date_set(a), sequential.date_set(b)
    least = rules.SIGNALLED_OVERLAP if sequential._SIGNAL.search(a) else rules.PLAIN_OVERLAP
    value = len(x & y) / len(x | y) if x and y else 0.0
    return value if len(x) > 1 and value >= least and not (p and q and not p & q) else None


@pytest.mark.parametrize("block", [10, 100_000])
def test_conflicts_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "BLOCK", block * 5)
    for seed in (1, 2):
        rows = [(i, t, ("semantic", "episodic", "procedural")[i % 3], 1.0 if i % 11 else 0.1, i % 13 == 0, None) for i, t in enumerate(texts(seed))]
        df = spark.createDataFrame(rows, "memory_id bigint, content string, memory_type string, confidence double, pinned boolean, valid_to timestamp")
        want = {}
        for i, a, kind, *_ in rows:
            met = [(-v, j) for j, b, k, c, pin, _ in rows if kind != "episodic" and j != i and k == kind and c >= 0.3 and not pin and (v := fits(a, b)) is not None]
            if met:
                want[i] = (min(met)[1], round(-min(met)[0], 9))
        assert len(want) > 10
        assert {r.new_id: (r.old_id, round(r.overlap, 9)) for r in memory.conflicts(df, df).collect()} == want


def test_conflicts_shuffle_no_pairs(spark):
    """60 copies of 40 memories: what joins make is as many rows as memories, not their pairs by shared words."""
    rows = [(i, f"alpha{i % 40} beta{i % 40} gamma{i % 40} common words here {i % 40:04d}", "semantic", 1.0, False, None) for i in range(2400)]
    df = spark.createDataFrame(rows, "memory_id bigint, content string, memory_type string, confidence double, pinned boolean, valid_to timestamp")
    out = memory.conflicts(df, df)
    assert {r.new_id: r.old_id for r in out.collect()} == {i: i % 40 if i >= 40 else i + 40 for i in range(2400)}
    todo, most = [out._jdf.queryExecution().executedPlan()], 0
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    todo = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name.endswith("JoinExec"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 2 * 2 * 2400


def test_prefix_of_sets_holds_enough():
    assert overlap.prefix_sizes(overlap.np.array([20, 2, 0]), 0.65).tolist() == [20 - 13 + overlap.SHARED, 2, 0]


def test_superseded_state_of_copies(spark):
    """30 copies of 20 memories stored once more: each takes the place of the least copy of its text."""
    rows = [(i, f"alpha{i % 20} beta{i % 20} gamma{i % 20} common words here", "semantic", "[]", "{}", False, "unknown", 1.0, 0, None, None, None) for i in range(600)]
    df = spark.createDataFrame(rows, "memory_id bigint, content string, memory_type string, tags string, metadata string, pinned boolean, source string, confidence double, access_count bigint, last_accessed timestamp, valid_to timestamp, superseded_id bigint")
    df = df.selectExpr("*", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS updated_at", "timestamp'2024-01-01' AS valid_from")
    again = df.selectExpr("memory_id + 1000 AS memory_id", "content", "memory_type", "tags", "metadata", "pinned", "source")
    state, old = memory.superseded(df, again, "2024-06-01")
    want = {i: None for i in range(20, 600)} | {i + 1000: i % 20 for i in range(600)}
    assert {r.memory_id: r.superseded_id for r in state.collect()} == want
    assert {r.memory_id for r in old.collect()} == set(range(20))
