"""The pipeline's near-duplicate stage against all pairs' similarity of five-word shingles."""

from __future__ import annotations

import itertools
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import corpus, frame, prose

import corpus_pipeline

CLASH = "n key node root lectern_id hashes kept_id"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_ids(texts):
    """The least number of each component of texts at similarity 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(texts))}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def test_near_copies_go(spark):
    rng = random.Random(8)
    texts = [t for _, t, *_ in corpus(20)]
    for n in (60, 150, 400):  # edits leave similarities on both sides of 0.8
        base = prose(rng, "en", n)
        texts += [base, *(edited(rng, base, 1 + k % (n // 25)) for k in range(12))]
    chain = [prose(rng, "fr", 200)]
    for _ in range(6):  # neighbours are similar, the ends are not
        chain.append(edited(rng, chain[-1], 3))
    texts += chain
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = frame(spark, rows, CLASH)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and len(got) == len(set(got))
    assert set(got) == least_ids(texts)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    a, b = prose(rng, "en", 100), prose(rng, "de", 100)
    rows = [(1, a, "en", "s", 0), (1, a + " end", "en", "s", 0), (1, b, "de", "s", 0), (None, b + " ende", "de", "s", 0), (None, None, None, None, None), (7, "", "en", "s", 0)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()]
    assert len(got) == 3 and {(1, b), (7, "")} < set(got) and sum(t in (a, a + " end") for _, t in got) == 1


def test_fingerprints_meet_in_balls(spark):
    """The stage's own SimHash against a plain one, and its pairs against all fingerprints' distances."""
    from lectern.llm import near

    rng = random.Random(10)
    base = prose(rng, "en", 900)
    texts = [base, *(edited(rng, base, 1 + k % 3) for k in range(8)), *(prose(rng, "de", 60) for _ in range(10)), "", None, "one two"]
    sets = [near.shingles((t or "").encode()) for t in texts]
    prints = []
    for s in sets:
        plain = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
        assert near.fingerprint(s) == plain
        prints.append(plain)
    nodes = [(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts))}
    assert sum(want[i] == 0 for i in range(9)) > 4  # near copies do meet
    pairs = [tuple(r) for r in near.ball_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 and a > b for a, b in pairs)
    root[:] = range(len(texts))
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(texts))} == want


def test_crowded_keys_stay_linear(spark, monkeypatch):
    """Many copies on both sides of 0.8 share keys and stay apart: right components without comparing them pair by pair."""
    from lectern.llm import near

    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(10**9)}" for _ in range(120))
    texts = [edited(rng, base, rng.choice((1, 2, 3, 3, 4, 4))) for _ in range(400)]
    texts += [edited(rng, rng.choice(texts[:400]), 1) for _ in range(40)]  # similar to one copy rather than to the centre
    compared, whole = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, sets: compared.append(pairs.count()) or whole(pairs, sets))
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), "")
    assert {r.doc_id for r in kept.collect()} == least_ids(texts)
    assert sum(compared) < 16 * len(texts)


def test_crowds_miss_no_similar_pair(spark):
    """Links and pairs of a crowd against all pairs, also where the centre is empty or two groups share a crowd."""
    from lectern.llm import near

    rng = random.Random(12)
    for groups in (1, 2, 5):
        sets = []
        for _ in range(groups):
            core = rng.sample(range(10**6), 60)
            for _ in range(60 // groups):
                own = set(core) - set(rng.sample(core, rng.randrange(9)))
                sets.append(own | set(rng.sample(core[:4], 1)) | {rng.randrange(10**6) for _ in range(rng.randrange(9))})
        roots = [i if rng.random() < 0.8 else 0 for i in range(len(sets))]
        members = spark.createDataFrame([(7, i, r) for i, r in enumerate(roots)], "crowd long, node long, root long")
        held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, hashes array<long>")
        similar = {(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
        sure, pairs = ({tuple(r) for r in x.collect()} for x in near.crowd_pairs(members, held))
        assert sure <= similar and similar

        def parts(links):
            root = list(range(len(sets)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in [*links, *((i, r) for i, r in enumerate(roots))]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            return [find(i) for i in range(len(sets))]

        assert parts(sure | pairs & similar) == parts(similar)
