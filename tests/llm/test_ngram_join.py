"""Against all pairs, set by set."""

import random

import numpy as np
import pytest

from skarn.llm import ngram_join as J

LOWER = bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset() if not w else frozenset([tuple(w)] if len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def brute(rows, k, num, den):
    """component of each row by place."""
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b) and find(i) != find(j):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted((d if d is not None else -1, len(s), d if not s else low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df, k, num, den):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, k, num, den).collect())


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
def test_against_all_pairs(documents, k, num, den):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute(rows, k, num, den)
    want = [(d, n, c if n or d != -1 else None) for d, n, c in want]
    assert got(documents, k, num, den) == want


def test_groups_in_blocks(spark, monkeypatch):
    """A group too large for one task: many near copies of sizes over several bands, in a chain."""
    monkeypatch.setattr(J, "GROUP_SHINGLES", 400)
    rng = random.Random(3)
    words = [f"v{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(60)]
    rows, w = [], list(base)
    for i in range(60):
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(words)
        if i % 2:
            w.append(rng.choice(words))
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_empty(empty):
    assert J.jaccard_components(empty).collect() == []


def test_keep_one_keeps_all_columns(documents):
    kept = J.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {0, 1, 2, 9}.issubset(ids) and 10 not in ids and 11 not in ids and None in ids


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (1, 2), (95, 100)])
def test_linked_sets_meet_in_a_tile(num, den):
    """The promise that candidate search rests on, for random pairs just at the threshold."""
    rng, bands = np.random.default_rng(1), J.Bands(num, den)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(J.tile_keys(a, bands), J.tile_keys(b, bands)))


def test_canopies_keep_linked_pairs_together(monkeypatch):
    monkeypatch.setattr(J, "PAIRS_UP_TO", 4)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        at = rng.integers(0, 200, int(rng.integers(0, 40)))
        s[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    a, b = J._tile_edges(n, [J.signature(s) for s in sets], 85, 100)
    nodes, low = J.roots(a, b)
    root = dict(zip(nodes.tolist(), low.tolist()))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert root[i] == root[j]
