import numpy as np
import pytest

from skarn.llm import ann


def cos(a, b):
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[100:400] = x[100]  # a very common vector
    x[400:500] = x[100] * 2
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(x)]
    bad = [(5000, None, "k"), (5050, [0.0] * 24, "k"), (5100, [None] + [1.0] * 23, "k"), (5150, [float("nan")] + [1.0] * 23, "k"), (5200, [float("inf")] + [1.0] * 23, "k"), (5250, [1.0, 2.0], "k"), (None, [1.0] * 24, "k"), rows[50]]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, key string"), x.astype(np.float64)


def test_recall_scores_and_ties(vectors):
    df, x = vectors
    got: dict = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 50))
    hit = total = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        for _, v, s in rows:
            assert v != q and s == pytest.approx(cos(x[q], x[v]), abs=1e-12)
        sims = np.array([cos(x[q], v) for v in x])
        sims[q] = -2
        top = np.lexsort((np.arange(len(x)), -sims.round(12)))[:5]
        hit += len({r[1] for r in rows} & set(top.tolist()))
        total += 5
    assert hit / total >= 0.9
    assert [r[1] for r in got[150]][:3] == [100, 101, 102]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert ann.nearest(df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 0")).collect() == []
    assert ann.nearest(spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")).collect() == []


def test_lists_are_balanced_and_the_graph_finds_the_nearest():
    x = np.random.default_rng(5).standard_normal((4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x, 4000)
    sizes = np.bincount([l[0] for l in index.lists_of(x)], minlength=len(index.centroids))
    assert sizes.max() < 4 * sizes.mean()
    ids, _ = index.nearest(x[:200], 5)
    want = (x[:200] @ index.centroids.T).argmax(axis=1)
    assert (ids[:, 0] == want).mean() > 0.98


def test_slices(vectors, monkeypatch):
    df, _ = vectors
    want = sorted(map(tuple, ann.nearest(df).collect()))
    monkeypatch.setattr(ann, "SLICE", 20)
    assert sorted(map(tuple, ann.nearest(df).collect())) == want


def test_lists_read_follow_the_need():
    """Where vectors lie in all directions, neighbours are spread over most lists: more than any fixed number is read."""
    x = np.random.default_rng(7).standard_normal((30_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x[:12_000], 90_000, 0.999)
    assert len(index.centroids) == 900 and index.lists > 256
    q = np.arange(20_000, 20_100)
    s = x[q] @ x[12_000:].T
    s[np.arange(len(q)), q - 12_000] = -2
    top = np.argsort(-s, axis=1)[:, :5] + 12_000
    kept = dict(zip(np.unique(top).tolist(), index.lists_of(x[np.unique(top)])))
    read = index.lists_for(x[q])
    assert np.mean([bool(np.isin(kept[int(t)], r).any()) for r, row in zip(read, top) for t in row]) >= 0.99


def test_what_a_fit_measures_holds_for_other_vectors():
    """Recall and work that fit() tells, against brute force on vectors that it hasn't seen, with and without clusters."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((300, 32))
    for name, x in (("clusters", centres[rng.integers(0, 300, 14_000)] + 0.3 * rng.standard_normal((14_000, 32))), ("none", rng.standard_normal((14_000, 32)))):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        index = ann.fit(x[:8000], 30_000)
        rest, q = x[8000:], x[8000:8150]
        s = q @ rest.T
        s[np.arange(150), np.arange(150)] = -2
        top = np.argsort(-s, axis=1)[:, :5]
        kept = index.lists_of(rest)
        read = index.lists_for(q)
        found = np.mean([bool(np.isin(kept[t], r).any()) for r, row in zip(read, top) for t in row])
        work = np.mean([len(r) for r in read]) / len(index.centroids) * np.mean([len(k) for k in kept])
        assert found >= 0.95 and abs(found - index.recall) < 0.03, name
        assert work < 1.05 and abs(work - index.work) < 0.2, name
        if name == "clusters":
            assert index.copies > 1 and work < 0.1


def test_a_search_by_the_graph_finds_what_ranking_all_finds():
    x = np.random.default_rng(10).standard_normal((6000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x, 40_000)
    for held in (1, 5, 64, 300, len(index.centroids)):
        ids, d = index.nearest(x[:100], held)
        want = np.argsort(-x[:100] @ index.centroids.T, axis=1)[:, :held]
        assert ids.shape == (100, held) and (np.diff(d, axis=1) >= 0).all()
        assert all(len(set(row)) == held for row in ids.tolist())
        assert np.mean([len(set(a) & set(b)) / held for a, b in zip(ids.tolist(), want.tolist())]) > 0.98


def test_recall_that_is_too_low_is_an_error(monkeypatch):
    x = np.random.default_rng(11).standard_normal((5000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "_reach", lambda *a: (1, 1.0))
    monkeypatch.setattr(ann, "LEAST_LISTS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        ann.fit(x, 50_000)
