import hashlib
import math
import random

import numpy as np
import pytest

from skarn.llm import centroid_clusters as C
from skarn.llm.queries import OP13_SQL

DDL = "vec_id long, embedding array<double>, cluster string, q int"


def brute(rows, k=8, rounds=10, seed=3, dim=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), [x.to_bytes(4, "little", signed=True) for x in r[1]] if max(map(abs, r[1])) < 2**31 else []))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = lambda j: sum(d for _, c, d in found if c == j)
    fits = lambda x: x if x < 2**63 else None
    sha = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    total = sum(d for *_, d in found)
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    return sorted(((i, j, fits(d), fits(of(j)), fits(total), sha(j)) for i, j, d in found), key=key)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], DDL)
    return sorted((tuple(r) for r in C.cluster(df, **kw).collect()), key=lambda r: tuple((x is None, x or 0) for x in r[:3]))


def vectors(rng, n, dim=64, spread=0.2):
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = vectors(rng, 150)
    rows += [(None, rows[3][1]), rows[4], (900, rows[5][1]), (901, [0.0] * 64), (902, [-1e-9] * 64), (903, [0.0009765625] * 64)]
    out_of_place = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [float("nan")] * 64), (1006, [float("inf")] + [0.0] * 63)]
    assert got(spark, rows + out_of_place) == brute(rows)


def test_ties_copies_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert got(spark, same) == brute(same)
    grid = [(i, [float(i % 2), float(i // 2 % 2)]) for i in range(30)]
    assert got(spark, grid, k=5, dim=2) == brute(grid, k=5, dim=2)
    assert got(spark, grid[:3], dim=2) == brute(grid[:3], dim=2)


def test_integers_beyond_long_are_exact(spark):
    rows = [(i, [float(i), 10.0 ** (i % 5)]) for i in range(12)] + [(20, [1e6, -3e5]), (21, [1e12, 1e12]), (22, [-1e300, 5e17])]
    assert got(spark, rows, k=3, dim=2) == brute(rows, k=3, dim=2)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert C.cluster(spark.createDataFrame([], DDL)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_screen_prunes_and_never_changes_the_answer():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 64))
    near = C.quantised(0.2 * (centres[rng.integers(0, 16, 2000)] + 0.3 * rng.normal(size=(2000, 64))))
    for q, c in ((near, C.quantised(0.2 * centres)), (C.quantised(rng.normal(size=(500, 64))), C.quantised(rng.normal(size=(16, 64))))):
        best, distance, exact = C.nearest(q, C.segment_norms(q), c.astype(object))
        full = ((q[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        if q is near:
            assert exact < 1.1 * len(q)


@pytest.mark.parametrize("n", [3, 60])
def test_sql(spark, tmp_path, n):
    import duckdb

    rows = vectors(random.Random(n), n)
    con = duckdb.connect()
    spark.createDataFrame(rows + [(99, None), (98, [1.0])], "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "e"))
    con.sql(f"create view embeddings as from '{tmp_path}/e/*.parquet'")
    rel = con.sql(OP13_SQL)
    at = [rel.columns.index(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert sorted(tuple(r[i] for i in at) for r in rel.fetchall()) == brute(rows)
