"""Exact resamples: as many draws as clusters, one law at any number of clusters, the same draws in any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import resample as R


def clusters(spark, n):
    return spark.range(n).select(F.concat(F.lit("c"), F.col("id")).alias("k"), (F.col("id") % 2).cast("double").alias("m_num"), F.lit(1.0).alias("m_den"))


@pytest.mark.parametrize("n, resamples", [(1, 20), (100, 300), (100_000, 40)])
def test_every_resample_draws_as_often_as_there_are_clusters(spark, n, resamples):
    got = R.resample_sums(clusters(spark, n), "k", ["m_num", "m_den"], resamples).collect()
    assert sorted(r["r"] for r in got) == list(range(resamples))
    assert {(r["draws"], r["m_den"]) for r in got} == {(n, float(n))}


def test_draws_of_blocks_are_multinomial():
    sizes = np.array([10, 0, 30, 60, 1, 99, 0, 0])
    ends = np.concatenate([[0], sizes.cumsum()])
    n, times = int(sizes.sum()), 20_000
    draws = np.stack([R.block_draws(7, ends, b, times) for b in range(len(sizes))])
    assert (draws.sum(axis=0) == n).all() and (draws[sizes == 0] == 0).all()
    assert abs(draws.mean(axis=1) - sizes).max() < 0.2
    share = sizes / n
    assert abs(np.cov(draws) - n * (np.diag(share) - np.outer(share, share))).max() < 2
    assert not (R.block_draws(8, ends, 2, times) == draws[2]).all()


def test_places_are_even_and_differ_between_resamples():
    r = np.arange(2000)
    at = R.places(0, 3, r, np.full(2000, 50), 50).reshape(2000, 50)
    assert at.min() == 0 and at.max() == 49
    counts = np.bincount(at.ravel(), minlength=50)
    assert abs(counts - 2000).max() < 6 * 2000**0.5
    assert len({tuple(x) for x in at}) == 2000
    some = R.places(0, 3, r[5:7], np.array([4, 2]), 50)
    assert list(some) == [*at[5][:4], *at[6][:2]]


def test_the_law_is_one_at_any_block_size(spark, monkeypatch):
    """The interval of a rate has the width that the binomial law gives it, with one block and with many."""
    n = 3000
    for size in (4096, 64):
        monkeypatch.setattr(R, "BLOCK", size)
        out = R.bootstrap(clusters(spark, n), "k", ["m"], 2000).first()
        assert out["draws"] == 2000
        assert abs((out["high"] - out["low"]) - 2 * 1.96 * (0.25 / n) ** 0.5) < 0.003 and out["low"] < 0.5 < out["high"]


def test_resamples_equal_plain_draws(spark):
    """One block: the sums are those of a loop over the draws."""
    rng = random.Random(1)
    rows = [(f"k{i:02d}", float(rng.randrange(9)), float(rng.randrange(1, 9))) for i in range(37)]
    got = {r["r"]: r for r in R.resample_sums(spark.createDataFrame(rows, "k string, a double, b double").repartition(3), "k", ["a", "b"], 50, seed=4).collect()}
    for r in range(50):
        at = R.places(4, 0, np.array([r]), np.array([37]), 37)
        assert got[r]["a"] == sum(rows[i][1] for i in at) and got[r]["b"] == sum(rows[i][2] for i in at)


def test_partitioning_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50)
    rows = clusters(spark, 500)
    a, b = (sorted(map(tuple, R.resample_sums(x, "k", ["m_num", "m_den"], 30).collect())) for x in (rows.repartition(1), rows.repartition(9)))
    assert a == b


def test_null_statistics_and_odd_keys(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0), ("a", None, 1.0), ("b", 1.0, None)], "k string, m_num double, m_den double")
    out = R.bootstrap(rows, "k", ["m"], 200).first()
    assert out["low"] == 0.0 and out["draws"] <= 200
    assert R.bootstrap(rows, "k", ["m"], 0).count() == 0
