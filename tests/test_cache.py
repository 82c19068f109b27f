"""The cache keeps its layout, and lookups leave it where it lies."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn.sources import cache


@pytest.fixture
def small(spark):
    """Joins as they are for large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def answers(spark, keys, raw="r"):
    return spark.createDataFrame([(f"k{k}", f"{raw}{k}" if raw else None) for k in keys], "cache_key string, raw string")


def cache_side(df):
    """The part of the plan that reads the cache."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan


def test_lookups_do_not_move_the_cache(small, tmp_path):
    path = str(tmp_path / "c")
    cache.add_answers(answers(small, range(200)), path, buckets=8)
    cache.add_answers(answers(small, range(150, 260)), path, buckets=4)
    rows = answers(small, range(190, 300)).select("cache_key").withColumn("more", F.lit(1))
    found = cache.look_up(rows, path)
    plan = cache_side(found)
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(cache_key" in plan and "Bucketed: true" in plan, plan
    got = {r["cache_key"]: (r["raw"], r["cache_hit"]) for r in found.collect()}
    assert len(got) == 110 and got["k195"] == ("r195", True) and got["k259"] == ("r259", True) and got["k260"] == (None, False)
    assert cache.read_cache(small, path).count() == 260


def test_appends_are_unique_and_keep_the_buckets(small, tmp_path):
    path = str(tmp_path / "c")
    for _ in range(3):
        cache.add_answers(answers(small, [1, 2, 2, 3]).union(answers(small, [9], raw="")), path, buckets=4)
    assert sorted(r["cache_key"] for r in cache.read_cache(small, path).collect()) == ["k1", "k2", "k3"]
    assert (tmp_path / "c" / "_layout").read_text() == "4"
    names = {p.name.rsplit("_", 1)[1].split(".")[0] for p in Path(path).rglob("*.parquet")}
    assert names <= {f"{i:05d}" for i in range(4)}


def test_another_session_finds_the_cache(small, tmp_path):
    path = str(tmp_path / "c's")
    cache.add_answers(answers(small, range(5)), path, buckets=4)
    name, n = cache._table(small, path, cache.ANSWERS_DDL, 64)
    assert n == 4
    small.sql(f"DROP TABLE {name}")
    assert cache.read_cache(small, path).count() == 5
    cache.add_answers(answers(small, range(3, 7), raw="new"), path)
    assert {r["raw"] for r in cache.read_cache(small, path).collect()} == {"r0", "r1", "r2", "r3", "r4", "new5", "new6"}


def test_a_cache_that_is_not_there(small, tmp_path):
    found = cache.look_up(answers(small, range(3)).drop("raw"), str(tmp_path / "none"))
    assert {(r["raw"], r["cache_hit"]) for r in found.collect()} == {(None, False)}
