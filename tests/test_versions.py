"""Versioned tables: readers see whole versions, lost races are noticed, guards leave the table as it is."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn.sources import versions


def table(tmp_path):
    return str(tmp_path / "t")


def commit(spark, path, n, **kw):
    return versions.write(spark.range(n), path, versions.current(spark, path), **kw)


def test_versions_follow_one_another(spark, tmp_path):
    path = table(tmp_path)
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert commit(spark, path, 3).number == 1 and commit(spark, path, 5).number == 2
    assert versions.read(spark, path).count() == 5 and versions.read(spark, path, number=1).count() == 3
    assert commit(spark, path, 2, append=True).number == 3 and versions.read(spark, path).count() == 7
    with pytest.raises(ValueError):
        versions.read(spark, path, number=9)


def test_a_plain_table_becomes_a_versioned_one(spark, tmp_path):
    path = table(tmp_path)
    spark.range(4).write.parquet(path)
    assert versions.read(spark, path).count() == 4
    commit(spark, path, 2, append=True)
    assert versions.read(spark, path).count() == 6
    commit(spark, path, 1)
    assert versions.read(spark, path).count() == 1 and versions.read(spark, path, number=1).count() == 6
    assert spark.read.parquet(path).count() == 4


def test_one_of_two_writers_is_refused(spark, tmp_path):
    path = table(tmp_path)
    base = commit(spark, path, 3)
    versions.write(spark.range(10), path, base)
    with pytest.raises(versions.RefusedError, match="another writer"):
        versions.write(spark.range(20), path, base)
    assert versions.read(spark, path).count() == 10
    assert len(list(Path(path).glob("_data-*"))) == 2


def test_of_many_writers_at_once_just_one_commits(spark, tmp_path):
    path = table(tmp_path)
    base, outcome = commit(spark, path, 1), []

    def writer(n):
        try:
            outcome.append(versions.write(spark.range(n), path, base).number)
        except versions.RefusedError:
            outcome.append(None)

    threads = [threading.Thread(target=writer, args=(10 + i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, outcome)) == ["2"] + ["None"] * 5 and versions.numbers(spark, path) == [1, 2]


def test_readers_never_fail_or_see_a_mix(spark, tmp_path):
    path, stop, seen, failed = table(tmp_path), threading.Event(), set(), []
    versions.write(spark.range(40).select(F.lit(0).alias("v")), path, None)

    def reader():
        while not stop.is_set():
            try:
                seen.add(tuple(sorted((r["v"], r["count"]) for r in versions.read(spark, path).groupBy("v").count().collect())))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=reader)
    t.start()
    for v in range(1, 6):
        versions.write(versions.read(spark, path).select(F.lit(v).alias("v")), path, versions.current(spark, path))
    stop.set()
    t.join()
    assert not failed and seen and all(len(s) == 1 and s[0][1] == 40 for s in seen)


def test_a_write_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = table(tmp_path)
    commit(spark, path, 3)

    def dies(*a):
        raise KeyboardInterrupt

    for step in ("create_once", "filesystem"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, dies)
            with pytest.raises(KeyboardInterrupt):
                versions.write(spark.range(9), path, versions.Version(path, 1, ()))
        assert versions.read(spark, path).count() == 3 and versions.numbers(spark, path) == [1]
    assert versions.vacuum(spark, path, older_than=3600) == 0 and versions.vacuum(spark, path, older_than=-5) == 1
    assert versions.read(spark, path).count() == 3


def test_counters_come_from_the_pass_that_writes(spark, tmp_path):
    path, runs = table(tmp_path), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = spark.range(1000).repartition(7).mapInArrow(counted, "id long").withColumn("odd", F.col("id") % 2 == 1)
    v = versions.write(rows, path, None, {"n": F.count("*"), "odd": F.count_if("odd"), "most": F.max("id")}, drop=("odd",))
    assert v.counters == {"n": 1000, "odd": 500, "most": 999} and runs.value == 1000
    assert versions.current(spark, path).counters == v.counters and versions.read(spark, path).columns == ["id"]


def test_a_guard_stops_the_write(spark, tmp_path):
    path = table(tmp_path)
    commit(spark, path, 3)
    with pytest.raises(versions.RefusedError, match="2 failed"):
        commit(spark, path, 9, counters={"failed": F.count_if(F.col("id") > 6)}, guard=lambda c: f"{c['failed']} failed" if c["failed"] else None)
    assert versions.read(spark, path).count() == 3 and len(list(Path(path).glob("_data-*"))) == 1


def test_a_rename_that_does_not_overwrite(spark, tmp_path):
    fs, a = versions.filesystem(spark, f"file://{tmp_path}/a")
    b = versions.filesystem(spark, f"file://{tmp_path}/b")[1]
    (tmp_path / "a").write_text("1")
    versions._rename_once(spark, a, b)
    (tmp_path / "a").write_text("2")
    with pytest.raises(Exception, match="xist"):
        versions._rename_once(spark, a, b)
    assert (tmp_path / "b").read_text() == "1"


def test_old_versions_are_kept_while_they_may_be_read(spark, tmp_path):
    path = table(tmp_path)
    for n in range(1, 5):
        commit(spark, path, n)
    old = versions.read(spark, path, number=1)
    assert versions.vacuum(spark, path, keep=2) == 0 and old.count() == 1
    assert versions.vacuum(spark, path, keep=2, older_than=-5) == 2 and versions.numbers(spark, path) == [3, 4]
    assert versions.read(spark, path, number=3).count() == 3 and versions.read(spark, path).count() == 4
