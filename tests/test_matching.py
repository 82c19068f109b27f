"""Matching of long lists equals the sequential greedy choice."""

import random
import time

import pytest
from pyspark.sql import functions as F

from skarn.operators import matching, scoring

DDL = "accession_no string, place int, title string, summary string"


def plain(gold, pred, threshold=0.3):
    """Every pair, best first: the definition."""
    from skarn.functions.text import STOPWORDS

    def words(x):
        import re

        return {w for w in re.findall("[a-z0-9]+", (x or "").lower()) if len(w) > 2 and w not in STOPWORDS}

    def dice(a, b):
        return 2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0

    out = []
    for key in {r[0] for r in gold} & {r[0] for r in pred} - {None}:
        g = [(r[1], words(r[2]), words(r[3])) for r in gold if r[0] == key]
        p = [(r[1], words(r[2]), words(r[3])) for r in pred if r[0] == key]
        pairs = sorted((-(0.7 * dice(a[1], b[1]) + (1 - 0.7) * dice(a[2], b[2])), a[0], b[0]) for a in g for b in p)
        used_g, used_p = set(), set()
        for s, i, j in pairs:
            if -s >= threshold and i not in used_g and j not in used_p:
                used_g.add(i)
                used_p.add(j)
                out.append((key, i, j, round(-s, 9)))
    return sorted(out)


def got(spark, gold, pred, **kw):
    out = matching.match_lists(spark.createDataFrame(gold, DDL), spark.createDataFrame(pred, DDL), **kw)
    return sorted((r["accession_no"], r["g"], r["p"], round(r["score"], 9)) for r in out.collect())


def lists(rng, keys, n, words, title=(1, 4), summary=(0, 5)):
    text = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    return [(k, i, text(*title), text(*summary)) for k in keys for i in range(rng.randint(0, n))]


@pytest.mark.parametrize("seed, kinds, rounds", [(1, 40, 12), (2, 4, 12), (3, 2, 12), (4, 6, 0), (5, 3, 1)])
def test_equals_the_greedy_choice_on_random_lists_with_ties(spark, seed, kinds, rounds):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(kinds)]
    gold, pred = lists(rng, "abcd", 25, words), lists(rng, "abcde", 25, words)
    gold += [("a", 100, None, None), ("a", 101, "", "the of"), (None, 0, "word1", "word1")]
    pred += [("a", 100, None, "word1 word1"), (None, 0, "word1", "word1")]
    assert got(spark, gold, pred, rounds=rounds) == plain(gold, pred)


def test_equals_the_fold_of_short_lists(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(8)]
    gold, pred = lists(rng, "ab", 12, words), lists(rng, "ab", 12, words)
    pack = lambda rows: spark.createDataFrame(rows, DDL).groupBy("accession_no").agg(F.array_sort(F.collect_list(F.struct("place", "title", "summary"))).alias("l"))
    both = pack(gold).withColumnRenamed("l", "g").join(pack(pred).withColumnRenamed("l", "p"), "accession_no")
    folded = both.select("accession_no", F.inline(scoring.greedy_matches(F.col("g"), F.col("p")))).collect()
    assert sorted((r["accession_no"], r["g"], r["p"], round(r["score"], 9)) for r in folded) == got(spark, gold, pred)


def test_thresholds_and_empty_sides(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(6)]
    gold, pred = lists(rng, "ab", 15, words), lists(rng, "ab", 15, words)
    for threshold in (0.05, 0.7, 1.0):
        assert got(spark, gold, pred, threshold=threshold) == plain(gold, pred, threshold)
    assert got(spark, gold, []) == [] and got(spark, [], []) == []
    with pytest.raises(ValueError):
        got(spark, gold, pred, threshold=0.0)


def test_lists_of_twenty_thousand_entries_end(spark):
    rng = random.Random(10)
    words = [f"w{i:05d}" for i in range(30_000)]
    draw = lambda n: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(n))
    gold = [("a", i, draw(6) + " common", draw(10)) for i in range(15_000)] + [("a", i, "all alike common", "again") for i in range(15_000, 20_000)]
    pred = [("a", i, t.replace("common", "shared") if i % 3 else t, s) for _, i, t, s in gold]
    began = time.time()
    out = got(spark, gold, pred)
    assert len({r[1] for r in out}) == len(out) == len({r[2] for r in out}) and len(out) > 19_000
    assert sum(g == p for _, g, p, _ in out) >= 15_000 and time.time() - began < 300


def test_the_choice_of_a_row_does_not_make_all_pairs_of_copies(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(5)]
    kinds = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(6)]
    side = lambda n: [("a", i, rng.choice(kinds), rng.choice(kinds)) for i in range(n)]
    gold, pred = side(4000), side(3500)
    pack = lambda rows: spark.createDataFrame(rows, DDL).groupBy("accession_no").agg(F.array_sort(F.collect_list(F.struct("place", "title", "summary"))).alias("l"))
    both = pack(gold).withColumnRenamed("l", "g").join(pack(pred).withColumnRenamed("l", "p"), "accession_no")
    at = time.monotonic()
    m = both.select(scoring.greedy_matches(F.col("g"), F.col("p")).alias("m")).first().m
    assert time.monotonic() - at < 30
    assert sorted(("a", x.g, x.p, round(x.score, 9)) for x in m) == got(spark, gold, pred)
    assert [(-x.score, x.g, x.p) for x in m] == sorted((-x.score, x.g, x.p) for x in m)


def test_the_choice_of_a_row_takes_nulls_and_thresholds(spark):
    kind = "array<struct<title:string,category:string,summary:string>>"
    rows = [(1, [("word1 word2", "c", None), None, (None, "c", "word3"), ("", "c", "the of")], [("word2", "c", "word3"), (None, None, None)]), (2, None, [("word1", "c", "")]), (3, [], [("word1", "c", "")])]
    df = spark.createDataFrame(rows, f"k int, g {kind}, p {kind}")
    run = lambda t: {r.k: None if r.m is None else [(x.g, x.p, round(x.score, 9)) for x in r.m] for r in df.select("k", scoring.greedy_matches(F.col("g"), F.col("p"), t).alias("m")).collect()}
    assert run(0.3) == {1: [(0, 0, round(0.7 * 2 / 3, 9))], 2: None, 3: []}
    assert run(0.0) == {1: [(0, 0, round(0.7 * 2 / 3, 9)), (1, 1, 0.0)], 2: None, 3: []}
