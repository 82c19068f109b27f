import random

import numpy as np

from skarn.llm import common
from skarn.llm import text as tx


def components(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame([*pairs, (None, 1), (7, 7)], "a long, b long").repartition(5)
    assert {r["node"]: r["comp"] for r in common.connected_components(df).collect()} == components(pairs)
    assert common.connected_components(df.limit(0)).collect() == []


def test_words_and_sequences():
    import pyarrow as pa

    column = pa.array(["a b  c", None, "", "\ta\x0bb c é", "abc"])
    data, starts = tx.texts(column)
    begin, end, row, value = tx.words(data, starts, False)
    assert [bytes(data[a:b]).decode() for a, b in zip(begin, end)] == ["a", "b", "c", "a", "b", "c", "é", "abc"]
    assert row.tolist() == [0, 0, 0, 3, 3, 3, 3, 4] and value[:3].tolist() == value[3:6].tolist() and len(set(value.tolist())) == 5
    sliced = tx.words(*tx.texts(column.slice(3)), False)[3]
    assert sliced.tolist() == value[3:].tolist()


def test_sequences_tell_order_and_length():
    h = np.arange(40, dtype=np.uint64) % np.uint64(7)
    for k in (1, 2, 3, 5, 10, 20):
        s = tx.sequences(h, k)
        assert len(s) == 41 - k
        for i in range(0, len(s), 5):
            for j in range(len(s)):
                assert (s[i] == s[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist())
