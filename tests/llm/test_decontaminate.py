import random

import pytest

from skarn.llm import decontaminate as D
from tests.llm.conftest import prose


def distance_within(p, t):
    """Least edits of p to a part of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, n))) for n in (12, 30))
        assert D.least_edits(p, t) == distance_within(p, t)


@pytest.fixture
def leaky(spark, rng):
    items = [prose(rng, 40) for _ in range(30)] + ["short one", None, "  "]
    docs, want = [], set()
    for i in range(90):
        t = prose(rng, 200)
        if i % 3 == 0:
            w = items[i // 3].split()
            if i % 2:
                w[10] = "changed"
                w[25:26] = []
            t = " ".join(t.split()[:100]) + "\n " + " ".join(w).upper() + " " + t
            want.add((i, i // 3))
        docs.append((i, t, "x"))
    half = items[0].split()[:20]
    docs += [(200, prose(rng, 50) + " " + " ".join(half) + " " + prose(rng, 50), "x"), (None, None, "x"), (201, "", "x"), (202, "a SHORT  one b", "x")]
    want.add((202, 30))
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), want


def test_leaks_are_found_and_nothing_else(leaky):
    docs, items, want = leaky
    got = D.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = {r["item_id"]: r["text"] for r in items.collect()}
    for r in got:
        p = D.normal(bench[r["item_id"]])
        assert r["edits"] == distance_within(p, D.normal(texts[r["doc_id"]])) and r["similarity"] == pytest.approx(1 - r["edits"] / len(p))
        if r["edits"] == 0:
            assert D.normal(texts[r["doc_id"]][r["start_char"] : r["end_char"]]) == p


def test_parts_of_the_benchmark(leaky, monkeypatch):
    monkeypatch.setattr(D, "ITEM_CHARS", 1000)
    docs, items, want = leaky
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()} == want


def test_removal(leaky):
    docs, items, want = leaky
    kept = D.remove_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_empty(leaky, documents, empty):
    docs, items, _ = leaky
    assert D.find_leaks(empty, items).collect() == [] and D.find_leaks(docs, items.limit(0)).collect() == []
    assert D.remove_leaks(docs, items.limit(0)).count() == docs.count()
    D.find_leaks(documents, items).collect()


def test_recall_of_edited_items(rng):
    """Characters edited at random, up to half of what is allowed: found at the recall asked for, seeds permitting."""
    import pyarrow as pa

    texts = [prose(rng, 60) for _ in range(150)]
    items = D.Items(list(enumerate(texts)))
    docs = []
    for t in texts:
        raw = list(t)
        for _ in range(len(raw) // 20):
            raw[rng.randrange(len(raw))] = "q"
        docs.append("before it " + "".join(raw) + " after it")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    found = {(r[0], r[1]) for r in D._hits(items, batch)}
    assert sum((i, i) in found for i in range(150)) >= 0.97 * 150 and all(a == b for a, b in found)


def test_recall_at_the_full_share(rng):
    """As many edits at random places as are allowed, for long and short items."""
    import pyarrow as pa

    texts = [prose(rng, 60) for _ in range(100)] + [prose(rng, n) for n in (4, 8, 12, 20) for _ in range(25)]
    items = D.Items(list(enumerate(texts)))
    docs = []
    for t in texts:
        raw = list(t)
        for _ in range(int(D.EDIT_SHARE * len(raw))):
            at, kind = rng.randrange(len(raw)), rng.randrange(3)
            raw[at : at + (kind != 1)] = [] if kind == 2 else ["q"]
        docs.append("before it " + "".join(raw) + " after it")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    found = {(r[0], r[1]) for r in D._hits(items, batch)}
    assert sum((i, i) in found for i in range(len(docs))) >= 0.98 * len(docs)


def test_short_items_with_an_edit_in_the_middle():
    import pyarrow as pa

    texts = ["red apple tree", "the tiny cat sat down", "kilogram", "cat"]
    docs = ["a red ap#le tree b", "The tiny cxt sat  down", "one kilxgram two", "concat cats", "con-cat the CAT é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    got = {(r[0], r[1]): r[2:5] for r in D._hits(D.Items(list(enumerate(texts))), batch)}
    assert got == {(0, 0): (2, 16, 1), (1, 1): (0, 22, 1), (2, 2): (4, 12, 1), (4, 3): (12, 15, 0)}
