"""Against a direct reading of the contract."""

import hashlib

import pytest

from skarn.llm import substring_dedup as S


def brute(rows, window):
    first, spans = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        order = d if d is not None else 1 << 63
        spans.append((order, w))
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (order, i)), (order, i))
    out = []
    for (d, _), (order, w) in zip(rows, spans):
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (order, i) for k in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, window):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.remove_repeats(df, window).collect())


@pytest.mark.parametrize("window", [4, 20])
def test_against_direct_reading(documents, window):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(documents, window) == brute(rows, window)


def test_overlapping_repeats_within_a_document(spark):
    rows = [(1, "a " * 100), (2, "a b " * 60 + "c"), (3, "x " + "a b " * 11), (3, "other text of the same id " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 20) == brute(rows, 20)


def test_small_outboxes_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(documents, 20) == brute(rows, 20)


def test_empty(empty):
    assert S.remove_repeats(empty).collect() == []


def test_odd_windows_are_refused(empty):
    with pytest.raises(ValueError):
        S.remove_repeats(empty, 7)
