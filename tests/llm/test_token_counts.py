import pytest

from skarn.llm import token_counts as T
from skarn.llm.queries import tokenizer_file

P = pytest.importorskip("public_tokenizers")


def test_every_limit(spark):
    lengths = [0, 0, 3, 3, 3, 7, 1024, 1025, 5000, 5000]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    rows = T.answers(T.length_histogram(df)).collect()
    assert sorted(r["context_limit"] for r in rows) == sorted(set(lengths))
    for r in rows:
        L = r["context_limit"]
        assert r["docs"] == lengths.count(L) and r["docs_longer"] == sum(n > L for n in lengths) and r["tokens_longer"] == sum(n for n in lengths if n > L)
        assert r["truncated_total"] == sum(min(n, L) for n in lengths) and r["total_tokens"] == sum(lengths) and r["lost_total"] == sum(max(0, n - L) for n in lengths)
        for q in T.QUANTILES:
            want = next(x for x in sorted(lengths) if 100 * sum(n <= x for n in lengths) >= q * len(lengths))
            assert r[f"quantile_p{q}"] == want


def test_ranks_of_large_counts_are_whole_numbers(spark):
    """With 10^9 documents, one document more or less beyond a bound moves the quantile."""
    for at_ten, want in ((900_000_000, 10), (899_999_999, 20)):
        histogram = spark.createDataFrame([(10, at_ten), (20, 1_000_000_000 - at_ten)], "n_tokens long, docs long")
        assert {r["quantile_p90"] for r in T.answers(histogram).collect()} == {want}


def test_texts_are_encoded_once(spark, documents):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    plan = T.count_tokens(documents, path, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_whole_texts(documents, empty):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    own = T.encoder(path, P.PATTERN)
    want = [len(own.encode_ordinary(r["text"] or "")) for r in documents.collect()]
    rows = T.count_tokens(documents, path, P.PATTERN).collect()
    assert {r["total_tokens"] for r in rows} == {sum(want)} and {r["total_docs"] for r in rows} == {len(want)}
    assert {r["context_limit"]: r["docs"] for r in rows} == {n: want.count(n) for n in want}
    assert T.count_tokens(empty, path, P.PATTERN).collect() == []
