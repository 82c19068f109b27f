"""The stages, each against a plain reading of what it does."""

import random

import pytest

import corpus_pipeline
from skarn.llm import decontaminate
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import distance_within
from tests.llm.test_ngram_join import brute

pytest.importorskip("public_tokenizers")


def test_whole_pipeline(spark, tmp_path):
    import tokenizers

    from skarn.llm.queries import tokenizer_file

    rng = random.Random(11)
    items = [prose(rng, 40) for _ in range(5)]
    base = prose(rng, 150)
    texts = [base, base, base + " more", None, "", "12 34", *[prose(rng, rng.randrange(5, 200)) for _ in range(30)], prose(rng, 50) + " " + items[2] + " " + prose(rng, 50), "a token=abcdef123 b " + prose(rng, 20)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    component = {d: c for d, _, c in brute(kept, 5, 80, 100)}
    kept = [(i, t) for i, t in kept if component[i] == i]
    kept = [(i, t) for i, t in kept if not any(distance_within(p, decontaminate.normal(t)) <= 0.2 * len(p) for p in items)]
    kept = [(i, t.replace("token=abcdef123", "[SECRET]")) for i, t in kept]
    library = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in kept]
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(want) < len(texts) - 5


def test_stages_keep_columns_and_clean_documents(spark, documents, tmp_path):
    spark.createDataFrame([(0, "nothing of this is in any text at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (documents, documents.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert {(r["doc_id"], r["n"], r["key"], r["score"]) for r in out.collect()} <= {(r["doc_id"], r["n"], r["key"], r["score"]) for r in rows.collect()}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
