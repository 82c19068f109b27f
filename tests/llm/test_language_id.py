import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from skarn.llm import language_id as L

DATA = Path("/root/testdata/sf0.01")


def test_rules_hold_for_every_row(documents):
    got = L.identify(documents).collect()
    assert len(got) == documents.count()
    by = {r["doc_id"]: r for r in got}
    for r in documents.collect():
        p = by[r["doc_id"]]
        assert 0 <= p["score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert p["lang_pred"] == "und" and p["score"] == 0
        else:
            assert p["lang_pred"] == "en"
        if r["doc_id"] is not None:
            assert p["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_without_labels_and_rows(documents, empty):
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in L.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(empty).collect() == []


def test_vectors_do_not_depend_on_their_batch():
    texts = ["the cat", None, "", "a", "Zwölf Boxkämpfer", "x" * 100, "one two three"]
    together, _ = L.document_vectors(texts)
    for i, t in enumerate(texts):
        assert abs(together[i] - L.document_vectors([t])[0][0]).max() < 1e-5


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def plain_vector(text):
    """Bundle of a text's bound trigrams, letter by letter: word ends are letter 0, ends that follow one another are one."""
    base = np.random.default_rng(7).integers(0, 2, (L._BUCKETS, L.DIM), dtype=np.int8).astype(int) * 2 - 1
    letters = []
    for c in text + "\n\n":
        n = ord(c.lower()[0]) % (L._BUCKETS - 1) + 1 if c.isalpha() else 0
        if n or not letters or letters[-1]:
            letters.append(n)
    out = [0] * L.DIM
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if a or b or c:
            for i in range(L.DIM):
                out[i] += int(base[a][i - 2] * base[b][i - 1] * base[c][i])
    return out


def plain_cosine(u, v):
    size = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
    return sum(x * y for x, y in zip(u, v)) / size if size else 0.0


def test_profiles_and_cosines_are_the_plain_ones(spark):
    """Vectors, profiles, scores and languages against loops in plain Python, from rows to result."""
    said = {"en": ["the cat sat on the mat", "where is THE house, then?"], "de": ["der Hund schläft auf dem Sofa", "wo ist das Haus"], "fr": ["le chat dort sur la chaise", "où est l'église"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in said.items() for t in ts)]
    asked = ["the house", "das Sofa schläft", "la chaise est là", "a b", "Ünïcode 123 ß"]
    profiles = {}
    for _, t, lang in rows:
        v = plain_vector(t)
        size = math.sqrt(sum(x * x for x in v))
        profiles[lang] = [a + b / size for a, b in zip(profiles.get(lang, [0] * L.DIM), v)]
    got = L.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.langs == sorted(said)
    for lang, v in zip(got.langs, got.vectors):
        assert plain_cosine(v.tolist(), profiles[lang]) == pytest.approx(1, abs=1e-5)
    names, scores = got.predict(asked)
    for t, name, score in zip(asked, names, scores):
        plain = {lang: plain_cosine(plain_vector(t), p) for lang, p in profiles.items()}
        assert score == pytest.approx(min(1, max(0, max(plain.values()))), abs=1e-5) and plain[name] == pytest.approx(max(plain.values()), abs=1e-5)


def test_ties_go_to_the_first_language_by_name():
    v = L.document_vectors(["the same text"])[0]
    assert L.Profiles(["aa", "bb"], np.concatenate([v, v])).predict(["the same text", "a"])[0] == ["aa", "aa"]
