import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import quality_mil as Q
from skarn.llm import text as T
from tests.llm.conftest import prose

DATA = Path("/root/testdata/sf0.01")


def of(texts):
    blob = [t.encode() for t in texts]
    return np.frombuffer(b"".join(blob), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)


def plain_score(model, text):
    """The same score by loops over words, passages and numbers."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    parts = [words[i : i + Q.PASSAGE_WORDS] for i in range(0, len(words), Q.PASSAGE_WORDS)] or [[]]
    w, encoded, logits = model.weights, [], []
    at = 0
    for p in parts:
        x = np.zeros(Q.FEATURES)
        if p:
            begin = text.index(p[0], at)
            at = begin
            for word in p:
                at = text.index(word, at) + len(word)
            raw = text[begin:at].encode()
            for b in raw:
                x[Q._KINDS[b]] += 1 / len(raw)
            size = [len(x.encode()) for x in p]
            mean = sum(size) / len(p)
            kind = lambda word, i: Q._KINDS[word.encode()[i]]
            threes = [tuple(p[i : i + 3]) for i in range(len(p) - 2)]
            x[7:16] = [
                np.log1p(len(p)) / 5,
                np.log1p(mean) / 3,
                max(0, sum(s * s for s in size) / len(p) - mean**2) ** 0.5 / (1 + mean),
                (len(p) - len(set(p))) / len(p),
                sum(a == b for a, b in zip(p, p[1:])) / len(p),
                (len(threes) - len(set(threes))) / len(p),
                sum(kind(v, -1) == 0 for v in p) / len(p),
                sum(len(v.encode()) == 1 and kind(v, 0) == 0 for v in p) / len(p),
                sum(kind(v, 0) == 2 and kind(v, -1) == 2 for v in p) / len(p),
            ]
            for v in p:
                x[Q.SHAPES + int(T.mix(T.words(*of([v]), False)[3])[0] % np.uint64(Q.BUCKETS))] += 1
            x[Q.SHAPES :] = np.sqrt(x[Q.SHAPES :] / len(p))
        x = (x - model.mean) / model.scale
        h = [np.tanh(sum(x[i] * w["W"][i, k] for i in range(Q.FEATURES)) + w["b"][k]) for k in range(Q.WIDTH)]
        gate = [np.tanh(sum(h[i] * w["V"][i, k] for i in range(Q.WIDTH))) / (1 + np.exp(-sum(h[i] * w["U"][i, k] for i in range(Q.WIDTH)))) for k in range(Q.GATE)]
        encoded.append(h)
        logits.append(sum(a * b for a, b in zip(gate, w["w"])))
    a = np.exp(np.array(logits) - max(logits))
    z = [sum(a[i] * encoded[i][k] for i in range(len(parts))) / a.sum() for k in range(Q.WIDTH)]
    return 1 / (1 + np.exp(-(sum(p * q for p, q in zip(z, w["c"])) + w["d"][0])))


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    model = Q.fit([], np.zeros(0))
    for k, v in model.weights.items():
        model.weights[k] = rng.normal(0, 1, v.shape)
    model.mean, model.scale = rng.normal(0, 0.1, Q.FEATURES), rng.uniform(0.5, 2, Q.FEATURES)
    return model


def test_score_equals_plain_loops_in_any_batch(texts, monkeypatch):
    model = random_model()
    texts = [t for t in texts if t is not None and len(t) < 3000] + ["A! B! A! B! A!", "é é é", "x " * 500, "UPPER 12 %% %% ab"]
    want = np.array([plain_score(model, t) for t in texts])
    assert abs(model.score(*of(texts)) - want).max() < 1e-6
    monkeypatch.setattr(T, "CHUNK_BYTES", 64)
    assert abs(np.concatenate([model.score(*of([t])) for t in texts]) - want).max() < 1e-6


def test_long_texts_pass_in_pieces_that_depend_on_nothing_else():
    rng = random.Random(2)
    model, long = random_model(2), prose(rng, 400_000)
    alone = model.score(*of([long]))[0]
    assert len(Q.pieces(*of([long]))[1]) > 1
    assert abs(model.score(*of(["a b", long, ""]))[1] - alone) < 1e-9
    data, starts = of([long])
    cuts, _ = Q.pieces(data, starts)
    assert sum(Q.passages(data[a:b], np.array([0, b - a]))[0].size for a, b in zip(cuts, cuts[1:])) >= 400_000 // Q.PASSAGE_WORDS
    assert 0 <= model.score(*of(["x" * 3_000_000]))[0] <= 1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    w = random_model(4).weights
    w = {k: v * 0.3 for k, v in w.items()}
    x, bag, first, y = rng.normal(size=(9, Q.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([0, 3, 5]), np.array([1.0, 0.0, 0.5])

    def loss():
        h = np.tanh(x @ w["W"] + w["b"])
        logit = (np.tanh(h @ w["V"]) * Q._sigmoid(h @ w["U"])) @ w["w"]
        p = []
        for i in range(3):
            a = np.exp(logit[bag == i])
            p.append(Q._sigmoid((a / a.sum()) @ h[bag == i] @ w["c"] + w["d"][0]))
        p = np.array(p)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = Q._gradients(w, x, bag, first, y)
    for k, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in w[k].shape) for _ in range(5)]:
            old = w[k][at]
            w[k][at] = old + 1e-5
            up = loss()
            w[k][at] = old - 1e-5
            down = loss()
            w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(6)
    bags, labels = [], []
    for i in range(400):
        x = rng.normal(size=(8, Q.FEATURES)).astype(np.float32)
        if i % 2:
            x[rng.integers(8), :4] += 4
        bags.append(x)
        labels.append(1 - i % 2)
    model = Q.fit(bags, np.array(labels, float))
    h, logit = model.encode(bags[1])
    assert logit.argmax() == bags[1][:, :4].sum(axis=1).argmax()


def test_every_row_is_judged(spark, documents, empty):
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None, "x", 0.0) for i in range(40)] + [(None, 1, "x", 0.0), (3, 0, "x", 0.0), (9999, 1, "x", 0.0)], "doc_id long, quality int, text string, score double")
    got = Q.judge_quality(documents, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == documents.count()
    scores = {}
    text_of = {}
    for r in documents.collect():
        text_of.setdefault(r["doc_id"], set()).add(r["text"])
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        scores.setdefault(next(iter(text_of[r["doc_id"]])) or "", set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in scores.values())
    assert Q.judge_quality(empty, labels).collect() == []
    assert {r["score"] for r in Q.judge_quality(documents, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] > 0.7 for r in Q.judge_quality(documents, labels.withColumn("quality", F.lit(1))).collect()} == {True}


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{n}.parquet")) for n in ("documents", "labels"))
    got = Q.judge_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9
    # Labels of held-out rows teach nothing.
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in Q.judge_quality(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
