"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label. Every passage is encoded, gated
attention gives each a weight, and the weighted mean of the passages' encodings is scored:

    h = tanh(x W + b)    a = (tanh(h V) * sigmoid(h U)) . w    z = sum of softmax(a) h    score = sigmoid(z . c + d)

Passages are runs of PASSAGE_WORDS words, over the whole text. A softmax can be summed up in parts, so
a long text passes in pieces and only its running sums are held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import select_as, small_batches, tidy

#: Words of a passage, and bytes after which a long text is cut at the next space, or anywhere if there is none.
PASSAGE_WORDS, PIECE_BYTES = 96, 1 << 20
#: Bound of the sample that the model is fitted on: labelled documents, chosen by hash of doc_id, and passages of each, spread evenly.
FIT_ROWS, FIT_PASSAGES = 4000, 24
#: Hashed words, width of an encoding and of the attention, passes over the sample, documents of a step, step size, share of weights lost in a step.
BUCKETS, WIDTH, GATE, EPOCHS, BAGS, RATE, DECAY = 128, 24, 12, 30, 64, 4e-3, 1e-4
THRESHOLD = 0.7
_KINDS = np.zeros(256, np.int64)  # 0 other signs, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence signs, 6 bytes beyond ASCII
_KINDS[ord("a") : ord("z") + 1], _KINDS[ord("A") : ord("Z") + 1], _KINDS[ord("0") : ord("9") + 1], _KINDS[128:] = 1, 2, 3, 6
_KINDS[[9, 10, 11, 12, 13, 32]], _KINDS[[ord(c) for c in ".,;:'\"-()"]] = 4, 5
SHAPES = 7 + 9
FEATURES = SHAPES + BUCKETS


def pieces(data: np.ndarray, starts: np.ndarray, size: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, row) of pieces of at most size bytes of each row, cut after white space where there is any; they depend on nothing but the row."""
    out, row = [], []
    for i in range(len(starts) - 1):
        a, end = int(starts[i]), int(starts[i + 1])
        while True:
            out.append(a)
            row.append(i)
            if end - a <= size:
                break
            blank = np.flatnonzero(_KINDS[data[a : a + size]] == 4)
            a += int(blank[-1]) + 1 if len(blank) else size
    return np.array([*out, starts[-1]], np.int64), np.array(row, np.int64)


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of every passage of the rows, in order; a row without words is one passage of zeros."""
    n = len(starts) - 1
    begin, end, row, value = T.words(data, starts, False)
    counts = np.bincount(row, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sizes = np.maximum(1, -(-counts // PASSAGE_WORDS))
    owner = np.repeat(np.arange(n), sizes)
    x = np.zeros((len(owner), FEATURES), np.float32)
    if not len(row):
        return owner, x
    of_row = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    passage = of_row[row] + (np.arange(len(row)) - first_word[row]) // PASSAGE_WORDS
    firsts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    lasts = np.append(firsts[1:], len(row)) - 1
    have, words = passage[firsts], (lasts - firsts + 1).astype(np.float64)
    kinds = _KINDS[data]
    for k in range(7):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        x[have, k] = (total[end[lasts]] - total[begin[firsts]]) / (end[lasts] - begin[firsts])
    length, final = (end - begin).astype(np.float64), kinds[end - 1]

    def share(flags):
        return np.add.reduceat(flags.astype(np.float64), firsts) / words

    def repeated(values, of):
        """Whether a value occurred before in its passage; of says which count."""
        places = np.flatnonzero(of)
        order = places[np.lexsort((places, values[places], passage[places]))]
        seen = np.zeros(len(values), bool)
        seen[order[1:]] = (values[order[1:]] == values[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
        return seen

    mean = share(length)
    after = np.concatenate([[False], (value[1:] == value[:-1]) & (passage[1:] == passage[:-1])])
    three = T.sequences(value, 3)
    three = np.concatenate([np.zeros(min(2, len(value)), np.uint64), three])[: len(value)]
    wide = np.concatenate([np.zeros(min(2, len(value)), bool), passage[2:] == passage[:-2]])[: len(value)]
    shapes = (
        np.log1p(words) / 5,
        np.log1p(mean) / 3,
        np.sqrt(np.maximum(0, share(length**2) - mean**2)) / (1 + mean),
        share(repeated(value, length > 0)),
        share(after),
        share(repeated(three, wide)),
        share(final == 0),
        share((length == 1) & (final == 0)),
        share((kinds[begin] == 2) & (final == 2)),
    )
    for k, v in enumerate(shapes):
        x[have, 7 + k] = v
    bucket = (T.mix(value) % np.uint64(BUCKETS)).astype(np.int64)
    at = np.bincount(passage * BUCKETS + bucket, minlength=len(owner) * BUCKETS).reshape(-1, BUCKETS)
    x[:, SHAPES:] = np.sqrt(at / np.maximum(1, at.sum(axis=1, keepdims=True)))
    return owner, x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Mean and scale of the features, and the weights by name."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoding and attention logit of each passage."""
        w = self.weights
        h = np.tanh(((x - self.mean) / self.scale) @ w["W"] + w["b"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of each row; rows and pieces pass in chunks, and a row's sums go on from one to the next."""
        n = len(starts) - 1
        cuts, row = pieces(data, starts)
        top, weight, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, WIDTH))
        for a, b in T.chunks(cuts):
            owner, x = passages(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            h, logit = self.encode(x)
            owner = row[a:b][owner]
            high = top.copy()
            np.maximum.at(high, owner, logit)
            fade = np.exp(np.where(np.isfinite(high), top, 0) - np.where(np.isfinite(high), high, 0))
            e = np.exp(logit - high[owner])
            weight, z = weight * fade, z * fade[:, None]
            np.add.at(weight, owner, e)
            np.add.at(z, owner, e[:, None] * h)
            top = high
        return _sigmoid(z / weight[:, None] @ self.weights["c"] + self.weights["d"][0])


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Model:
    """A model of bags of passages and their labels (0 to 1), by Adam on the log loss. Without bags every score is 0.5; with one label alone, near it."""
    rng = np.random.default_rng(seed)
    shape = {"W": (FEATURES, WIDTH), "b": (WIDTH,), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "w": (GATE,), "c": (WIDTH,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b", "d") else np.zeros(s) for k, s in shape.items()}
    if not bags:
        w["c"][:] = 0
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    x = np.concatenate(bags)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1)
    x = np.clip((x - mean) / scale, -8, 8)
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    share = labels.mean()
    w["d"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    step, steps = 0, EPOCHS * -(-len(bags) // BAGS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BAGS):
            pick = order[i : i + BAGS]
            sizes = at[pick + 1] - at[pick]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bag = np.repeat(np.arange(len(pick)), sizes)
            xs = x[np.concatenate([np.arange(at[p], at[p + 1]) for p in pick])]
            g = _gradients(w, xs, bag, first, labels[pick])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in w:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] * (1 - DECAY if w[k].ndim > 1 else 1) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _gradients(w: dict, x: np.ndarray, bag: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean log loss of bags: passages x, the bag of each and the first passage of each bag."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (t * s) @ w["w"]
    e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    out = (_sigmoid(z @ w["c"] + w["d"][0]) - y) / len(y)
    dz = out[:, None] * w["c"]
    da = (h * dz[bag]).sum(axis=1)
    dl = a * (da - np.add.reduceat(a * da, first)[bag])
    dts = dl[:, None] * w["w"]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dl, "c": z.T @ out, "d": np.array([out.sum()])}


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves remainder 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, per_bag: int = FIT_PASSAGES) -> Model:
    """A model of the labelled documents that aren't held out.

    rows bounds the sample: the labelled doc_ids of smallest hash. A document of more than per_bag passages
    is fitted on so many, evenly spread over it. A doc_id of several labels counts with their mean, null
    labels and documents without label don't count. What reaches the driver is rows * per_bag passages at most.
    """
    small_batches(documents.sparkSession)
    known = select_as(labels, doc_id="long", quality="double").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # At most rows of them, so they can be sent to every task.
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(rows)
    sample = select_as(documents, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    # Repeated rows of a doc_id are copies: one is enough.
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).select("doc_id", "text", "quality")

    def encode(batches):
        for batch in batches:
            bags = []
            for t in batch.column(1).to_pylist():
                data = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
                cuts, _ = pieces(data, np.array([0, len(data)]))
                parts = [passages(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])[1] for a, b in T.chunks(cuts)] or [np.zeros((1, FEATURES), np.float32)]
                x = np.concatenate(parts)
                keep = np.arange(len(x)) if len(x) <= per_bag else np.linspace(0, len(x) - 1, per_bag).round().astype(int)
                bags.append(x[keep].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])
        tidy()

    found = sample.mapInArrow(encode, "doc_id long, quality double, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b.as_py(), "<f4").reshape(-1, FEATURES) for b in found.column("bag")]
    return fit(bags, np.clip(found.column("quality").to_numpy(), 0, 1))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text), by its whole text alone; null text counts as empty."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in T.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(*T.texts(batch.column(1))), pa.float64())], ["doc_id", "score"])
        tidy()

    return select_as(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def judge_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see fit_quality for what is learned from.

    Null text counts as empty, and both get a score; texts of any length pass in pieces. Repeated rows are
    scored one by one, all alike; a score equal to the threshold is predicted 1. Without labels every score
    is 0.5, and an empty table gives an empty result. Columns other than doc_id, text and quality are not read.
    """
    scored = score_documents(documents, fit_quality(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
