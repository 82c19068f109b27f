"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters'
vectors, each permuted (rotated) by its place in the n-gram; a document bundles (adds) the vectors of
its n-grams, a language bundles its documents, and a document gets the language of largest cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import select_as, small_batches, tidy

#: Dimensions, letters of an n-gram, and characters that are worked on at once.
DIM, N, CHUNK_CHARS = 512, 3, 1 << 19
#: Bound of the sample that profiles are fitted on: about so many documents of each language, chosen by hash of doc_id.
FIT_ROWS_PER_LANG = 4000
_BUCKETS = 1 << 10  # letters; code points of letters that differ by a multiple of it share a vector
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Letter number of every code point: 0 for whatever is no letter (a word's end), else 1 to _BUCKETS - 1."""
    table = getattr(_letter_table, "table", None)
    if table is None:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0]) % (_BUCKETS - 1) + 1
        _letter_table.table = table
    return table


def _gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as numbers in base _BUCKETS."""
    letters = getattr(_gram_vectors, "letters", None)
    if letters is None:
        rng = np.random.default_rng(7)
        base = (rng.integers(0, 2, (_BUCKETS, DIM), dtype=np.int8) * 2 - 1).astype(np.int8)
        letters = _gram_vectors.letters = [np.roll(base, k, axis=1) for k in range(N)]
    out = None
    for k in range(N):
        v = letters[k][(codes // _BUCKETS**k) % _BUCKETS]
        out = v if out is None else out * v
    return out.astype(np.float32)


def document_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each text, scaled to length 1, and whether it has a letter (else the vector is 0)."""
    out, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_CHARS):
            size += len(texts[j] or "")
            j += 1
        out[i:j], has[i:j] = _chunk_vectors(texts[i:j])
        i = j
    return out, has


def _chunk_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    data = np.frombuffer("\n\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t or "") + 2 for t in texts])
    owner = np.repeat(np.arange(n), lengths)[: len(data)]
    letter = _letter_table()[data[: len(owner)]]
    has = np.zeros(n, bool)
    has[owner[letter > 0]] = True
    # Whatever is no letter becomes one word end, however much of it there is.
    keep = (letter > 0) | np.concatenate([[True], letter[:-1] > 0])
    letter, owner = letter[keep], owner[keep]
    if len(letter) < N:
        return np.zeros((n, DIM), np.float32), has
    code, same = np.zeros(len(letter) - N + 1, np.int64), owner[N - 1 :] == owner[: len(letter) - N + 1]
    inner = np.zeros(len(code), bool)
    for k in range(N):
        part = letter[k : k + len(code)]
        code = code * _BUCKETS + part
        inner |= part > 0
    code, owner = code[same & inner], owner[: len(code)][same & inner]
    grams, place = np.unique(code, return_inverse=True)
    out = np.zeros((n, DIM), np.float32)
    counts = np.unique(owner * len(grams) + place, return_counts=True) if len(grams) else (np.zeros(0, np.int64), np.zeros(0))
    doc, gram = np.divmod(counts[0], max(1, len(grams)))
    for a in range(0, len(grams), 4096):
        b = min(a + 4096, len(grams))
        pick = (gram >= a) & (gram < b)
        table = np.zeros((n, b - a), np.float32)
        table[doc[pick], gram[pick] - a] = counts[1][pick]
        out += table @ _gram_vectors(grams[a:b])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


@dataclass
class Profiles:
    """Language names in order, and a unit vector of each."""

    langs: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine (0 to 1) of each text; UNKNOWN and 0 without letters or profiles."""
        vectors, has = document_vectors(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = vectors @ self.vectors.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)


def fit_profiles(labelled: DataFrame, rows_per_lang: int = FIT_ROWS_PER_LANG) -> Profiles:
    """Profiles of the languages of labelled (doc_id, text, lang).

    rows_per_lang bounds the sample: languages with more rows give each row the same chance by a hash
    of doc_id, so about so many are taken. Rows without text or lang are not used. What reaches the
    driver is one vector for each language and partition group, not rows.
    """
    small_batches(labelled.sparkSession)
    rows = select_as(labelled, doc_id="long", text="string", lang="string").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles([], np.zeros((0, DIM)))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, rows_per_lang / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000)) / 1e6
    sample = rows.where(chance < F.element_at(rate, F.col("lang"))).select("text", "lang")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, has = document_vectors(batch.column(0).to_pylist())
            names = np.array(batch.column(1).to_pylist(), object)
            for lang in set(names[has]):
                sums[lang] = sums.get(lang, 0) + vectors[has & (names == lang)].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v, pa.float64())], ["lang", "i", "v"])

    parts = sample.mapInArrow(bundle, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs")).orderBy("lang").collect()
    vectors = np.array([[x["v"] for x in r["vs"]] for r in found]).reshape(len(found), DIM)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([r["lang"] for r in found], (vectors / np.where(norm > 0, norm, 1)).astype(np.float32))


def predict_language(documents: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """documents with columns lang and score added (in place of any of these names), by text alone.

    Null text, and text without a letter, gets und and 0. Equal cosines go to the first language by name.
    """
    small_batches(documents.sparkSession)
    rows = documents.drop(lang, score)
    fields = T.StructType([*rows.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in batches:
            names, cosines = profiles.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(cosines, pa.float64())], [*batch.schema.names, lang, score])
        tidy()

    return rows.mapInArrow(run, fields)


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves remainder 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles are fitted on rows that aren't held out, all rows are predicted.

    An empty table gives an empty result; repeated rows are predicted one by one.
    """
    rows = select_as(documents, doc_id="long", text="string", lang="string")
    profiles = fit_profiles(rows.where(~held_out(F.col("doc_id"))))
    out = predict_language(rows.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
