import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base(text):
    rows = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    counts = [sum(r[3] == kind for r in rows) for kind, *_ in KINDS]
    return counts, ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(rows))


def some_texts():
    rng = random.Random(6)
    bits = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc123", "AKIA", "AKIA" + "Z9" * 9, "deadbeef" * 4, "0123456789abcdef01234567", "é", "\n", "😀", "x=y", "ſecret", "-_./+"]
    return [None, "", "token=ab token: abcdef", "secret: token: abcdef"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


def test_base_spans(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in S.scan_secrets(df).collect():
        counts, listed = base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def entropy(s, window):
    def bits(part):
        n = len(part)
        return -sum(c / n * math.log2(c / n) for c in Counter(part).values())

    return max((bits(s[i : i + window]) for i in range(max(1, len(s) - window + 1))), default=0.0) if s else 0.0


def test_incremental_entropy(spark):
    rng = random.Random(8)
    rows = [("",), ("a",), ("ab" * 30,)] + [("".join(rng.choice("abcdefABC0123+/") for _ in range(rng.randrange(1, 90))),) for _ in range(60)]
    for r in spark.createDataFrame(rows, "s string").select("s", S.highest_entropy(F.col("s")).alias("e")).collect():
        assert r["e"] == pytest.approx(entropy(r["s"], S.WINDOW), abs=1e-9)


def test_method_adds_random_strings_and_spares_the_rest(spark):
    key = "Zm9vYmFy9XqLw7Rk2TtPz4VsN1"
    texts = [f"value {key} end", "internationalizationandlocalization and/so/on/for/a/long/path", "123e4567-e89b-12d3-a456-426614174000", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1z", "see example_Zm9vYmFy9XqLw7Rk2TtPz4VsN1", f"token={key}"]
    got = [r["spans"] for r in S.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [f"entropy:6:{6 + len(key)}", "", "", "", "", f"assign:0:{6 + len(key)}"]


def test_masking(spark):
    df = spark.createDataFrame([(1, "a token=abcdef12 b", 18, "z"), (2, None, None, "z"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, spans string")
    got = S.mask_secrets(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "a [SECRET] b", 12, "z"), (2, None, None, "z"), (3, "clean", 5, None)]


def test_masking_of_many_overlapping_spans_in_long_texts(spark):
    """Against the same done on strings, over pieces of 4096 code points."""
    rng = random.Random(12)
    bits = ["token=" + "ab12" * 6, "deadbeef" * 4, "password: xyz123", "é" * 50, "plain words " * 30, "😀\n", "Zm9vYmFy9XqLw7Rk2TtPz4VsN1"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", "\n"]) for _ in range(n)) for n in (1, 5, 40, 300, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in S.scan_secrets(df).collect()}
    for r in S.mask_secrets(df).collect():
        text, out, at = texts[r["doc_id"]], "", 0
        for s, e in spans[r["doc_id"]]:
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r["text"] == out + text[at:]


def test_long_candidates_and_many_secrets_end_soon(spark):
    """Time is about linear: a run of 100,000 characters and 10,000 secrets in one text."""
    import time

    rng = random.Random(13)
    run = "".join(rng.choice("GHIJKLMNghijklmn01234567+/") for _ in range(100_000))
    many = " ".join(f"token=abc{i:06d}" for i in range(10_000))
    df = spark.createDataFrame([(0, run), (1, many), (2, "Zm9vYmFy9XqLw7Rk2TtPz4VsN1 " * 2000)], "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: r for r in S.scan_secrets(df).collect()}
    assert got[0]["spans"] == "entropy:0:100000" and got[1]["n_assign"] == 10_000 and got[2]["spans"].count(",") == 1999
    masked = {r["doc_id"]: r["text"] for r in S.mask_secrets(df).collect()}
    assert masked[1] == " ".join(["[SECRET]"] * 10_000) and masked[0] == "[SECRET]"
    assert time.time() - began < 120


def test_messy(documents, empty):
    assert S.scan_secrets(documents).count() == documents.count() and S.scan_secrets(empty).collect() == []
