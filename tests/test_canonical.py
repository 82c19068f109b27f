"""JSON as Python writes it, byte for byte."""

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from skarn.functions.canonical import float_text, python_json, string_text
from skarn.schemas import TARGET_DDL

STRINGS = ["", "plain", 'a "quote" and \\ back', "line\nfeed\r\t\b\f", "\x00\x1f\x7f", "Ünï çödé", "日本", "\U0001f600 and \U0010ffff", "a/b", " ", "é"]
FLOATS = [0.0, -0.0, 1.0, -1.5, 1e16, 1e15, 9999999999999998.0, 123456789012345680.0, 1e-4, 1e-5, 0.00012345, 1.5e300, 5e-324, 1.7976931348623157e308, 1e7, 12345678.9, 0.1, 1 / 3, 1e22, 1e23, 100.0, 2.5, float("inf"), float("-inf"), float("nan")]


def test_floats(spark):
    rng = random.Random(1)
    xs = FLOATS + [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [round(rng.uniform(-1e12, 1e12), 2) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(float_text(F.col("x"))).collect()]
    assert [(x, g) for x, g in zip(xs, got) if g != json.dumps(x)] == []


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("sort_keys", [False, True])
@pytest.mark.parametrize("ascii_only", [False, True])
def test_nested_values(spark, indent, sort_keys, ascii_only):
    kind = "struct<z:string,a:double,m:array<struct<t:string,n:bigint,b:boolean>>,e:array<string>,s:struct<k:array<array<int>>>>"
    rng = random.Random(2)
    pick = lambda xs: rng.choice([None, *xs])
    values = [
        {"z": pick(STRINGS), "a": pick(FLOATS), "m": pick([[], [None], [{"t": pick(STRINGS), "n": pick([-(2**63), 7]), "b": pick([True, False])} for _ in range(3)]]), "e": pick([[], STRINGS]), "s": pick([{"k": None}, {"k": [[], [1, 2], [None]]}])}
        for _ in range(60)
    ]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
    got = [r[0] for r in df.select(python_json(F.col("v"), kind, indent, sort_keys, ascii_only)).collect()]
    assert got == [json.dumps(v, indent=indent, sort_keys=sort_keys, ensure_ascii=ascii_only) for v in [*values, None]]


def test_targets(spark):
    target = {"company": "Ünion \"A\"", "ticker": "T", "fiscal_year": None, "form_type": "10-K", "financials": {"revenue": 1e9, "net_income": -0.0, "total_assets": 1e16, "eps_diluted": 2.5, "shares_outstanding_diluted": None, "unit": "USD"}, "risk_factors": [{"title": "t", "category": "cyber", "summary": "s\n"}]}
    df = spark.createDataFrame([(target,)], f"v {TARGET_DDL}")
    assert df.select(python_json(F.col("v"), TARGET_DDL, 2, ascii_only=False)).first()[0] == json.dumps(target, indent=2, ensure_ascii=False)


def test_other_types_are_refused():
    with pytest.raises(TypeError):
        python_json(F.lit(None), "date")


def test_decimals_of_every_length(spark):
    rng = random.Random(3)
    xs = [sign * rng.randrange(10**n) / 10**k for n in range(1, 17) for k in range(0, 12) for sign in (1, -1) for _ in range(8)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(float_text(F.col("x"))).collect()]
    assert [(x, g) for x, g in zip(xs, got) if g != json.dumps(x)] == []


def seconds(df):
    df.write.format("noop").mode("overwrite").save()
    at = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - at


def test_usual_numbers_are_not_taken_apart(spark):
    cents, thirds = (spark.range(400_000, numPartitions=4).select(float_text((F.col("id") + 7) / n).alias("x")) for n in (100.0, 3.0))
    assert seconds(cents) < 0.5 * seconds(thirds)


def test_runs_of_usual_characters_between_rare_ones(spark):
    texts = ["é", "aé\U0001f600b\x01\x02c\n ", "\x7f\x7f", "é" * 5 + "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for ascii_only in (True, False):
        assert [r[0] for r in df.select(string_text(F.col("t"), ascii_only)).collect()] == [json.dumps(t, ensure_ascii=ascii_only) for t in texts]
