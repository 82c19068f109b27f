"""What Spark proves of an answer equals what the parser says, and well-formed answers don't reach Python."""

import json
import random

from pyspark.sql import functions as F

from skarn.functions import validate as V
from skarn.schemas import RISK_CATEGORIES


def answer(rng):
    figure = lambda: rng.choice([None, 0, 1, -5, 12.5, 1e9, 123456789012.34, 10**20, 2**63, -2.5e-7, 0.1, 1e300])
    risk = lambda: {"title": rng.choice(["A title", 'with "quotes"', "Ünï \n", ""]), "category": rng.choice(RISK_CATEGORIES), "summary": "s"}
    out = {"company": "C", "ticker": "T", "fiscal_year": rng.choice([2025, None, 0, 2**31 - 1]), "form_type": "10-K", "financials": {k: figure() for k in V._NUMBERS if rng.random() < 0.9} | ({"unit": "USD"} if rng.random() < 0.7 else {}), "risk_factors": [risk() for _ in range(rng.randrange(4))]}
    for k in ("fiscal_year", "risk_factors"):
        if rng.random() < 0.1:
            del out[k]
    return out


def mutated(rng, text):
    kind = rng.randrange(14)
    at = rng.randrange(len(text))
    if kind == 0:
        return text[:at] + text[at + 1 :]
    if kind == 1:
        return text[:at] + rng.choice('{}[]",:x\\ \n0-e.') + text[at:]
    if kind == 2:
        return text + rng.choice([" x", "}", " {}", ",{}", '] [{"a":1}', " ", "\n", ',"skarn-end-of-answer"]'])
    if kind == 3:
        return rng.choice(["Here: ", "```json\n", "[", " ", " "]) + text + rng.choice(["", "\n```", "]"])
    value = json.loads(text)
    key = rng.choice(list(value))
    if kind == 4:
        del value[key]
    elif kind == 5:
        value[key] = rng.choice([None, "x", "12", 12, 1.0, 1.5, True, [], {}, [None], "1e3", float("nan"), 10**30, -0.0])
    elif kind == 6:
        value["more"] = 1
    elif kind == 7 and value["financials"]:
        value["financials"][rng.choice([*V._NUMBERS, "unit"])] = rng.choice([None, "x", "12.5", True, [], -0.0, float("inf"), 10**400, "nan", {}])
    elif kind == 8 and value.get("risk_factors"):
        rng.choice(value["risk_factors"])[rng.choice(["title", "category", "summary", "extra"])] = rng.choice([None, "x", "cyber", 1, []])
    elif kind == 9 and value.get("risk_factors"):
        value["risk_factors"].append(rng.choice([None, {}, [], "x"]))
    elif kind == 10:
        return json.dumps(value)[:-1] + f', "{key}": {json.dumps(value[key])}}}'
    elif kind == 11:
        return text.replace('"C"', rng.choice(['"\\ud800"', '"\\ud83d\\ude00"', '"\\u00e9"', '"a\tb"', "'C'"]))
    elif kind == 12:
        return rng.choice(["", " ", " ", "\x0b", "null", "[]", "no braces here", "12", '"x"', None, "{", "}"])
    return json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)


def plain(r):
    r = V.validate_one(r)
    year = r["target"] and r["target"]["fiscal_year"]
    if year is not None and r["target"] and not -(2**31) <= year < 2**31:
        r["target"]["fiscal_year"] = None
    if r["target"] is not None and "risk_factors" in r["target"]:
        r["target"] = {k: r["target"].get(k) for k in ("company", "ticker", "fiscal_year", "form_type", "financials", "risk_factors")}
    return r


def test_ten_thousand_mutated_answers(spark):
    rng = random.Random(3)
    raws = []
    for _ in range(10_000):
        text = json.dumps(answer(rng))
        for _ in range(rng.randrange(3)):
            try:
                text = mutated(rng, text)
            except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                break
            if not text:
                break
        # A lone surrogate is no text of a table.
        raws.append(text and text.encode("utf-8", "replace").decode())
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").repartition(8).select("i", V.proved(F.col("raw")).alias("fast"), V.validate_target(F.col("raw")).alias("whole")).collect()
    shown = lambda x: repr(x.asDict(recursive=True) if x is not None else None)
    decided = 0
    for r in rows:
        want = repr(plain(raws[r["i"]]))
        assert shown(r["whole"]) == want, raws[r["i"]]
        if r["fast"] is not None:
            decided += 1
            assert shown(r["fast"]) == want, raws[r["i"]]
    assert decided > 3000


def test_well_formed_answers_do_not_reach_python(spark):
    rng = random.Random(4)
    raws = [json.dumps(answer(rng), indent=rng.choice([None, 2]), ensure_ascii=False) for _ in range(500)] + [None, "", "sorry, no"]
    left = spark.createDataFrame([(r,) for r in raws], "raw string").where(V.proved(F.col("raw")).isNull())
    assert [r["raw"] for r in left.collect()] == []
