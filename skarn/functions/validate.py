"""Validation of a model's answer against the target's fixed schema.

What can be proved by Spark alone is: an answer that is one object with just the fields and types of the
target is valid, and one that is blank or has no brace is not. Spark's own functions can't decide the
rest (they coerce numbers to strings, but no strings to numbers, and know neither NaN nor an object that
is found in a text), so that goes to the standard library's parser and a table of rules, in Arrow batches.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skarn.schemas import RISK_CATEGORIES, TARGET_DDL
from skarn.session import ship_code

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_NUMBERS = ("revenue", "net_income", "total_assets", "eps_diluted", "shares_outstanding_diluted")
_BAD = object()


def find_object(raw: str) -> str | None:
    """The first balanced object of the first fence, else of the whole answer."""
    fence = _FENCE.search(raw)
    body = fence[1] if fence else raw
    start = body.find("{")
    if start < 0:
        return None
    depth, at = 0, start
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]|"', body[start:], re.S):
        at = start + m.end()
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return body[start:at]
        elif m[0] == '"':  # a string that never ends
            return None
    return None


def _number(v):
    if v is None:
        return None
    if isinstance(v, (bool, int, float)):
        try:
            return float(v)
        except OverflowError:
            return float("inf") if v > 0 else float("-inf")
    if isinstance(v, str) and re.fullmatch(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*", v, re.I):
        return float(v)
    return _BAD


def _integer(v):
    if v is None or isinstance(v, bool):
        return v if v is None else int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float) and v == v and abs(v) != float("inf") and v.is_integer():
        return int(v)
    if isinstance(v, str) and re.fullmatch(r"\s*[+-]?\d+(\.0+)?\s*", v):
        return int(float(v)) if "." in v else int(v)
    return _BAD


def check(value) -> tuple[dict | None, int]:
    """(target, number of errors) of a parsed answer; unknown keys are ignored."""
    if not isinstance(value, dict):
        return None, 1
    errors, out = 0, {}
    for k in ("company", "ticker", "form_type"):
        out[k] = value.get(k)
        errors += not isinstance(out[k], str)
    out["fiscal_year"] = _integer(value.get("fiscal_year"))
    errors += out["fiscal_year"] is _BAD
    money = value.get("financials", _BAD)
    if isinstance(money, dict):
        out["financials"] = {k: _number(money.get(k)) for k in _NUMBERS} | {"unit": money.get("unit", "USD")}
        errors += sum(v is _BAD for v in out["financials"].values()) + (not isinstance(out["financials"]["unit"], str))
    else:
        errors += 1
    risks = value.get("risk_factors", [])
    if isinstance(risks, list):
        out["risk_factors"] = []
        for r in risks:
            if not isinstance(r, dict):
                errors += 1
                continue
            errors += sum(not isinstance(r.get(k), str) for k in ("title", "summary")) + (not isinstance(r.get("category"), str) or r["category"] not in RISK_CATEGORIES)
            out["risk_factors"].append({k: r.get(k) for k in ("title", "category", "summary")})
    else:
        errors += 1
    return (None if errors else out), errors


def _load(text: str):
    try:
        value = json.loads(text)
        if "\\ud" in text.lower():
            json.dumps(value, ensure_ascii=False).encode()  # a lone surrogate is no text: UnicodeEncodeError is a ValueError
        return check(value)
    except (ValueError, RecursionError):
        return None, 1


def validate_one(raw: str | None) -> dict:
    """strict, lenient, error and target of one answer."""
    text = (raw or "").strip()
    if not text:
        return {"strict": False, "lenient": False, "error": "empty", "target": None}
    target, n = _load(text)
    if target is not None:
        return {"strict": True, "lenient": True, "error": None, "target": target}
    error = f"schema: {n} validation error{'s' if n != 1 else ''}"
    found = find_object(raw)
    target = _load(found)[0] if found is not None else None
    return {"strict": False, "lenient": target is not None, "error": error, "target": target}


_RESULT = f"struct<strict:boolean,lenient:boolean,error:string,target:{TARGET_DDL}>"


def _arrow_type():
    money = pa.struct([*((k, pa.float64()) for k in _NUMBERS), ("unit", pa.string())])
    risks = pa.list_(pa.struct([(k, pa.string()) for k in ("title", "category", "summary")]))
    target = pa.struct([("company", pa.string()), ("ticker", pa.string()), ("fiscal_year", pa.int32()), ("form_type", pa.string()), ("financials", money), ("risk_factors", risks)])
    return pa.struct([("strict", pa.bool_()), ("lenient", pa.bool_()), ("error", pa.string()), ("target", target)])


def _validate(raw: pa.Array) -> pa.Array:
    rows = [validate_one(r) if r is not None else None for r in raw.to_pylist()]
    for r in rows:
        y = r and r["target"] and r["target"]["fiscal_year"]
        if y is not None and r["target"] and not -(1 << 31) <= y < 1 << 31:
            r["target"]["fiscal_year"] = None
    return pa.array(rows, _arrow_type())  # not by way of pandas, which takes NaN for null


#: Ends an answer that is parsed as the first item of a list: without it a text after the object would pass.
_END = "skarn-end-of-answer"
_FIGURE = r"(BIGINT|DOUBLE|VOID|DECIMAL\(\d+,\d+\))"
#: What schema_of_variant() says of a valid target; keys are in order.
_SHAPE = (
    r"^OBJECT<company: STRING, financials: OBJECT<("
    + "|".join(rf"{k}: {_FIGURE}" for k in sorted(_NUMBERS))
    + r"|unit: STRING|, )*>, (fiscal_year: (BIGINT|VOID), )?form_type: STRING, (risk_factors: ARRAY<.*>, )?ticker: STRING>$"
)
_RISK_SHAPE = "OBJECT<category: STRING, summary: STRING, title: STRING>"


def proved(raw: Column) -> Column:
    """The result of validate_one() where Spark can tell it, else null."""
    # A sign on a zero is lost by decimals, and escaped surrogates may be lone ones: the parser sees to both.
    plain = raw.startswith("{") & raw.endswith("}") & ~raw.contains(_END) & ~raw.rlike(r"(?i)\\ud") & ~raw.rlike(r"(?<![eE])-0(?!\.\d*[1-9])")
    whole = F.try_parse_json(F.when(plain, F.concat(F.lit("["), raw, F.lit(f',"{_END}"]'))))

    def target(v: Column) -> Column:
        get = lambda path, kind: F.try_variant_get(v, f"$[0].{path}", kind)
        money = F.struct(*[get(f"financials.{k}", "double").alias(k) for k in _NUMBERS], F.coalesce(get("financials.unit", "string"), F.lit("USD")).alias("unit"))
        risks = F.coalesce(get("risk_factors", "array<struct<title:string,category:string,summary:string>>"), F.array().cast("array<struct<title:string,category:string,summary:string>>"))
        return F.struct(get("company", "string").alias("company"), get("ticker", "string").alias("ticker"), get("fiscal_year", "int").alias("fiscal_year"), get("form_type", "string").alias("form_type"), money.alias("financials"), risks.alias("risk_factors")).cast(TARGET_DDL)

    def valid(v: Column) -> Column:
        one = (F.try_variant_get(v, "$[1]", "string") == _END) & F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant")).rlike(_SHAPE)
        items = F.try_variant_get(v, "$[0].risk_factors", "array<variant>")
        risk = lambda r: (F.schema_of_variant(r) == _RISK_SHAPE) & F.try_variant_get(r, "$.category", "string").isin(*RISK_CATEGORIES)
        year = F.try_variant_get(v, "$[0].fiscal_year", "bigint")
        return one & (items.isNull() | F.forall(items, risk)) & (year.isNull() | year.between(-(1 << 31), (1 << 31) - 1))

    def result(strict: bool, error: Column, value: Column) -> Column:
        return F.struct(F.lit(strict).alias("strict"), F.lit(strict).alias("lenient"), error.cast("string").alias("error"), value.cast(TARGET_DDL).alias("target"))

    nothing = F.lit(None).cast(TARGET_DDL)
    found = F.element_at(F.transform(F.array(whole), lambda v: F.when(valid(v), result(True, F.lit(None), target(v)))), 1)
    return (
        F.when(raw.isNull() | raw.rlike(r"^[ \t\r\n]*$"), result(False, F.lit("empty"), nothing))
        .when(~raw.contains("{") & raw.rlike("[!-~]"), result(False, F.lit("schema: 1 validation error"), nothing))
        .otherwise(found)
    )


def validate_target(raw: Column) -> Column:
    """struct<strict, lenient, error, target> of a model's answer.

    strict: the whole answer is a valid target; lenient: one can be recovered from it. One unknown
    category or missing key makes the whole answer invalid. Null and blank answers are invalid. A year
    beyond 32 bits is valid, but the target has none. Python sees only the text of answers that proved()
    can't decide.
    """
    ship_code(SparkSession.active())
    fast = proved(raw)
    return F.coalesce(fast, F.arrow_udf(_validate, _RESULT)(F.when(fast.isNull(), raw)))
