import json

import pytest
from pyspark.sql import functions as F

from skarn.functions.validate import validate_one, validate_target

GOOD = {"company": "C", "ticker": "T", "form_type": "10-K", "financials": {"revenue": 1.5}}


def text(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v != "DROP"})


STRICT = [
    text(), text(fiscal_year="2025"), text(fiscal_year=2025.0), text(fiscal_year="2025.0"), text(fiscal_year=True), text(financials={"revenue": " 1.5 "}), text(financials={"revenue": True}),
    text(financials={"revenue": None}), text(financials={}), text(extra=1), text(risk_factors=[{"title": "t", "category": "cyber", "summary": "s", "more": 1}]), "  " + text() + "\n",
    '{"company":"a","company":"C","ticker":"T","form_type":"f","financials":{"revenue":NaN}}', text(financials={"revenue": "NaN"}), '{"company":"C","ticker":"T","form_type":"f","financials":{"revenue":1e400}}',
]
INVALID = [
    text(financials={"revenue": "1,500"}), text(financials={"revenue": "$1"}), text(financials={"revenue": ""}), text(fiscal_year=2025.5), text(fiscal_year="FY2025"), text(company=5), text(company=None),
    text(company="DROP"), text(financials=None), text(risk_factors=None), text(financials={"unit": None}), text(risk_factors=[{"title": "t", "category": "Cyber", "summary": "s"}]), "[1]", "plain", text().replace('"', "'"),
    text()[:-1] + ",}", "",  "   ", None,
]


@pytest.mark.parametrize("raw", STRICT)
def test_strict(raw):
    got = validate_one(raw)
    assert got["strict"] and got["lenient"] and got["error"] is None


@pytest.mark.parametrize("raw", INVALID)
def test_invalid(raw):
    got = validate_one(raw)
    assert not got["lenient"] and got["target"] is None and got["error"]


@pytest.mark.parametrize("raw", [f"```json\n{text()}\n```", f"Here: {text()} done", text() + " trailing", text(company="a } b { c") + "x"])
def test_lenient(raw):
    got = validate_one(raw)
    assert got["lenient"] and not got["strict"] and got["error"].startswith("schema")


def test_errors_are_counted():
    assert validate_one(text(risk_factors=[{"title": "a"}, {"summary": "b"}]))["error"] == "schema: 4 validation errors"


def test_as_a_column(spark):
    rows = [(text(financials={"revenue": "NaN"}),), (None,), ("x " + text(risk_factors=[{"title": "t", "category": "legal", "summary": "s"}]),)]
    got = spark.createDataFrame(rows, "raw string").select(validate_target(F.col("raw")).alias("p")).collect()
    assert got[0].p.strict and got[0].p.target.financials.revenue != got[0].p.target.financials.revenue
    assert got[1].p.error == "empty" and got[2].p.target.risk_factors[0].category == "legal" and got[2].p.target.financials.unit == "USD"
