from pyspark.sql import functions as F

from skarn.functions import text as tx

CYBER = ("Cybersecurity breaches could disrupt our systems", "cyber", "A data breach of our information systems may expose customer data.")
PARAPHRASE = ("Cybersecurity breach and systems disruption", "cyber", "Breach of information systems could expose customer data.")
FX = ("Foreign exchange rates fluctuate", "financial", "Currency movements reduce reported revenue abroad.")


def variants(values, x):
    return values([tx.numeric_variants(F.col("x"))], [(x,)], "x double")[0][0]


def test_variants_of_large_figures(values):
    v = variants(values, 416161000000.0)
    assert "416,161" in v and "416,161,000,000" in v and v == sorted(set(v))


def test_no_variants_of_nothing(values):
    assert variants(values, None) == [] and variants(values, float("nan")) == []


def test_short_variants_are_no_evidence(values):
    assert all(sum(c.isdigit() for c in s) >= 3 for s in variants(values, 5000.0))
    assert "5.0" not in variants(values, 5000.0)
    assert "-1,234" in variants(values, -1234.0)


def test_grounding(values):
    rows = [("sales were 1,000 in all", 1000.0), ("nothing", 1000.0), ("x", None)]
    assert values([tx.is_grounded(F.col("t"), F.col("v"))], rows, "t string, v double") == [(True,), (False,), (None,)]


def test_window_starts_a_quarter_before_the_figure(values):
    text = "a" * 5000 + " 12,345 " + "b" * 5000
    got = values([tx.figure_window(F.col("t"), [F.col("v")], 400)], [(text, 12345.0), (text, None), ("short", 1.0)], "t string, v double")
    at = text.index("12,345")
    assert got[0][0] == text[at - 100 : at + 300]
    assert got[1][0] == text[:400] and got[2][0] == "short"


def test_excerpt_without_sections_is_a_header(values):
    names = ("company_name", "ticker", "form_type", "fiscal_year", "business", "income_statement", "balance_sheet", "management_discussion", "risk_factors")
    ddl = ", ".join(f"{n} string" for n in names) + ", v double"
    row = ("Test Co", "TEST", "10-K", None, None, "", None, "  ", None, None)
    full = ("Test Co", "TEST", "10-K", "2025", " b ", "i", None, None, "r" * 20000, None)
    got = values([tx.excerpt({n: F.col(n) for n in names}, [F.col("v")])], [row, full], ddl)
    assert got[0][0] == "Company: Test Co\nTicker: TEST\nForm: 10-K\nFiscal year: None"
    assert "\n\n## Item 1. Business\nb\n\ni\n\n## Item 1A. Risk Factors\n" in got[1][0]
    assert got[1][0].count("r" * 12000) == 1 and "r" * 12001 not in got[1][0]


def test_risk_slice(values):
    got = values([tx.risk_slice(F.col("t"))], [("x ## Item 1A. Risk Factors\ny ## Item 1A. Risk Factors z",), ("none",), (None,)], "t string")
    assert got == [("## Item 1A. Risk Factors\ny ## Item 1A. Risk Factors z",), ("",), ("",)]


def test_by_reference(values):
    rows = [("\t Incorporated by reference. ",), ("can be found",), ("risk " * 400 + "incorporated",), ("plain",), ("",), (None,)]
    assert values([tx.is_by_reference(F.col("t"))], rows, "t string") == [(True,), (True,), (False,), (False,), (False,), (False,)]


def test_statement_line_keeps_its_quirk(values):
    rows = [("Net sales", 1000.0), ("Price $0.001", 2.5)]
    assert values([tx.statement_line(F.col("l"), F.col("v"))], rows, "l string, v double") == [("Net sales: 1,000",), ("Price $01: 2.50",)]


def test_similarity(values):
    t = tx.tokens
    sim = tx.risk_similarity(t(F.col("a")), t(F.col("b")), t(F.col("c")), t(F.col("d")))
    rows = [(CYBER[0], CYBER[2], PARAPHRASE[0], PARAPHRASE[2]), (CYBER[0], CYBER[2], FX[0], FX[2])]
    got = values([sim], rows, "a string, b string, c string, d string")
    assert got[0][0] > 0.30 and got[1][0] == 0


def test_splits_are_stable_and_even(spark):
    rows = spark.range(2000).select(F.concat(F.lit("T"), "id").alias("t"))
    counts = {r["s"]: r["n"] for r in rows.groupBy(tx.assign_split(F.col("t")).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(counts["train"] / 2000 - 0.8) < 0.05
    import hashlib

    bucket = rows.limit(50).select("t", tx.split_bucket(F.col("t")).alias("b")).collect()
    assert all(r["b"] == int(hashlib.sha256(r["t"].upper().encode()).hexdigest()[:16], 16) / float(1 << 64) for r in bucket)


def test_first_object(values):
    rows = [('x {"a": "}"} y',), ('```json\n{"a": {"b": "\\"}"}}\n``` {',), ("none",), ('{"a": 1',), ("",), (None,)]
    assert values([tx.first_object(F.col("t"))], rows, "t string") == [('{"a": "}"}',), ('{"a": {"b": "\\"}"}}',), (None,), (None,), (None,), (None,)]


def test_keys(values):
    assert values([tx.slug(F.col("t")), tx.digest12(F.col("t"))], [("a/b:c",)], "t string") == [("a-b-c", __import__("hashlib").sha256(b"a/b:c").hexdigest()[:12])]
