import re

import pytest
from pyspark.sql import functions as F

from skarn.operators import facts

DDL = "accession_no string, concept string, fact_seq int, numeric_value double, period_start string, period_end string, period_instant string, is_dimensioned boolean, statement_type string"
P, NAN = "2025-01-01", float("nan")
EPS, NI, ASSETS = "us-gaap:EarningsPerShareDiluted", "us-gaap:NetIncomeLoss", "us-gaap:Assets"


def fact(concept, seq, value, end=P, start=None, instant=None, dim=False, stmt="IncomeStatement"):
    return ("a", concept, seq, value, start, end, instant, dim, stmt)


CASES = [
    ("dimensioned", [fact(EPS, 0, -0.22, dim=True), fact(EPS, 1, 3.51)], "eps_diluted", 3.51),
    ("nan", [fact(EPS, 0, NAN, stmt="Disclosures"), fact(EPS, 1, 6.26)], "eps_diluted", 6.26),
    ("other period", [fact(EPS, 0, 4.25, end="2024-01-01")], "eps_diluted", None),
    ("face beats note", [fact(ASSETS, 0, 999.0, stmt="Disclosures"), fact(ASSETS, 1, 5000.0, stmt="BalanceSheet")], "total_assets", 5000.0),
    ("exact concept", [fact("us-gaap:NetIncomeLossAttributableToNoncontrollingInterest", 0, 7e6), fact(NI, 1, 4.226e9)], "net_income", 4.226e9),
    ("annual beats quarter", [fact(NI, 0, 1.816e9, start="2024-10-01"), fact(NI, 1, 4.226e9, start="2024-01-02")], "net_income", 4.226e9),
    ("instant", [fact(ASSETS, 0, 359241000000.0, end=None, instant=P)], "total_assets", 359241000000.0),
    ("null dimension counts", [fact(ASSETS, 0, 5.0, dim=None)], "total_assets", 5.0),
    ("first of equals", [fact(ASSETS, 1, 2.0), fact(ASSETS, 0, 1.0)], "total_assets", 1.0),
    ("priority before preference", [fact("us-gaap:SalesRevenueNet", 0, 1.0), fact("us-gaap:Revenues", 1, 2.0, stmt="Disclosures")], "revenue", 2.0),
]


def select(spark, rows, period=P):
    f = spark.createDataFrame(rows, DDL)
    f = f.withColumns({"period": facts.period_of(F.col("period_end"), F.col("period_instant")), "duration_days": facts.duration_days(F.col("period_start"), F.col("period_end"))})
    periods = spark.createDataFrame([("a", period)], "accession_no string, period_of_report string")
    return {r["field"]: r["value"] for r in facts.select_facts(f, facts.concept_priority(spark), ["fact_seq"], periods).collect()}


@pytest.mark.parametrize("name, rows, field, want", CASES, ids=[c[0] for c in CASES])
def test_selection(spark, name, rows, field, want):
    assert select(spark, rows).get(field) == want


def test_no_period_of_its_own(spark):
    assert select(spark, [fact(EPS, 0, 4.25, end="2024-01-01")], None) == {"eps_diluted": 4.25}


def test_period_of_report_of_the_facts(spark):
    f = spark.createDataFrame([("a", NI, 1.0, "2024", "2025"), ("a", NI, 2.0, "2025", "2025"), ("b", NI, 3.0, "2024", None), ("c", NI, 4.0, "2024", "2025")], "accession_no string, concept string, numeric_value double, period string, period_of_report string")
    f = f.withColumns({"is_dimensioned": F.lit(False), "statement_type": F.lit("IncomeStatement"), "duration_days": F.lit(0), "fact_seq": F.col("numeric_value")})
    got = facts.select_facts(f, facts.concept_priority(spark), ["fact_seq"])
    assert sorted((r["accession_no"], r["value"]) for r in got.collect()) == [("a", 2.0), ("b", 3.0)]


def test_durations(values):
    d = facts.duration_days(F.col("s"), F.col("e"))
    assert values([d], [("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-01-31"), (None, P), ("x", P)], "s string, e string") == [(30,), (-1,), (0,), (0,)]


def test_fallbacks(spark):
    f = spark.createDataFrame([("a", None, 50.0, 5.0, None), ("b", 1.0, 2.0, 3.0, 4.0), ("c", None, 10.0, None, None)], "accession_no string, revenue double, net_income double, total_assets double, eps_diluted double")
    m = spark.createDataFrame([("a", 1000.0, 9.0, 9.0, 20.0), ("b", 9.0, 9.0, 9.0, 9.0), ("c", NAN, None, None, 0.0)], "accession_no string, revenue double, net_income double, total_assets double, shares_outstanding_diluted double")
    got = {r["accession_no"]: r for r in facts.with_fallbacks(f, m).collect()}
    assert got["a"].revenue == 1000.0 and got["a"].eps_diluted == 2.5 and got["a"].fact_warnings == ["revenue_from_metrics_fallback", "eps_diluted_derived_from_net_income_and_shares"]
    assert got["b"].shares_outstanding_diluted is None and got["b"].fact_warnings == []
    assert got["c"].revenue is None and got["c"].eps_diluted is None


def test_latest(spark):
    rows = spark.createDataFrame([(1, "2024", "a"), (1, "2025", "b"), (1, "2023", "c"), (2, "2020", "d")], "cik int, date string, acc string")
    assert sorted(r["acc"] for r in facts.latest_n(rows, "cik", "date", "acc", 2).collect()) == ["a", "b", "d"]


def test_statements(spark):
    ddl = "accession_no string, stmt string, line_no int, label string, abstract boolean, dimension boolean, value string, period string"
    rows = [("a", "i", 0, "ASSETS:", True, None, None, P), ("a", "i", 1, " Net sales ", None, False, "1000.0", P), ("a", "i", 2, "Seg", False, True, "5", P), ("a", "i", 3, "bad", False, False, "x", P), ("a", "i", 4, " ", False, False, "1", P), ("b", "i", 0, "x", True, False, "1", P)]
    rows += [("c", "i", k, f"l{k}", False, False, "1.5", P) for k in range(100)]
    got = {r["accession_no"]: r for r in facts.render_statements(spark.createDataFrame(rows, ddl), F.lit("Income Statement")).collect()}
    assert got["a"].text == f"## Income Statement (period ending {P})\nNet sales: 1,000"
    assert "b" not in got and got["c"].n_lines == 60 and got["c"].text.endswith("l59: 1.50")


def test_unpivot(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0, 2.0)], "accession_no string, line_no int, label string, `2025-01-01` double, `2024-01-01 (FY)` double")
    got = [tuple(r) for r in facts.unpivot_periods(df, ["accession_no", "label"]).collect()]
    assert got == [("a", "x", "2025-01-01", 0, "1.0"), ("a", "x", "2024-01-01 (FY)", 1, "2.0")]


def test_refresh(spark):
    ddl = "accession_no string, revenue double, net_income double, total_assets double, eps_diluted double"
    old = spark.createDataFrame([("a", 1.0, None, NAN, 4.0), ("b", 1.0, 2.0, 3.0, 4.0)], ddl)
    new = spark.createDataFrame([("a", 2.0, None, None, None)], ddl)
    got = sorted((r["accession_no"], r["field"] or "", r["failed"]) for r in facts.refresh_diff(old, new).collect())
    assert got == [("a", "eps_diluted", False), ("a", "revenue", False), ("b", "", True)]


def test_warnings(values):
    assert values([facts.kept_warnings(F.col("w"))], [(["revenue_from_metrics_fallback", "item1_failed: x", "xbrl_unavailable: y"],), ([],)], "w array<string>") == [(["item1_failed: x"],), ([],)]


def test_facts_of_a_concept_are_dealt_over_tasks(spark, capsys, request):
    k = F.col("id")
    f = spark.range(20_000).select(k.alias("accession_no"), F.when(k % 100 != 0, NI).otherwise(ASSETS).alias("concept"), k.cast("double").alias("numeric_value"), F.lit(False).alias("is_dimensioned"), F.lit("IncomeStatement").alias("statement_type"), F.lit(0).alias("duration_days"), F.lit(P).alias("period"), F.lit(0).alias("fact_seq"))
    # So few facts would be broadcast.
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast))
    got = facts.select_facts(f, facts.concept_priority(spark), ["fact_seq"])
    assert got.where("field = if(accession_no % 100 = 0, 'total_assets', 'net_income') and value = accession_no").count() == got.count() == 20_000
    got.explain()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", capsys.readouterr().out)
    assert dealt and not any(re.fullmatch(r"concept#\d+, \d+", by) for by in dealt)


def test_figures_with_fallbacks_are_dealt_over_tasks(spark, tmp_path, capsys):
    from skarn.plans.queries import QUERIES

    spark.sql("SELECT id AS o_orderkey, 1.0D + id AS o_totalprice, timestamp_ntz'1999-01-01' AS o_orderdate FROM range(50)").write.parquet(f"{tmp_path}/orders.parquet")
    line = "id AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 2.0D AS l_quantity, 5.0D + id AS l_extendedprice, 0.0D AS l_discount, 'R' AS l_returnflag, 'F' AS l_linestatus, timestamp_ntz'1999-02-01' AS l_shipdate"
    spark.sql(f"SELECT {line} FROM range(50)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["fact_fallback_eps"](spark, str(tmp_path))
    assert sorted((r["accession_no"], r["revenue"]) for r in got.collect()) == [(i, 5.0 + i) for i in range(50)]
    got.explain()
    assert not re.search(r"hashpartitioning\(concept#\d+, \d+\)", capsys.readouterr().out)


def test_orders_are_sorted_no_oftener_than_needed(spark, capsys):
    from skarn.plans.queries import QUERIES

    for name, most in (("fact_selection", 1), ("fact_fallback_eps", 3)):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        assert len(re.findall(r"FileScan parquet.*orders\.parquet", capsys.readouterr().out)) == most
