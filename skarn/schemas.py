"""Declared schemas and closed domains; no reader infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed domains of categories, verdicts, splits and strata, and the scored fields.
RISK_CATEGORIES = ("market", "operational", "regulatory", "legal", "cyber", "financial", "supply_chain", "talent", "climate", "competitive", "intellectual_property", "macroeconomic")
VERDICTS = ("exact", "close", "scale_error", "wrong", "missing", "spurious", "not_scored")
SPLITS = ("train", "val", "test")
STRATA = ("random", "test")
SCORED_FIELDS = ("revenue", "net_income", "total_assets", "eps_diluted")

# Concepts of each field in order of priority, and statements whose facts are preferred.
CONCEPTS = {
    "revenue": ("us-gaap:Revenues", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:RevenuesNetOfInterestExpense", "us-gaap:SalesRevenueNet"),
    "net_income": ("us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"),
    "total_assets": ("us-gaap:Assets",),
    "eps_diluted": ("us-gaap:EarningsPerShareDiluted", "us-gaap:IncomeLossFromContinuingOperationsPerDilutedShare"),
}
PREFERRED_STATEMENTS = ("IncomeStatement", "BalanceSheet")


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


FINANCIALS_DDL = "struct<revenue:double,net_income:double,total_assets:double,eps_diluted:double,shares_outstanding_diluted:double,unit:string>"
RISK_DDL = "struct<title:string,category:string,summary:string>"
TARGET_DDL = f"struct<company:string,ticker:string,fiscal_year:int,form_type:string,financials:{FINANCIALS_DDL},risk_factors:array<{RISK_DDL}>>"
FILING_DDL = (
    "ticker string, cik bigint, company_name string, accession_no string, form_type string, fiscal_year int, "
    "period_of_report string, filing_date string, business string, risk_factors string, management_discussion string, "
    f"income_statement string, balance_sheet string, financials {FINANCIALS_DDL}, parse_warnings array<string>"
)
EXAMPLE_DDL = "ticker string, accession_no string, risk_factors_by_reference boolean, messages array<struct<role:string,content:string>>"
PREDICTION_DDL = "model string, accession_no string, prompt_mode string, raw string, stop_reason string, input_tokens bigint, output_tokens bigint"
AUDIT_RISK_DDL = (
    "id string, ticker string, accession_no string, split string, stratum string, risk_index int, risk_digest string, "
    "teacher_title string, teacher_category string, teacher_summary string, human_category string, grounded boolean, summary_ok boolean, note string"
)
AUDIT_FILING_DDL = "accession_no string, ticker string, split string, stratum string, risk_digest string, n_teacher_risks int, n_sampled int, missed_risks int, note string"
