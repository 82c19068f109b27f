"""Selecting one authoritative figure for each document from noisy facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions.numeric import number_or_null, round_exact
from skarn.functions.text import blank_to_null, is_period_column, statement_line, strip
from skarn.schemas import CONCEPTS, PREFERRED_STATEMENTS, SCORED_FIELDS

#: Lines of a rendered statement, and what marks a warning about facts (fixed values).
MAX_LINES = 60
FACT_WARNINGS = ("financial_metrics_failed", "financial_facts_failed", "xbrl_unavailable", "_from_metrics_fallback", "eps_diluted_derived_from")


def concept_priority(spark: SparkSession, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """(field, concept, concept_rank): alternatives of each field, the best first."""
    return spark.createDataFrame([(f, c, i) for f, cs in concepts.items() for i, c in enumerate(cs)], "field string, concept string, concept_rank int")


def period_of(end: Column, instant: Column) -> Column:
    """A fact's period: its end, else its instant, else ''; blanks don't count."""
    return F.coalesce(blank_to_null(strip(end)), blank_to_null(strip(instant)), F.lit(""))


def duration_days(start: Column, end: Column) -> Column:
    """Days of a fact's period; 0 if either end is missing or no date. Negative spans stay negative."""
    return F.coalesce(F.datediff(F.try_to_timestamp(end, F.lit("yyyy-MM-dd")), F.try_to_timestamp(start, F.lit("yyyy-MM-dd"))), F.lit(0))


def select_facts(facts: DataFrame, priority: DataFrame, tie_break: list[str], periods: DataFrame | None = None) -> DataFrame:
    """(accession_no, field, concept, value): one fact for each filing and field that has a usable one.

    facts: accession_no, concept, numeric_value, is_dimensioned, statement_type, duration_days, period,
    and the columns of tie_break. period_of_report, of periods (accession_no, period_of_report) or of the
    facts themselves: a filing's own period, whose facts alone count; without one, all do. Of the usable
    facts the first concept by rank wins, then those on a face statement, the longest duration, and the
    first by tie_break.
    """
    rows = facts.withColumn("numeric_value", number_or_null(F.col("numeric_value")))
    rows = rows.where(F.col("numeric_value").isNotNull() & ~F.coalesce(F.col("is_dimensioned"), F.lit(False)))
    if periods is not None:
        rows = rows.join(periods.select("accession_no", "period_of_report"), "accession_no", "left")
    if "period_of_report" in rows.columns:
        rows = rows.where(F.col("period_of_report").isNull() | (F.col("period") == F.col("period_of_report")))
    # A concept has a fact of nearly every filing: joined by concept alone, all of these would be one task's.
    share = 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("accession_no"), F.lit(share)).cast("int"))
    rows = rows.join(priority.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(share - 1)))), ["concept", "_share"])
    preferred = F.coalesce(F.col("statement_type").isin(*PREFERRED_STATEMENTS), F.lit(False))
    best = Window.partitionBy("accession_no", "field").orderBy("concept_rank", preferred.desc(), F.desc("duration_days"), *tie_break)
    rows = rows.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return rows.select("accession_no", "field", "concept", F.col("numeric_value").alias("value"))


def pivot_fields(selected: DataFrame, fields: tuple[str, ...] = SCORED_FIELDS) -> DataFrame:
    """One row for each filing with a column for each field."""
    return selected.groupBy("accession_no").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def with_fallbacks(filings: DataFrame, metrics: DataFrame, fields: tuple[str, ...] = ("revenue", "net_income", "total_assets")) -> DataFrame:
    """filings with missing figures taken from metrics, earnings per share derived, and warnings added.

    metrics (accession_no, the fields, shares_outstanding_diluted) are read only where a scored field is
    missing; so shares are known only there.
    """
    m = metrics.select("accession_no", *[number_or_null(F.col(f)).alias(f"m_{f}") for f in (*fields, "shares_outstanding_diluted")])
    lacking = F.lit(False)
    for f in SCORED_FIELDS:
        lacking = lacking | F.col(f).isNull()
    rows = filings.join(m, "accession_no", "left").withColumn("lacking", lacking)
    warnings = []
    for f in fields:
        taken = F.col("lacking") & F.col(f).isNull() & F.col(f"m_{f}").isNotNull()
        warnings.append(F.when(taken, F.lit(f"{f}_from_metrics_fallback")))
    rows = rows.withColumn("_warnings", F.array(*warnings))
    for f in fields:
        rows = rows.withColumn(f, F.coalesce(F.col(f), F.when(F.col("lacking"), F.col(f"m_{f}"))))
    shares = F.when(F.col("lacking"), F.col("m_shares_outstanding_diluted"))
    derive = F.col("eps_diluted").isNull() & F.col("net_income").isNotNull() & F.coalesce(shares != 0, F.lit(False))
    rows = rows.withColumn("_warnings", F.array_compact(F.concat("_warnings", F.array(F.when(derive, F.lit("eps_diluted_derived_from_net_income_and_shares"))))))
    rows = rows.withColumn("eps_diluted", F.when(derive, round_exact(F.try_divide(F.col("net_income"), shares), 2)).otherwise(F.col("eps_diluted")))
    rows = rows.withColumn("shares_outstanding_diluted", shares).withColumnRenamed("_warnings", "fact_warnings")
    return rows.drop("lacking", *[f"m_{f}" for f in (*fields, "shares_outstanding_diluted")])


def latest_n(filings: DataFrame, company: str, date: str, key: str, n: int) -> DataFrame:
    """The n newest filings of each company, with their rank."""
    order = Window.partitionBy(company).orderBy(F.desc(date), F.desc(key))
    return filings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def latest_filings(filings: DataFrame, company: str, date: str, key: str, n: int, form: str = "10-K", form_col: str = "form_type") -> DataFrame:
    """The n newest filings of one form of each company; amendments have a form of their own (10-K/A) and don't count."""
    return latest_n(filings.where(F.col(form_col) == form), company, date, key, n)


def unknown_overrides(overrides: DataFrame, universe: DataFrame, company: str = "ticker") -> DataFrame:
    """Overrides whose key is no company of the universe: must be empty."""
    return overrides.join(universe.select(F.col(company).cast("string").alias("key")), "key", "left_anti")


def with_override(rows: DataFrame, key: str, overrides: DataFrame, into: str) -> DataFrame:
    """rows with the identifier that overrides (key, identifier) has for key, else key itself."""
    o = overrides.select(F.col("key").alias(key), F.col("identifier").cast("string").alias("_o"))
    return rows.join(o, key, "left").withColumn(into, F.coalesce("_o", F.col(key).cast("string"))).drop("_o")


def refresh_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = SCORED_FIELDS) -> DataFrame:
    """(accession_no, field, old, new, failed): fields that a refresh changes; filings without a new
    version fail, with one row and no field."""

    def long(df, name):
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), number_or_null(F.col(f)).alias("value")) for f in fields])
        return df.select("accession_no", F.inline(pairs)).withColumnRenamed("value", name)

    changed = long(old, "old").join(long(new, "new"), ["accession_no", "field"]).where(~F.col("old").eqNullSafe(F.col("new")))
    failed = old.join(new.select("accession_no"), "accession_no", "left_anti")
    nothing = failed.select("accession_no", F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("old"), F.lit(None).cast("double").alias("new"), F.lit(True).alias("failed"))
    return changed.withColumn("failed", F.lit(False)).unionByName(nothing)


def refresh_outcome(filings: DataFrame, fresh: DataFrame, fields: tuple[str, ...] = SCORED_FIELDS) -> DataFrame:
    """filings with the figures and fact warnings of fresh (accession_no, the fields, fact_warnings); all else stays as it was.

    Warnings that aren't about facts are kept, before the new ones. A filing that fresh lacks keeps its
    figures and warnings. Two columns tell what happened, for refresh_counters(): changed (the fields whose
    figure is another one, none if there is no new version) and failed (fresh lacks the filing).
    """
    new = fresh.select("accession_no", F.struct(*fields).alias("_new"), F.col("fact_warnings").alias("_warned"))
    rows = filings.join(new, "accession_no", "left")
    failed, money, changed = F.col("_new").isNull(), F.col("financials"), []
    for f in fields:
        value = number_or_null(F.col(f"_new.{f}"))
        changed.append(F.when(~failed & ~value.eqNullSafe(number_or_null(F.col(f"financials.{f}"))), F.lit(f)))
        money = money.withField(f, F.when(failed, F.col(f"financials.{f}")).otherwise(value))
    none = F.array().cast("array<string>")
    old = F.coalesce("parse_warnings", none)
    warned = F.when(failed, old).otherwise(F.concat(kept_warnings(old), F.coalesce("_warned", none)))
    rows = rows.withColumns({"changed": F.array_compact(F.array(*changed)), "failed": failed})
    return rows.withColumns({"financials": money, "parse_warnings": warned}).select(*filings.columns, "changed", "failed")


def refresh_counters(fields: tuple[str, ...] = SCORED_FIELDS) -> dict[str, Column]:
    """Counters of refresh_outcome(): rows, changed and failed ones, and changes by field."""
    out = {"n": F.count("*"), "changed": F.count_if(F.size("changed") > 0), "failed": F.count_if("failed")}
    return out | {f"changed_{f}": F.count_if(F.array_contains("changed", f)) for f in fields}


def refreshed(filings: DataFrame, fresh: DataFrame, fields: tuple[str, ...] = SCORED_FIELDS) -> DataFrame:
    """refresh_outcome() without what happened."""
    return refresh_outcome(filings, fresh, fields).select(*filings.columns)


def kept_warnings(warnings: Column) -> Column:
    """Warnings that a refresh of facts leaves: those that aren't about facts."""
    markers = F.array(*[F.lit(m) for m in FACT_WARNINGS])
    return F.filter(warnings, lambda w: ~F.exists(markers, lambda m: F.contains(w, m)))


def unpivot_periods(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Statement lines with a row for each period column (named YYYY-MM-DD...), and its place."""
    names = [c for c in statements.columns if c[:4].isdigit() and len(c) >= 10 and c[4] == "-"]
    pairs = F.array(*[F.struct(F.lit(c).alias("period"), F.lit(i).alias("period_pos"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)])
    return statements.select(*keys, F.inline(pairs)).where(is_period_column(F.col("period")))


def render_statements(lines: DataFrame, title: Column, most: int = MAX_LINES) -> DataFrame:
    """(accession_no, stmt, text, n_lines): statements of their current period as label: value lines.

    lines: accession_no, stmt, line_no, label, abstract, dimension, value, period. Headers, segments,
    blank labels and values that are no numbers go; then the first lines count. Statements without any
    line have no row.
    """
    value = number_or_null(F.col("value"))
    rows = lines.where(~F.coalesce(F.col("abstract"), F.lit(False)) & ~F.coalesce(F.col("dimension"), F.lit(False)))
    rows = rows.withColumns({"_v": value, "_l": strip(F.col("label"))}).where("_v is not null and _l <> ''")
    first = Window.partitionBy("accession_no", "stmt").orderBy("line_no")
    rows = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    rows = rows.withColumn("_t", title)
    out = rows.groupBy("accession_no", "stmt").agg(
        F.concat(F.lit("## "), F.first("_t"), F.lit(" (period ending "), F.first("period"), F.lit(")")).alias("head"),
        F.array_sort(F.collect_list(F.struct("nth", statement_line(F.col("_l"), F.col("_v")).alias("line")))).alias("body"),
    )
    text = F.concat_ws("\n", F.col("head"), F.transform("body", lambda b: b["line"]))
    return out.select("accession_no", "stmt", text.alias("text"), F.size("body").alias("n_lines"))


def statement_warnings(income: Column, balance: Column) -> Column:
    """Warnings for statements that are missing."""
    return F.array_compact(F.array(F.when(income.isNull(), F.lit("missing_income_statement")), F.when(balance.isNull(), F.lit("missing_balance_sheet"))))
