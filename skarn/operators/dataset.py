"""Building the chat dataset: excerpts, grounding, splits, examples and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.canonical import python_json
from skarn.functions.numeric import ratio
from skarn.functions.text import assign_split, excerpt, is_by_reference, is_grounded
from skarn.schemas import RISK_CATEGORIES, SCORED_FIELDS, SPLITS

ANCHOR_FIELDS = ("revenue", "net_income", "total_assets")
#: The system turn of an example; a parameter of the dataset, not of the operators.
SYSTEM_PROMPT = "Extract the requested fields from the filing excerpt as one JSON object."


def with_excerpt(filings: DataFrame) -> DataFrame:
    """filings with the excerpt that a model sees."""
    names = ("company_name", "ticker", "form_type", "fiscal_year", "business", "income_statement", "balance_sheet", "management_discussion", "risk_factors")
    return filings.withColumn("excerpt", excerpt({n: F.col(n) for n in names}, [F.col(f"financials.{f}") for f in ANCHOR_FIELDS]))


def with_grounded(filings: DataFrame) -> DataFrame:
    """financials without the scored figures that the excerpt doesn't show."""
    money = F.col("financials")
    for f in SCORED_FIELDS:
        kept = F.when(is_grounded(F.col("excerpt"), F.col(f"financials.{f}")), F.col(f"financials.{f}"))
        money = money.withField(f, kept)
    return filings.withColumn("financials", money)


def grounding_rates(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, hits, total, rate) over figures that aren't null; rows have excerpt and the fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), is_grounded(F.col("excerpt"), F.col(f)).alias("ok")) for f in fields])
    long = rows.select(F.inline(pairs)).where("ok is not null")
    return long.groupBy("field").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total")).withColumn("rate", ratio(F.col("hits"), F.col("total")))


def build_outcome(filings: DataFrame, labels: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """(ticker, accession_no, split, risk_factors_by_reference, messages) of every filing, and what build_counters() counts.

    labels: accession_no, risks array<struct<title, category, summary>>; of several of one filing any counts. The
    other columns are failed (no labels: such a row is no example), risks, and grounded (whether the excerpt
    shows each scored figure; null without one).
    """
    shown = F.struct(*[is_grounded(F.col("excerpt"), F.col(f"financials.{f}")).alias(f) for f in SCORED_FIELDS])
    rows = with_excerpt(filings).withColumn("grounded", shown)
    money = F.col("financials")
    for f in SCORED_FIELDS:
        money = money.withField(f, F.when(F.col(f"grounded.{f}"), F.col(f"financials.{f}")))
    known = labels.where("risks is not null").select("accession_no", F.col("risks")).dropDuplicates(["accession_no"])
    rows = rows.withColumn("financials", money).join(known, "accession_no", "left").withColumn("failed", F.col("risks").isNull())
    target = F.struct(F.col("company_name").alias("company"), "ticker", "fiscal_year", "form_type", "financials", F.col("risks").alias("risk_factors"))
    # Its type is that of these columns, whatever more or less than the declared one they have.
    rows = rows.withColumn("target", target)
    turns = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", F.lit(system_prompt)), ("user", F.col("excerpt")), ("assistant", python_json(F.col("target"), rows.schema["target"].dataType, 2, ascii_only=False)))])
    return rows.select("ticker", "accession_no", assign_split(F.col("ticker")).alias("split"), is_by_reference(F.col("risk_factors")).alias("risk_factors_by_reference"), turns.alias("messages"), "failed", "risks", "grounded")


def build_examples(filings: DataFrame, labels: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """The rows of build_outcome() that are examples."""
    return build_outcome(filings, labels, system_prompt).where("not failed").drop(*OUTCOME)


#: Columns of build_outcome() beside those of an example.
OUTCOME = ("failed", "risks", "grounded")


def build_counters() -> dict[str, Column]:
    """Counters of build_outcome(): rows, failures, examples by split, filings by reference, grounded figures, risks and their categories."""
    made = ~F.col("failed")
    out = {"n": F.count("*"), "failed": F.count_if("failed"), "by_reference": F.count_if("risk_factors_by_reference")}
    out |= {f"split_{s}": F.count_if(made & (F.col("split") == s)) for s in SPLITS}
    for f in SCORED_FIELDS:
        out |= {f"grounded_{f}": F.count_if(F.col(f"grounded.{f}")), f"figures_{f}": F.count(F.col(f"grounded.{f}"))}
    size = F.when(made, F.size("risks"))
    out |= {"least_risks": F.min(size), "mean_risks": F.avg(size), "most_risks": F.max(size)}
    of = lambda c: F.size(F.filter("risks", lambda r: r["category"] == c))
    return out | {f"category_{c}": F.coalesce(F.sum(F.when(made, of(c))), F.lit(0)) for c in RISK_CATEGORIES}


def split_counts(rows: DataFrame, ticker: str) -> DataFrame:
    """(split, filings, companies), with a row for every split."""
    domain = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    found = rows.withColumn("split", assign_split(F.col(ticker))).groupBy("split").agg(F.count("*").alias("filings"), F.countDistinct(ticker).alias("companies"))
    return domain.join(found, "split", "left").fillna(0, ["filings", "companies"])


def split_leaks(rows: DataFrame, company: str, split: str = "split") -> DataFrame:
    """Companies that are in more than one split: must be empty."""
    return rows.groupBy(company).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def split_freshness(rows: DataFrame, ticker: str, year: str, since: int) -> DataFrame:
    """(split, filings, companies, share_fresh): the share of filings of the year since or later."""
    rows = rows.withColumn("split", assign_split(F.col(ticker)))
    return rows.groupBy("split").agg(F.count("*").alias("filings"), F.countDistinct(ticker).alias("companies"), F.avg((F.col(year) >= since).cast("double")).alias("share_fresh"))


def category_distribution(rows: DataFrame, category: str) -> DataFrame:
    """(category, n): most frequent first, equal ones by name."""
    return rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def list_sizes(rows: DataFrame, key: str) -> DataFrame:
    """One row: least, mean and most rows of a key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def modal_share(rows: DataFrame, theme: str, category: str) -> DataFrame:
    """(theme, categories, n, modal_category, modal_share): how far one category has a theme to itself."""
    counts = rows.groupBy(F.col(theme).alias("theme"), F.col(category).alias("category")).agg(F.count("*").alias("n"))
    out = counts.groupBy("theme").agg(F.count("*").alias("categories"), F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("top"))
    return out.select("theme", "categories", "n", F.col("top.category").alias("modal_category"), (-F.col("top.m") / F.col("n")).alias("modal_share"))
