"""Column -> Column functions on text: figures, excerpts, markers, tokens, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Budgets of an excerpt's sections, in characters.
BUSINESS_CHARS, MDNA_CHARS, RISK_CHARS, STATEMENT_CHARS = 3_000, 6_000, 12_000, 3_500
RISK_MARKER = "## Item 1A. Risk Factors"
# What a section says that only points elsewhere, and how long it may be.
REFERENCE_MARKERS, REFERENCE_MAX_CHARS = ("incorporated", "by reference", "can be found"), 1_500
# Words that say nothing about a risk.
STOPWORDS = (
    "a an and any are as at be been but by can could for from has have if in into is it its "
    "may might must not of on or our ours that the their them these this those to us we were which "
    "will with would risk risks related relating result results affect affected adversely material "
    "materially business company operations operating financial condition"
).split()
TITLE_WEIGHT = 0.7


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def numeric_variants(value: Column) -> Column:
    """Sorted distinct renderings that a filing may use for a figure; none for null or NaN.

    Scaled by 1, 1e3 and 1e6; whole numbers with separators, one and two decimals; a trailing .0 goes;
    what has fewer than three digits is no evidence.
    """

    def of_scale(scale: float) -> Column:
        s = value / F.lit(scale)
        whole = F.rint(s)
        shown = F.array(F.when(F.abs(s - whole) < 1e-6, F.format_number(whole, 0)), F.format_number(s, 1), F.format_number(s, 2))
        return F.when(F.abs(s) >= 0.01, shown).otherwise(F.array().cast("array<string>"))

    shown = F.array_compact(F.concat(*[of_scale(s) for s in (1.0, 1e3, 1e6)]))
    short = F.transform(shown, lambda v: F.regexp_replace(v, r"\.0$", ""))
    kept = F.filter(short, lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")) >= 3)
    return F.when(value.isNull() | F.isnan(value), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(kept)))


def is_grounded(text: Column, value: Column) -> Column:
    """Whether any rendering of value is part of text; null if value is null."""
    return F.when(value.isNotNull(), F.exists(numeric_variants(value), lambda v: F.contains(text, v)))


def figure_window(text: Column, values: list[Column], budget: int) -> Column:
    """budget characters of text that start a quarter of budget before the first figure; its head without any."""
    variants = F.concat(*[numeric_variants(v) for v in values])
    places = F.filter(F.transform(variants, lambda v: F.instr(text, v)), lambda i: i > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - F.lit(budget // 4))
    return F.when(F.length(text) <= budget, text).otherwise(F.substring(text, start, F.lit(budget)))


def excerpt(f: dict[str, Column], facts: list[Column]) -> Column:
    """The bounded excerpt of a filing; sections that are null or blank are left out.

    f: company_name, ticker, form_type, fiscal_year, business, income_statement, balance_sheet,
    management_discussion, risk_factors; facts: figures whose place decides the window of the discussion.
    """
    business, mdna, risk = (F.coalesce(strip(f[k]), F.lit("")) for k in ("business", "management_discussion", "risk_factors"))

    def section(title: str, body: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit("\n" + title), body))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Company: "), f["company_name"]),
        F.concat(F.lit("Ticker: "), f["ticker"]),
        F.concat(F.lit("Form: "), f["form_type"]),
        F.concat(F.lit("Fiscal year: "), F.coalesce(f["fiscal_year"].cast("string"), F.lit("None"))),
        section("## Item 1. Business\n", F.substring(business, 1, BUSINESS_CHARS), business != ""),
        section("", F.substring(f["income_statement"], 1, STATEMENT_CHARS), f["income_statement"] != ""),
        section("", F.substring(f["balance_sheet"], 1, STATEMENT_CHARS), f["balance_sheet"] != ""),
        section("## Item 7. Management's Discussion and Analysis\n", figure_window(mdna, facts, MDNA_CHARS), mdna != ""),
        section(RISK_MARKER + "\n", F.substring(risk, 1, RISK_CHARS), risk != ""),
    )


def risk_slice(text: Column) -> Column:
    """From the first marker of the risk section to the end; '' without it."""
    at = F.instr(text, RISK_MARKER)
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.lit(""))


def is_by_reference(risk_text: Column) -> Column:
    """Whether a risk section only points elsewhere; false for null and empty text."""
    body = strip(risk_text)
    says = reduce(lambda a, b: a | b, [F.contains(F.lower(body), F.lit(m)) for m in REFERENCE_MARKERS])
    return F.coalesce((F.length(risk_text) > 0) & (F.length(body) <= REFERENCE_MAX_CHARS) & says, F.lit(False))


def statement_line(label: Column, value: Column) -> Column:
    """label: value with separators and two decimals; .00 goes wherever it stands in the line."""
    return F.replace(F.concat(label, F.lit(": "), F.format_number(value, 2)), F.lit(".00"), F.lit(""))


def is_period_column(name: Column) -> Column:
    return name.rlike(r"^\d{4}-\d{2}-\d{2}")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more that aren't stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of two token sets; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.lit(2.0) * shared / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def risk_similarity(title_a: Column, summary_a: Column, title_b: Column, summary_b: Column) -> Column:
    """Weighted overlap of two risks, given as token sets."""
    return F.lit(TITLE_WEIGHT) * dice(title_a, title_b) + F.lit(1 - TITLE_WEIGHT) * dice(summary_a, summary_b)


def split_bucket(ticker: Column) -> Column:
    """A stable number in [0, 1) of a company."""
    return F.conv(F.substring(F.sha2(F.upper(ticker), 256), 1, 16), 16, 10).cast("double") / F.lit(float(1 << 64))


def assign_split(ticker: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """The company's split, by its number; the rest is test."""
    b = split_bucket(ticker)
    return F.when(b < train, "train").when(b < train + val, "val").otherwise("test")


def digest12(c: Column) -> Column:
    """The first twelve hexadecimal digits of SHA-256: the form of all content keys."""
    return F.substring(F.sha2(c, 256), 1, 12)


def slug(c: Column) -> Column:
    """A name that is safe in a path."""
    return F.translate(c, "/:", "--")


def first_object(raw: Column) -> Column:
    """The JSON object in a model's answer: from the first { of the first fence (else of all) to its
    balanced }, braces in strings apart; null if there is none."""
    fenced = raw.rlike(r"(?s)```(?:json)?\s*(.*?)```")
    body = F.when(fenced, F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)).otherwise(raw)
    at = F.instr(body, "{")
    tail = F.substring(body, at, F.length(body))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        opens = (~s["quoted"] & (c == "{")).cast("int")
        closes = (~s["quoted"] & (c == "}")).cast("int")
        depth = s["depth"] + opens - closes
        done = s["end"] > 0
        end = F.when(done, s["end"]).when((closes == 1) & (depth == 0), s["i"] + 1).otherwise(F.lit(0))
        quoted = F.when(s["quoted"], s["escaped"] | (c != '"')).otherwise(c == '"')
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), end.alias("end"))

    chars = F.filter(F.split(tail, ""), lambda c: c != "")
    end = F.aggregate(chars, start, step, lambda s: s["end"])
    return F.when((at > 0) & (end > 0), F.substring(tail, F.lit(1), end))
