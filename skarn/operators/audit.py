"""Scoring a label audit: blind and recorded agreement, confusions, recall, stale rows, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.numeric import ratio
from skarn.operators import sampling
from skarn.schemas import AUDIT_FILING_DDL, AUDIT_RISK_DDL, RISK_CATEGORIES

# The grammar of notes.
BLIND, UNINFORMATIVE, REVISED = r"blind verdict was '([a-z_]+)'", r"\bUNINFORMATIVE\b\s*:", r"\brevised\b"


def risk_rows(filings: DataFrame) -> DataFrame:
    """A row for each risk of filings (accession_no, ..., risks): its place, title, category and summary beside the filing's other columns."""
    others = [c for c in filings.columns if c != "risks"]
    return filings.select(*others, F.posexplode("risks").alias("risk_index", "risk")).select(*others, "risk_index", "risk.*")


def with_filings(rows: DataFrame, filings: DataFrame) -> DataFrame:
    """Risk rows with the row of their filing; rows of no filing go."""
    more = [c for c in filings.columns if c not in rows.columns]
    return rows.join(filings.select("accession_no", *more), "accession_no")


def is_uninformative(note: Column) -> Column:
    return F.coalesce(note.rlike(UNINFORMATIVE), F.lit(False))


def blind_category(note: Column, human: Column) -> Column:
    """The category chosen before the teacher's was seen: from the note of a revised row."""
    return F.when(note.rlike(BLIND), F.regexp_extract(note, BLIND, 1)).otherwise(human)


def stale_rows(sheet: DataFrame, live: DataFrame) -> DataFrame:
    """Rows whose filing has other labels by now; a filing that is gone makes no row stale."""
    now = live.select("accession_no", F.col("risk_digest").alias("_live"))
    return sheet.join(now, "accession_no").where(F.col("_live").isNotNull() & (F.col("_live") != F.col("risk_digest"))).drop("_live")


def reviewed(sheet: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Reviewed rows that aren't stale, with blind category and whether their category counts."""
    rows = sheet if live is None else sheet.join(stale_rows(sheet, live).select("id"), "id", "left_anti")
    rows = rows.where(F.col("human_category").isNotNull())
    return rows.withColumns({"blind": blind_category(F.col("note"), F.col("human_category")), "counts": ~is_uninformative(F.col("note"))})


def agreement(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of reviewed() rows by columns; each over the rows that its verdict is known for, null without any."""
    agree = F.col("blind") == F.col("teacher_category")
    recorded = F.col("human_category") == F.col("teacher_category")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_reviewed"),
        F.countDistinct("accession_no").alias("n_filings"),
        F.avg(F.when(F.col("counts"), agree.cast("double"))).alias("category_agreement"),
        F.avg(F.when(F.col("counts"), recorded.cast("double"))).alias("category_agreement_recorded"),
        F.count_if(~F.col("counts")).alias("n_uninformative"),
        F.count_if(F.col("counts") & (F.col("blind") != F.col("human_category"))).alias("n_revised"),
        F.avg(F.col("grounded").cast("double")).alias("grounded_rate"),
        F.avg(F.col("summary_ok").cast("double")).alias("summary_ok_rate"),
    )


def confusions(rows: DataFrame) -> DataFrame:
    """(teacher_category, human_category, n) of disagreements among rows that count."""
    wrong = rows.where(F.col("counts") & (F.col("blind") != F.col("teacher_category")))
    return wrong.groupBy("teacher_category", F.col("blind").alias("human_category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "teacher_category", "human_category")


def implied_recall(filings: DataFrame, by: list[str]) -> DataFrame:
    """(by, filings_read, labelled, missed, recall) over filings that were read to the end."""
    read = filings.where("missed_risks is not null").groupBy(*by).agg(F.count("*").alias("filings_read"), F.sum("n_teacher_risks").alias("labelled"), F.sum("missed_risks").alias("missed"))
    return read.withColumn("recall", F.when(F.col("labelled") > 0, ratio(F.col("labelled"), F.col("labelled") + F.col("missed"))))


def check_notes(sheet: DataFrame) -> DataFrame:
    """(id, problem) of notes whose markers can't be understood."""
    note = F.coalesce("note", F.lit(""))
    blind = F.when(note.rlike(BLIND), F.regexp_extract(note, BLIND, 1))
    problems = F.array(
        F.when(note.rlike(REVISED) & blind.isNull(), F.lit("revised_without_blind_verdict")),
        F.when(blind.isNotNull() & ~blind.isin(*RISK_CATEGORIES), F.lit("unknown_blind_category")),
        F.when(F.contains(note, F.lit("UNINFORMATIVE")) & ~note.rlike(UNINFORMATIVE), F.lit("uninformative_without_colon")),
    )
    return sheet.select("id", F.explode(F.array_compact(problems)).alias("problem"))


def cluster_stats(rows: DataFrame) -> DataFrame:
    """Sufficient statistics of each filing for resample.bootstrap()."""

    def both(name: str, hit: Column, known: Column):
        return [F.sum(F.when(known, hit.cast("double")).otherwise(0.0)).alias(f"{name}_num"), F.sum(known.cast("double")).alias(f"{name}_den")]

    return rows.groupBy("accession_no").agg(
        *both("category_agreement", F.col("blind") == F.col("teacher_category"), F.col("counts")),
        *both("category_agreement_recorded", F.col("human_category") == F.col("teacher_category"), F.col("counts")),
        *both("grounded_rate", F.col("grounded"), F.col("grounded").isNotNull()),
        *both("summary_ok_rate", F.col("summary_ok"), F.col("summary_ok").isNotNull()),
    )


def draw_sheet(filings: DataFrame, n: int, per_filing: int, test_filings: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(risk rows, filing rows) of a sheet to be reviewed, from filings of readers.labeled_filings().

    n random filings and test_filings more of the test split, and per_filing risks of each (all, if
    fewer). What a reviewer fills in is null; an id is the filing's key and the risk's place.
    """
    chosen = sampling.draw_strata(filings.drop("n_risks"), "accession_no", n, test_filings, seed=seed)
    risks = sampling.draw_within(risk_rows(chosen), "accession_no", "risk_index", per_filing, seed)
    names = {"title": "teacher_title", "category": "teacher_category", "summary": "teacher_summary"}
    sheet = risks.withColumnsRenamed(names).withColumn("id", F.concat_ws("#", "accession_no", F.col("risk_index").cast("string")))
    counts = sheet.groupBy("accession_no").agg(F.count("*").cast("int").alias("n_sampled"))
    of = chosen.withColumn("n_teacher_risks", F.size("risks")).join(counts, "accession_no")
    return _as(sheet, AUDIT_RISK_DDL), _as(of, AUDIT_FILING_DDL)


def _as(rows: DataFrame, ddl: str) -> DataFrame:
    """rows with the columns of a schema; those that rows lacks are null."""
    fields = [part.strip().split(" ", 1) for part in ddl.split(",")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def crosstab(rows: DataFrame) -> DataFrame:
    """(stratum, split, n): counts of cells that aren't empty."""
    return rows.groupBy("stratum", "split").agg(F.count("*").alias("n"))


def population(filings: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: filings, risks, and how many risks were sampled."""
    return filings.agg(F.count("*").alias("filings"), F.sum("n_risks").alias("risks")).crossJoin(F.broadcast(sampled.agg(F.count("*").alias("sampled"))))  # one row each
