"""Readers with declared schemas: raw filings, JSON lines, splits, caches, companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.canonical import python_json
from skarn.functions.text import blank_to_null, digest12, slug
from skarn.schemas import EXAMPLE_DDL, FILING_DDL, RISK_DDL, SPLITS

from . import versions

CORRUPT = "_corrupt"


REQUIRED = ("ticker", "cik", "company_name", "accession_no", "form_type", "financials")


def parse_filings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A folder of JSON files, one filing each, with the name of the file and the reason why it is rejected (null if it isn't).

    A file that can't be parsed, or lacks a required key, is rejected; with strict it ends the read instead.
    If just some of its other attributes can't be read, these are null and the row has a warning for each.
    """
    reader = spark.read.schema(FILING_DDL + f", {CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("file", F.input_file_name())
    required = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])
    # What the file says, each attribute as text: null if it is no JSON object.
    said = F.from_json(F.col(CORRUPT), "map<string,string>")
    optional = [c for c in rows.columns if c not in (*REQUIRED, CORRUPT, "file")]
    failed = [F.when(F.col(c).isNull() & said[c].isNotNull(), F.lit(f"{c}_failed")) for c in optional if c != "parse_warnings"]
    readable = F.col(CORRUPT).isNull() | (F.size(F.coalesce(F.map_keys(said), F.array())) > 0)
    warned = F.concat(F.coalesce("parse_warnings", F.array().cast("array<string>")), F.array_compact(F.array(*failed)))
    rows = rows.withColumn("parse_warnings", F.when(F.col(CORRUPT).isNull(), F.col("parse_warnings")).otherwise(warned))
    reason = F.when(~readable, F.col(CORRUPT)).when(~required, F.coalesce(CORRUPT, F.lit("a required key is missing")))
    return rows.withColumn("reason", reason).drop(CORRUPT)


def read_filings(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(filings, rejected: file and reason) of parse_filings()."""
    rows = parse_filings(spark, path, strict)
    return rows.where("reason is null").drop("file", "reason"), rows.where("reason is not null").select("file", "reason")


def read_lines(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = SPLITS, ddl: str = EXAMPLE_DDL) -> DataFrame:
    """Examples of all splits that are there, with their split: the newest version that sinks.write_splits() made, or files <split>.jsonl."""
    version = versions.current(spark, folder)
    if version and version.number:
        return read_lines(spark, version.paths(), ddl + ", split string").where(F.col("split").isin(*splits))
    found = [read_lines(spark, f"{folder}/{s}.jsonl", ddl).withColumn("split", F.lit(s)) for s in splits if path_exists(spark, f"{folder}/{s}.jsonl")]
    if not found:
        return spark.createDataFrame([], ddl + ", split string")
    return reduce(DataFrame.unionByName, found)


def labeled_filings(examples: DataFrame) -> DataFrame:
    """(ticker, accession_no, split, risks, n_risks, risk_digest) of examples with risks of their own, by accession_no."""
    kind = f"array<{RISK_DDL}>"
    target = F.from_json(F.element_at("messages", -1)["content"], f"struct<risk_factors:{kind}>")
    rows = examples.where(~F.coalesce(F.col("risk_factors_by_reference"), F.lit(False))).withColumn("risks", target["risk_factors"])
    rows = rows.where(F.size(F.coalesce("risks", F.array().cast(kind))) > 0)
    return rows.select("ticker", "accession_no", "split", "risks", F.size("risks").alias("n_risks"), digest12(python_json(F.col("risks"), kind, sort_keys=True)).alias("risk_digest")).orderBy("accession_no")


def parse_sections(raw: DataFrame) -> DataFrame:
    """Sections with '' as null, the fiscal year from the period, and a warning for each section that is missing."""
    names = ("business", "risk_factors", "management_discussion")
    rows = raw.withColumns({n: blank_to_null(F.col(n)) for n in names})
    rows = rows.withColumn("fiscal_year", F.substring("period_of_report", 1, 4).try_cast("int"))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(f"missing_{n}")) for n in names]))
    return rows.withColumn("parse_warnings", F.concat(F.coalesce("parse_warnings", F.array().cast("array<string>")), missing))


def cache_keys(rows: DataFrame, model: str, accession: str, prompt: str, text: str) -> DataFrame:
    """rows with cache_key: model, filing, and a digest of the whole prompt."""
    key = F.concat(slug(F.col(model)), F.lit("/"), slug(F.col(accession)), F.lit("_"), digest12(F.concat(F.col(prompt), F.col(text))))
    return rows.withColumn("cache_key", key)


def read_through(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with what cache (cache_key, raw, ...) has for them, and cache_hit; unreadable entries (null raw) are no hits."""
    return rows.join(cache.dropDuplicates(["cache_key"]), "cache_key", "left").withColumn("cache_hit", F.col("raw").isNotNull())


def universe(spark: SparkSession, tickers: list[str]) -> DataFrame:
    """(ticker, universe_pos) of a list of companies, which is a parameter."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(tickers)], "ticker string, universe_pos int")


# Companies whose symbol is no longer current, by permanent number.
IDENTIFIER_OVERRIDES = {"MMC": 62709, "ANSS": 1013462, "NVEE": 1532961}


def overrides(spark: SparkSession, table: dict[str, int] = IDENTIFIER_OVERRIDES) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "key string, identifier long")
