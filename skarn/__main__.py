"""python -m skarn COMMAND: the operators joined to jobs on tables and folders."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import audit, dataset, encode, facts, resample, scoring, usage
from skarn.schemas import AUDIT_FILING_DDL, AUDIT_RISK_DDL, PREDICTION_DDL, SCORED_FIELDS, SPLITS, STRATA
from skarn.sources import adapters, cache, filing_source, readers, sinks, versions
from skarn.tables import discard, materialize


class Failed(RuntimeError):
    """The job is done, but a part of it failed: its report, and an exit code of 1."""


def ingest(spark: SparkSession, a: argparse.Namespace) -> str:
    """Raw filings of a folder, or of a service, into a table, those not there yet; what can't be read is logged."""
    if not a.raw and not (a.service and a.tickers):
        raise ValueError("--raw, or --service with --tickers, says where filings come from")
    # Files are read, or a service is asked, once.
    if a.raw:
        read = materialize(readers.parse_filings(spark, a.raw), "raw")
    else:
        found = filing_source.read_service(spark, a.service, a.tickers, [a.form], a.newest, perSecond=a.per_second)
        read = materialize(found.withColumn("file", F.col("ticker")), "raw")
    good = readers.parse_sections(encode.subset(read.where("reason is null").drop("file", "reason"), ["accession_no"], a.limit, a.tickers))
    if a.newest and a.raw:
        good = facts.latest_filings(good, "ticker", "filing_date", "accession_no", a.newest, a.form).drop("rank")
    made = sinks.append_version(good, a.out, "accession_no")
    bad = read.where("reason is not null").select(F.col("file").alias("ticker"), "reason")
    failed = bad.count()
    if failed:
        sinks.log_failures(bad, f"{a.out}.failed")
    discard(read)
    return f"{made.counters['n']} new filings, {versions.read(spark, a.out).count()} filings at {a.out}; {failed} could not be read"


def refresh(spark: SparkSession, a: argparse.Namespace) -> str:
    """New figures and fact warnings for a table of filings; texts stay as they are."""
    base = versions.current(spark, a.filings)
    filings = versions.read(spark, a.filings, number=base.number or None) if base else spark.read.parquet(a.filings)
    rows, counters = facts.refresh_outcome(filings, spark.read.parquet(a.facts)), facts.refresh_counters()
    if a.dry_run:
        return sinks.refresh_report(versions.count(rows, counters), SCORED_FIELDS, dry_run=True)
    made = versions.write(rows, a.filings, base, counters, sinks.refuse_failures(a.allow_partial, a.filings), drop=("changed", "failed"))
    return sinks.refresh_report(made.counters, SCORED_FIELDS)


def made_by(name: str):
    """What package.module:function names, for adapters that come from outside."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def labels_of(spark: SparkSession, filings: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(accession_no, risks): from the table --labels, or by the labeler --labeler and its cache --cache, or none for every filing."""
    kind = "array<struct<title:string,category:string,summary:string>>"
    if a.labels:
        return spark.read.parquet(a.labels)
    if not a.labeler:
        return filings.select("accession_no", F.array().cast(kind).alias("risks"))
    rows = filings.select("accession_no", F.coalesce("risk_factors", F.lit("")).alias("risk_text"), F.lit(a.labeler).alias("labeler"), F.lit("").alias("prompt"))
    keyed = readers.cache_keys(rows, "labeler", "accession_no", "prompt", "risk_text")
    found = adapters.label(cache.look_up(keyed, a.cache).where("not cache_hit"), made_by(a.labeler), key="cache_key", text="risk_text", concurrent=a.concurrent, per_second=a.per_second)
    cache.add_answers(found.select("cache_key", F.to_json("risks").alias("raw")), a.cache)
    known = cache.look_up(keyed, a.cache).where("cache_hit")
    return known.select("accession_no", F.from_json("raw", kind).alias("risks"))


def build(spark: SparkSession, a: argparse.Namespace) -> str:
    """Chat examples of filings with labels, as JSON lines of each split; refused if a filing lacks labels."""
    base = versions.current(spark, a.out)
    filings = encode.subset(versions.read(spark, a.filings), ["accession_no"], a.limit, a.tickers)
    rows = dataset.build_outcome(filings, labels_of(spark, filings, a))
    made = sinks.write_splits(rows, a.out, base, dataset.build_counters(), sinks.refuse_failures(a.allow_partial, a.out), dataset.OUTCOME, ~F.col("failed"))
    written = readers.read_lines(spark, made.paths(), "ticker string, split string")
    companies = {r["split"]: r["n"] for r in written.groupBy("split").agg(F.countDistinct("ticker").alias("n")).collect()}
    return sinks.build_report(made.counters, companies)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> str:
    """Answers against examples: validity, rates by field, risks, intervals, cost; the report goes to a folder."""
    examples = readers.read_splits(spark, a.examples, (a.split,))
    examples = encode.subset(examples, ["accession_no"], a.limit)
    answers = spark.read.schema(PREDICTION_DDL + ", status string").json(a.answers).where(F.col("prompt_mode") == a.prompt_mode)
    scored = scoring.score_examples(examples, answers, strict=not a.allow_missing)
    # One pass over examples and answers writes a row for each filing; the rest of the report is made from these.
    scored.write.mode("overwrite").parquet(f"{a.out}/filings")
    scored = spark.read.schema(scored.schema).parquet(f"{a.out}/filings")
    rows = scored.select("accession_no", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("verdict")) for f in scoring.SCORED_FIELDS])))
    rates = scoring.verdict_rates(rows)
    risks = scoring.risk_report(scored.where("risk is not null").select("risk.*"))
    intervals = resample.bootstrap(scoring.filing_stats(scored), "accession_no", list(scoring.METRICS)).orderBy("metric")
    run = answers.join(examples.select("accession_no"), "accession_no", "left_semi").withColumn("status", F.coalesce("status", F.when(F.coalesce("raw", F.lit("")) == "", "failed").otherwise("generated")))
    stats = usage.run_cost(usage.run_stats(run, ["model"]), a.price_in, a.price_out)
    validity = scoring.validity_rates(scored)
    about = {"answers": a.answers, "split": a.split, "prompt mode": a.prompt_mode}
    parts = {"validity": validity, "fields": rates, "risks": risks, "intervals": intervals, "run": stats}
    shown = {name: df.limit(200).collect() for name, df in parts.items()}  # a row, or a row for each field, metric or model
    for name, df in parts.items():
        sinks.write_report(spark.createDataFrame(shown[name], df.schema), f"{a.out}/{name}")
    local = {name: spark.createDataFrame(found, parts[name].schema) for name, found in shown.items()}
    report = [sinks.field_report(local["fields"], "Evaluation", about)]
    report += [sinks.markdown(local[name], title) for name, title in (("validity", "Validity"), ("risks", "Risks"), ("intervals", "Intervals"), ("run", "Run"))]
    text = "\n\n".join(report)
    if failed := sum(r["failed"] for r in shown["run"]):
        raise Failed(f"{text}\n\n{failed} answers failed: this is no result of the model")
    return text


def sample(spark: SparkSession, a: argparse.Namespace) -> str:
    """A sheet of risks to be reviewed, drawn from the labels of all splits."""
    filings = materialize(readers.labeled_filings(readers.read_splits(spark, a.examples)), "labeled")
    risks, chosen = audit.draw_sheet(filings, a.filings, a.per_filing, a.test_filings, a.seed)
    if readers.path_exists(spark, a.out) and not a.force:
        raise sinks.RefusedError(f"{a.out} exists; a new sheet would lose what was reviewed in it")
    sinks.write_once(risks, f"{a.out}/risks", force=True)
    sinks.write_once(chosen, f"{a.out}/filings", force=True)
    risks, chosen = spark.read.schema(AUDIT_RISK_DDL).json(f"{a.out}/risks"), spark.read.schema(AUDIT_FILING_DDL).json(f"{a.out}/filings")
    meta = audit.population(filings, risks).withColumns({"seed": F.lit(a.seed), "n_filings": F.lit(a.filings), "per_filing": F.lit(a.per_filing), "test_filings": F.lit(a.test_filings)})
    sinks.write_report(meta, f"{a.out}/meta")
    text = sinks.markdown(meta, "Sheet") + "\n\n" + sinks.markdown(audit.crosstab(chosen).orderBy("stratum", "split"), "Filings")
    discard(filings)
    return text


def score_audit(spark: SparkSession, a: argparse.Namespace) -> str:
    """Agreement with intervals, confusions, recall and notes of a reviewed sheet, by stratum; rows whose labels have changed are left out."""
    sheet = materialize(spark.read.schema(AUDIT_RISK_DDL).json(a.sheet), "sheet")
    live = readers.labeled_filings(readers.read_splits(spark, a.examples)).select("accession_no", "risk_digest") if a.examples else None
    stale = audit.stale_rows(sheet, live).count() if live is not None else 0
    rows = materialize(audit.reviewed(sheet, live), "reviewed")
    parts = [f"{rows.count()} of {sheet.count()} rows are reviewed and count; {stale} are stale", sinks.markdown(audit.agreement(rows, ["stratum"]).orderBy("stratum"), "Agreement")]
    names = ["category_agreement", "category_agreement_recorded", "grounded_rate", "summary_ok_rate"]
    for stratum in STRATA:
        stats = audit.cluster_stats(rows.where(F.col("stratum") == stratum))
        found = resample.bootstrap(stats, "accession_no", names, seed=a.seed, least=resample.LEAST_CLUSTERS, gaps={"anchoring_gap": (names[1], names[0])})
        few = f"# Intervals, {stratum}\n\nfewer than {resample.LEAST_CLUSTERS} filings: none"
        parts.append(few if found.isEmpty() else sinks.markdown(found.orderBy("metric"), f"Intervals, {stratum}"))
    parts += [sinks.markdown(audit.confusions(rows), "Confusions")]
    if a.read:
        parts.append(sinks.markdown(audit.implied_recall(spark.read.schema(AUDIT_FILING_DDL).json(a.read), ["stratum"]), "Recall, at most"))
    parts.append(sinks.markdown(audit.check_notes(sheet), "Notes"))
    for df in (sheet, rows):
        discard(df)
    return "\n\n".join(parts)


def encoded(spark: SparkSession, a: argparse.Namespace) -> str:
    """Examples of a split as padded batches of token ids, by the built-in tokenizer; those that can't fit are set apart."""
    base = versions.current(spark, a.out)
    rows = encode.subset(readers.read_splits(spark, a.examples, (a.split,)), ["accession_no"], a.limit)
    ids = materialize(encode.encode(rows, encode.code_points(encode.render_prompt(F.col("messages"))), encode.code_points(F.element_at("messages", -1)["content"]), a.max_len).drop("messages"), "encoded")
    batches = encode.pad_batches(ids.where("fits"), ["accession_no"], a.size, a.multiple)
    own = F.size(F.filter("labels", lambda x: x != encode.IGNORE))
    counters = {"examples": F.count("*"), "truncated": F.count_if("truncated"), "widest": F.max("width"), "supervised": F.sum(own), "cells": F.sum("width")}
    made = versions.write(batches.drop("fits"), a.out, base, counters)
    rejected = encode.rejects(ids, ["ticker", "accession_no"])
    n = rejected.count()
    if n:
        sinks.log_failures(rejected.select("ticker", F.concat_ws(": ", "accession_no", "reason").alias("reason")), f"{a.out}.rejected")
    discard(ids)
    return "\n".join(f"{k}: {v}" for k, v in (made.counters | {"rejected": n}).items())


def measure(spark: SparkSession, a: argparse.Namespace) -> str:
    """Lengths of all examples, and how many fit context windows, by the built-in tokenizer."""
    rows = readers.read_splits(spark, a.examples)
    ids = encode.measured(rows, encode.code_points(encode.render_prompt(F.col("messages"))), encode.code_points(F.element_at("messages", -1)["content"]), a.special)
    parts: list[tuple[DataFrame, str]] = [(encode.length_distribution(ids, "total", "completion"), "Lengths"), (encode.window_fit(ids, "total", "completion", a.windows), "Windows")]
    return "\n\n".join(sinks.markdown(df, title) for df, title in parts)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m skarn", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(run, name, *needed):
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        return p

    p = add(ingest, "ingest", "out")
    p.add_argument("--raw", help="a folder of JSON files")
    p.add_argument("--service", help="package.module:function that makes a filing service")
    p.add_argument("--per-second", type=float, help="calls a second for each company's task")
    p.add_argument("--newest", type=int, help="only so many newest filings of each company")
    p.add_argument("--form", default="10-K")
    q = add(build, "build", "filings", "out")
    q.add_argument("--labels", help="a table (accession_no, risks)")
    q.add_argument("--labeler", help="package.module:function that makes a labeler")
    q.add_argument("--cache", help="the folder of the labeler's cache")
    q.add_argument("--concurrent", type=int, default=1, help="calls of the labeler at once")
    q.add_argument("--per-second", type=float, help="calls of the labeler a second, of all tasks")
    for each in (p, q):
        each.add_argument("--limit", type=int)
        each.add_argument("--tickers", type=lambda x: x.split(","))
    p = add(refresh, "refresh", "filings", "facts")
    p.add_argument("--dry-run", action="store_true")
    for each in (p, q):
        each.add_argument("--allow-partial", action="store_true")
    p = add(evaluate, "evaluate", "examples", "answers", "out")
    p.add_argument("--split", default="test", choices=SPLITS)
    p.add_argument("--prompt-mode", default="trained")
    p.add_argument("--limit", type=int)
    p.add_argument("--allow-missing", action="store_true")
    p.add_argument("--price-in", type=float, default=0.0, help="of a million tokens")
    p.add_argument("--price-out", type=float, default=0.0)
    p = add(sample, "sample", "examples", "out")
    for name, default in (("filings", 12), ("per-filing", 4), ("test-filings", 3), ("seed", 0)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--force", action="store_true")
    p = add(score_audit, "audit", "sheet")
    p.add_argument("--examples", help="splits with the labels of now")
    p.add_argument("--read", help="rows of filings with the number of risks that were missed")
    p.add_argument("--seed", type=int, default=0)
    p = add(encoded, "encode", "examples", "out")
    p.add_argument("--split", default="train", choices=SPLITS)
    p.add_argument("--limit", type=int)
    for name, default in (("max-len", 12288), ("size", 8), ("multiple", 8)):
        p.add_argument(f"--{name}", type=int, default=default)
    p = add(measure, "measure", "examples")
    p.add_argument("--windows", type=lambda x: [int(n) for n in x.split(",")], default=[2048, 4096, 8192, 16384])
    p.add_argument("--special", type=int, default=0)
    return top


def main(arguments: list[str]) -> int:
    a = parser().parse_args(arguments)
    try:
        print(a.run(SparkSession.builder.appName(f"skarn-{a.command}").getOrCreate(), a))
    except Failed as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
