"""Sinks: incremental appends, dead letters, guarded and staged overwrites, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.schemas import RISK_CATEGORIES, SCORED_FIELDS, SPLITS

from . import versions
from .readers import path_exists
from .versions import RefusedError, Version, filesystem as _fs


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't there yet."""
    return rows.join(existing.select(key), key, "left_anti")


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the table at path lacks, one for each key; returns those that were new."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if path_exists(spark, path):
        fresh = new_rows(fresh, spark.read.schema(rows.schema).parquet(path), key)
    fresh.write.mode("append").parquet(path)
    return fresh


def log_failures(failures: DataFrame, path: str) -> None:
    """Dead letters: (ticker, reason) appended as tab-separated lines."""
    failures.select("ticker", F.regexp_replace("reason", r"[\t\r\n]+", " ").alias("reason")).write.mode("append").option("sep", "\t").csv(path)


def staged_overwrite(rows: DataFrame, path: str, failures: int = 0, allow_partial: bool = False, partition_by: str | None = None) -> None:
    """Replaces the table at path, after all of it is written beside it.

    With failures, and without allow_partial, nothing is written. The old table is moved aside and the
    new one into its place: two renames, between which readers find no table. If the second fails, the
    old one is put back; it is deleted only when the new one stands.
    """
    if failures and not allow_partial:
        raise RefusedError(f"{failures} rows failed; the table at {path} stays as it is")
    spark, stage = rows.sparkSession, f"{path}.stage-{uuid.uuid4().hex[:8]}"
    writer = rows.write.partitionBy(partition_by) if partition_by else rows.write
    writer.parquet(stage)
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex[:8]}")
    new, had = _fs(spark, stage)[1], fs.exists(target)
    if had and not fs.rename(target, old):
        raise RefusedError(f"the table at {path} can't be moved; the new one is at {stage}")
    if not fs.rename(new, target):
        if had and not fs.rename(old, target):
            raise RefusedError(f"the new table at {stage} can't be moved, nor the old one back from {old}")
        raise RefusedError(f"the new table at {stage} can't be moved; the table at {path} is as it was")
    if had:
        fs.delete(old, True)


def append_version(rows: DataFrame, path: str, key: str) -> Version:
    """append_new() into a versioned table: the rows that it lacks, one for each key, become its next version's; counters: n, how many."""
    spark, base = rows.sparkSession, versions.current(rows.sparkSession, path)
    fresh = rows.dropDuplicates([key])
    if base:
        fresh = new_rows(fresh, versions.read(spark, path, rows.schema, number=base.number or None), key)
    return versions.write(fresh, path, base, {"n": F.count("*")}, append=True)


def refuse_failures(allow_partial: bool, path: str):
    """A guard for versions.write(): with a counter failed above 0 the table stays, unless partial results are allowed."""
    return lambda c: f"{c['failed']} rows failed; the table at {path} stays as it is" if c["failed"] and not allow_partial else None


def write_splits(examples: DataFrame, folder: str, base: Version | None, counters: dict | None = None, guard=None, drop: tuple[str, ...] = (), where=None) -> Version:
    """The next version of a set of splits: JSON lines, all splits written by one job and committed at once.

    readers.read_splits() reads them back, a split without examples as an empty one. See versions.write() for
    counters and guard.
    """
    return versions.write(examples, folder, base, counters, guard, kind="json", partition_by="split", drop=drop, where=where)


def cache_answers(answers: DataFrame, path: str) -> DataFrame:
    """Adds answers (cache_key, raw, ...) that the cache at path lacks; failed ones (null raw) aren't kept."""
    return append_new(answers.where(F.col("raw").isNotNull()), path, "cache_key")


def write_once(rows: DataFrame, path: str, force: bool = False) -> None:
    """Writes JSON lines; refuses to replace what is there unless forced."""
    if path_exists(rows.sparkSession, path) and not force:
        raise RefusedError(f"{path} exists")
    rows.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)  # one row


def percent(x: float | None) -> str:
    return "--" if x is None else f"{x:.1%}"


def markdown(report: DataFrame, title: str) -> str:
    """A small report (tens of rows at most, by its making) as a Markdown table."""
    rows = report.limit(200).collect()
    head = report.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    for r in rows:
        lines.append("| " + " | ".join(percent(v) if isinstance(v, float) else "--" if v is None else str(v) for v in r) + " |")
    return "\n".join(lines)


def field_report(rates: DataFrame, title: str, notes: dict[str, str] | None = None) -> str:
    """A table of fields (field, n, scorable, hits, accuracy), all fields last, with footnotes and what the run was."""
    rows = sorted(rates.limit(200).collect(), key=lambda r: (r["field"] == "ALL", r["field"]))
    lines = [f"# {title}", "", "| field | filings | scorable | right | accuracy |", "| --- | ---: | ---: | ---: | ---: |"]
    lines += [f"| {r['field']} | {r['n']} | {r['scorable']} | {r['hits']} | {percent(r['accuracy'])} |" for r in rows]
    lines += ["", "Right: exact or close. Rows without a gold figure don't count as scorable; a figure off by a power of ten is wrong."]
    return "\n".join(lines + [f"{k}: {v}" for k, v in (notes or {}).items()])


def refresh_report(counters: dict, fields: tuple[str, ...], dry_run: bool = False) -> str:
    """What a refresh did, from facts.refresh_counters()."""
    lines = [f"{counters['changed']} of {counters['n']} filings {'would change' if dry_run else 'changed'}; {counters['failed']} could not be refreshed."]
    return "\n".join(lines + [f"  {f}: {counters[f'changed_{f}']}" for f in fields if counters[f"changed_{f}"]])


def build_report(counters: dict, companies: dict[str, int]) -> str:
    """What a build made, from dataset.build_counters() and the number of companies of each split."""
    share = lambda hits, n: f"{hits}/{n} ({percent(hits / n if n else None)})"
    lines = [f"Filings: {counters['n']}   without labels: {counters['failed']}", "", "Splits:"]
    lines += [f"  {s}: {counters[f'split_{s}']} examples, {companies.get(s, 0)} companies" for s in SPLITS]
    lines += ["", "Figures that the excerpt shows:"]
    lines += [f"  {f}: {share(counters[f'grounded_{f}'], counters[f'figures_{f}'])}" for f in SCORED_FIELDS if counters[f"figures_{f}"]] or ["  no figures"]
    lines += ["", f"Risks by reference only: {counters['by_reference']} filings"]
    if counters["mean_risks"] is not None:
        lines += [f"Risks of a filing: {counters['least_risks']} to {counters['most_risks']}, {counters['mean_risks']:.1f} on average", "", "Categories:"]
        found = sorted(((-counters[f"category_{c}"], c) for c in RISK_CATEGORIES if counters[f"category_{c}"]))
        lines += [f"  {c}: {-n}" for n, c in found]
    return "\n".join(lines)


def report_json(report: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in report.limit(200).collect()], default=str)
