"""Commands, settings and what guards writes."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn import __main__ as commands
from skarn.config import load_config
from skarn.functions.validate import validate_target
from skarn.operators import encode, facts, scoring
from skarn.schemas import AUDIT_FILING_DDL, AUDIT_RISK_DDL
from skarn.sources import adapters, cache, readers, sinks, versions
from tests.test_sources import filing

ANSWER = {"company": "Test Co", "ticker": "T", "form_type": "10-K", "fiscal_year": 2025, "financials": {"revenue": 1000.0}, "risk_factors": []}


def run(*arguments):
    a = commands.parser().parse_args([str(x) for x in arguments])
    from pyspark.sql import SparkSession

    return a.run(SparkSession.active(), a)


def raw_filings(folder, n, **more):
    folder.mkdir()
    for k in range(n):
        (folder / f"{k}.json").write_text(json.dumps(filing(f"a{k}", ticker=f"T{k}", risk_factors="Long enough risks", **more)))


def test_from_raw_filings_to_every_report(spark, tmp_path):
    raw_filings(tmp_path / "raw", 12)
    (tmp_path / "raw" / "bad.json").write_text("{nope")
    table = tmp_path / "filings"
    assert run("ingest", "--raw", tmp_path / "raw", "--out", table).startswith("12 new filings, 12 filings")
    assert run("ingest", "--raw", tmp_path / "raw", "--out", table).startswith("0 new filings, 12 filings")
    fresh = spark.createDataFrame([(f"a{k}", 2000.0, 100.0, 5000.0, None, ["revenue_from_metrics_fallback"]) for k in range(11)], "accession_no string, revenue double, net_income double, total_assets double, eps_diluted double, fact_warnings array<string>")
    fresh.write.parquet(str(tmp_path / "fresh"))
    with pytest.raises(sinks.RefusedError):
        run("refresh", "--filings", table, "--facts", tmp_path / "fresh")
    assert versions.read(spark, str(table)).where("financials.revenue = 2000").count() == 0
    said = "11 of 12 filings {}; 1 could not be refreshed.\n  revenue: 11"
    assert run("refresh", "--filings", table, "--facts", tmp_path / "fresh", "--dry-run") == said.format("would change")
    assert run("refresh", "--filings", table, "--facts", tmp_path / "fresh", "--allow-partial") == said.format("changed")
    got = {r["accession_no"]: r for r in versions.read(spark, str(table)).collect()}
    assert got["a0"].financials.revenue == 2000.0 and got["a11"].financials.revenue == 1000.0 and got["a0"].risk_factors == "Long enough risks"
    assert got["a0"].parse_warnings[-1] == "revenue_from_metrics_fallback" and got["a0"].financials.unit == "USD"

    risk = [("Title of a risk", "cyber", "what may happen"), ("Another one", "legal", "what else may happen")]
    kind = "accession_no string, risks array<struct<title:string,category:string,summary:string>>"
    spark.createDataFrame([(f"a{k}", risk[: k % 3] if k else None) for k in range(12)], kind).write.parquet(str(tmp_path / "labels"))
    sets = tmp_path / "sets"
    with pytest.raises(sinks.RefusedError):
        run("build", "--filings", table, "--labels", tmp_path / "labels", "--out", sets)
    assert versions.current(spark, str(sets)) is None
    report = run("build", "--filings", table, "--labels", tmp_path / "labels", "--out", sets, "--allow-partial")
    assert "Filings: 12   without labels: 1" in report and "Risks of a filing: 0 to 2, 1.1 on average" in report and "  cyber: 8" in report and "  legal: 4" in report
    rows = readers.read_splits(spark, str(sets)).collect()
    by = {s: [r["accession_no"] for r in rows if r["split"] == s] for s in ("train", "val", "test")}
    assert len(rows) == 11 and all(f"  {s}: {len(x)} examples, {len(x)} companies" in report for s, x in by.items())
    assert "  net_income: 0/12 (0.0%)" in report

    split = max(by, key=lambda s: len(by[s]))
    lines = [{"model": "m", "accession_no": k, "prompt_mode": "trained", "raw": json.dumps(ANSWER), "stop_reason": "end", "input_tokens": 1000, "output_tokens": 100} for k in by[split]]
    (tmp_path / "answers.json").write_text("\n".join(map(json.dumps, lines)))
    argv = ["evaluate", "--examples", sets, "--answers", tmp_path / "answers.json", "--split", split, "--out", tmp_path / "report", "--price-in", 2, "--price-out", 10]
    report = run(*argv)
    for part in ("| ALL |", "strict_valid_rate", "prompt mode: trained", "macro_match_f1", "micro_category_f1", "truncated", "cost_usd"):
        assert part in report, part
    cost = spark.read.json(str(tmp_path / "report" / "run")).first()
    assert cost["generated"] == len(lines) and abs(cost["cost_usd"] - len(lines) * (1000 * 2 + 100 * 10) / 1e6) < 1e-9
    assert spark.read.parquet(str(tmp_path / "report" / "filings")).count() == len(lines)
    lines[0] |= {"raw": "", "status": "failed"}
    (tmp_path / "answers.json").write_text("\n".join(map(json.dumps, lines)))
    with pytest.raises(commands.Failed, match="1 answers failed"):
        run(*argv)
    assert "Windows" in run("measure", "--examples", sets, "--windows", "10,100000")

    assert f"examples: {len(by[split])}" in run("encode", "--examples", sets, "--split", split, "--out", tmp_path / "batches", "--max-len", 4000, "--size", 4)
    assert {r["width"] % 8 for r in versions.read(spark, str(tmp_path / "batches")).select("width").collect()} == {0}
    assert f"rejected: {len(by[split])}" in run("encode", "--examples", sets, "--split", split, "--out", tmp_path / "batches", "--max-len", 8)


def test_a_sheet_is_drawn_reviewed_and_scored(spark, tmp_path):
    raw_filings(tmp_path / "raw", 40)
    run("ingest", "--raw", tmp_path / "raw", "--out", tmp_path / "filings")
    kind = "accession_no string, risks array<struct<title:string,category:string,summary:string>>"
    labels = lambda old: spark.createDataFrame([(f"a{k}", [(f"Risk {i} of {k}", "cyber" if i % 2 else "legal", "changed" if k < old else "s") for i in range(6)]) for k in range(40)], kind)
    for name, old in (("labels", 0), ("new", 40)):
        labels(old).write.parquet(str(tmp_path / name))
    sets, sheet = tmp_path / "sets", tmp_path / "sheet"
    run("build", "--filings", tmp_path / "filings", "--labels", tmp_path / "labels", "--out", sets)
    report = run("sample", "--examples", sets, "--out", sheet, "--filings", 10, "--per-filing", 3, "--test-filings", 0)
    rows = spark.read.schema(AUDIT_RISK_DDL).json(str(sheet / "risks")).collect()
    assert len(rows) == 30 and len({r["accession_no"] for r in rows}) == 10 and all(r["human_category"] is None for r in rows)
    assert "| 40 | 240 | 30 |" in report
    filings = spark.read.schema(AUDIT_FILING_DDL).json(str(sheet / "filings")).collect()
    assert {(r["n_teacher_risks"], r["n_sampled"], r["missed_risks"]) for r in filings} == {(6, 3, None)}
    with pytest.raises(sinks.RefusedError):
        run("sample", "--examples", sets, "--out", sheet)
    done = [r.asDict() | {"human_category": "cyber", "grounded": True, "summary_ok": i % 2 == 0, "note": ""} for i, r in enumerate(rows)]
    (tmp_path / "reviewed.json").write_text("\n".join(map(json.dumps, done)))
    (tmp_path / "read.json").write_text("\n".join(json.dumps(r.asDict() | {"missed_risks": 1}) for r in filings))
    report = run("audit", "--sheet", tmp_path / "reviewed.json", "--examples", sets, "--read", tmp_path / "read.json")
    assert "30 of 30 rows are reviewed and count; 0 are stale" in report and "Intervals, random" in report and "anchoring_gap" in report and "85.7%" in report
    run("build", "--filings", tmp_path / "filings", "--labels", tmp_path / "new", "--out", sets)
    assert "0 of 30 rows are reviewed and count; 30 are stale" in run("audit", "--sheet", tmp_path / "reviewed.json", "--examples", sets)


def test_newest_filings_and_a_broken_section(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k, (form, date) in enumerate([("10-K", "2023-01-01"), ("10-K", "2024-01-01"), ("10-K/A", "2025-01-01"), ("10-K", "2022-01-01")]):
        (raw / f"{k}.json").write_text(json.dumps(filing(f"a{k}", form_type=form, filing_date=date)))
    (raw / "odd.json").write_text(json.dumps(filing("odd", ticker="ODD", fiscal_year="in two years", filing_date="2020-01-01", period_of_report="2021-12-31")))
    assert run("ingest", "--raw", raw, "--out", tmp_path / "t", "--newest", 2).startswith("3 new filings")
    got = {r["accession_no"]: r for r in versions.read(spark, str(tmp_path / "t")).collect()}
    assert set(got) == {"a0", "a1", "odd"} and "fiscal_year_failed" in got["odd"].parse_warnings and got["odd"].ticker == "ODD" and got["odd"].fiscal_year == 2021
    assert "fiscal_year_failed" not in got["a0"].parse_warnings


LABELED = Path(tempfile.gettempdir()) / "skarn-test-labeled"


def labeler():
    def label(text):
        with LABELED.open("a") as f:
            f.write(text + "\n")
        if "unlucky" in text:
            raise adapters.RowError
        return [{"title": text[:5], "category": "legal", "summary": text}]

    return label


def test_labels_are_made_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw_filings(raw, 5)
    (raw / "x.json").write_text(json.dumps(filing("x", ticker="X", risk_factors="unlucky")))
    run("ingest", "--raw", raw, "--out", tmp_path / "t")
    argv = ["build", "--filings", tmp_path / "t", "--labeler", "tests.test_commands:labeler", "--cache", tmp_path / "cache", "--out", tmp_path / "sets"]
    with pytest.raises(sinks.RefusedError, match="1 rows failed"):
        run(*argv)
    assert cache.read_cache(spark, str(tmp_path / "cache")).count() == 5
    LABELED.unlink()
    assert "legal: 5" in run(*argv, "--allow-partial", "--concurrent", 2)
    assert cache.read_cache(spark, str(tmp_path / "cache")).count() == 5 and set(LABELED.read_text().split()) == {"unlucky"}


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"train": {"epochs": 1}, "name": "x"}')
    assert load_config(str(path), ["train.epochs=3", "train.rate=0.5", "new.table.key=text", "name=y"]) == {"train": {"epochs": 3, "rate": 0.5}, "name": "y", "new": {"table": {"key": "text"}}}
    for wrong in ("novalue", "name.deep=1", ".x=1"):
        with pytest.raises(ValueError):
            load_config(str(path), [wrong])


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("train:\n  epochs: 1\n")
    assert load_config(str(path), ["train.epochs=2"]) == {"train": {"epochs": 2}}


def test_lone_surrogates_are_invalid_not_fatal(spark):
    bad = json.dumps(ANSWER | {"company": "\ud800"})
    fine = json.dumps(ANSWER | {"company": "\U0001f600"})
    rows = spark.createDataFrame([(bad,), (fine,), (None,)], "raw string").select(validate_target(F.col("raw")).alias("p")).collect()
    assert [r["p"]["strict"] for r in rows] == [False, True, False] and rows[1]["p"]["target"]["company"] == "\U0001f600"


def test_both_searches_for_an_object_agree(spark):
    """functions.text.first_object() and the one of validation, on random answers."""
    import random

    from skarn.functions import text as tx
    from skarn.functions.validate import find_object

    rng = random.Random(5)
    bits = ["{", "}", '"', "\\", "a", "```", "```json\n", " ", '{"a": "}"}', ":", "\n"]
    raws = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", tx.first_object(F.col("raw")).alias("o")).collect()
    assert [(raws[r["i"]], r["o"]) for r in got] == [(raws[r["i"]], find_object(raws[r["i"]])) for r in got]


def test_a_failed_rename_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.staged_overwrite(spark.range(3), path)
    real = sinks._fs

    class Refusing:
        def __init__(self, fs):
            self.fs = fs

        def exists(self, p):
            return self.fs.exists(p)

        def rename(self, a, b):
            return False if ".stage-" in a.toString() else self.fs.rename(a, b)

        def delete(self, p, deep):
            return self.fs.delete(p, deep)

    monkeypatch.setattr(sinks, "_fs", lambda s, p: (Refusing(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(sinks.RefusedError):
        sinks.staged_overwrite(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_answers_must_match_examples(spark):
    examples = spark.createDataFrame([("a",), ("b",)], "accession_no string")
    answers = spark.createDataFrame([("a", "2"), ("a", "1"), ("c", "x")], "accession_no string, raw string")
    assert sorted(tuple(r) for r in scoring.alignment_faults(examples, answers).collect()) == [("a", "repeated"), ("b", "missing"), ("c", "orphan")]
    assert sorted(tuple(r) for r in scoring.join_predictions(examples, answers).collect()) == [("a", "1"), ("b", "")]
    with pytest.raises(ValueError):
        scoring.join_predictions(examples, answers, strict=True)


def test_retries_reach_predictions(spark):
    class Shaky:
        def __init__(self):
            self.calls = 0

        def predict(self, text):
            self.calls += 1
            if self.calls % 2:
                raise OSError("busy")
            return {"raw": text}

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "accession_no string, excerpt string")
    got = adapters.predict(rows, Shaky, first_wait=0.0).collect()
    assert sorted((r["accession_no"], r["raw"], r["status"]) for r in got) == [("a", "x", "generated"), ("b", "y", "generated")]


def test_prompt_modes_and_forms(spark):
    assert adapters.system_prompt("trained", "P") == "P" and '"revenue"' in adapters.system_prompt("schema", "P")
    with pytest.raises(ValueError):
        adapters.system_prompt("other", "P")
    rows = spark.createDataFrame([("T", "2024", "1", "10-K"), ("T", "2025", "2", "10-K/A"), ("T", "2023", "3", "10-K")], "ticker string, filing_date string, accession_no string, form_type string")
    assert [r["accession_no"] for r in facts.latest_filings(rows, "ticker", "filing_date", "accession_no", 1).collect()] == ["1"]
    assert encode.subset(rows, ["accession_no"], 2, ["t"]).count() == 2
