import json

import pytest
from pyspark.sql import functions as F

from skarn.operators import dataset
from skarn.sources import adapters, readers, sinks
from skarn.streaming import ingest

FACTS = {"revenue": 1000.0, "net_income": 100.0, "total_assets": 5000.0, "eps_diluted": None, "shares_outstanding_diluted": None, "unit": "USD"}


def filing(acc, **more):
    base = {"ticker": "TEST", "cik": 1234, "company_name": "Test Co", "accession_no": acc, "form_type": "10-K", "fiscal_year": 2025, "financials": FACTS, "income_statement": "Net sales: 1,000", "balance_sheet": "Total assets: 5,000", "parse_warnings": []}
    return base | more


@pytest.fixture
def raw(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.json").write_text(json.dumps(filing("a"), indent=1))
    (d / "b.json").write_text(json.dumps(filing("b", balance_sheet=None, risk_factors="incorporated by reference")))
    (d / "bad.json").write_text("{nope")
    (d / "part.json").write_text(json.dumps({"ticker": "X"}))
    return d


def test_corrupt_files_are_set_apart(spark, raw):
    good, bad = readers.read_filings(spark, str(raw))
    assert sorted(r["accession_no"] for r in good.collect()) == ["a", "b"] and bad.count() == 2


def test_strict_reads_end(spark, raw):
    with pytest.raises(Exception):
        readers.read_filings(spark, str(raw), strict=True)[0].collect()


def test_examples_drop_what_is_not_grounded(spark, raw):
    good, _ = readers.read_filings(spark, str(raw))
    labels = spark.createDataFrame([("a", [("t", "legal", "s")]), ("b", [])], "accession_no string, risks array<struct<title:string,category:string,summary:string>>")
    got = {r["accession_no"]: r for r in dataset.build_examples(good, labels).collect()}
    a, b = (json.loads(got[k].messages[2].content) for k in "ab")
    assert a["financials"]["total_assets"] == 5000.0 and b["financials"]["total_assets"] is None and b["financials"]["revenue"] == 1000.0
    assert got["b"].risk_factors_by_reference and not got["a"].risk_factors_by_reference and a["risk_factors"][0]["category"] == "legal"


def test_splits_that_are_missing_are_skipped(spark, tmp_path):
    (tmp_path / "val.jsonl").write_text(json.dumps({"ticker": "T", "accession_no": "a", "risk_factors_by_reference": False, "messages": [{"role": "assistant", "content": json.dumps({"risk_factors": [{"title": "t", "category": "legal", "summary": "s"}]})}]}) + "\n\n")
    rows = readers.read_splits(spark, str(tmp_path))
    assert [(r["split"], r["accession_no"]) for r in rows.collect()] == [("val", "a")]
    assert readers.labeled_filings(rows).first()["n_risks"] == 1
    assert readers.read_splits(spark, str(tmp_path / "none")).count() == 0


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    path = str(tmp_path / "t")
    assert sinks.append_new(rows, path, "k").count() in (0, 2)
    sinks.append_new(rows, path, "k")
    assert spark.read.parquet(path).count() == 2


def test_failures_keep_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.staged_overwrite(spark.range(3), path)
    with pytest.raises(sinks.RefusedError):
        sinks.staged_overwrite(spark.range(9), path, failures=1)
    assert spark.read.parquet(path).count() == 3
    sinks.staged_overwrite(spark.range(9), path, failures=1, allow_partial=True)
    assert spark.read.parquet(path).count() == 9


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "sheet")
    sinks.write_once(spark.range(1), path)
    with pytest.raises(sinks.RefusedError):
        sinks.write_once(spark.range(1), path)
    sinks.write_once(spark.range(2), path, force=True)


def test_reports(spark):
    r = spark.createDataFrame([("x", 0.5, None)], "field string, rate double, other double")
    assert "| x | 50.0% | -- |" in sinks.markdown(r, "R") and json.loads(sinks.report_json(r))[0]["rate"] == 0.5


class Echo:
    name, system_prompt = "echo", ""

    def predict(self, text):
        if text == "fail":
            raise adapters.RowError
        if text == "down":
            raise adapters.UnavailableError
        return {"raw": text, "input_tokens": 1, "output_tokens": 2}


def test_predictors(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "fail")], "accession_no string, excerpt string")
    got = {r["accession_no"]: r for r in adapters.predict(rows, _echo).collect()}
    assert got["a"].raw == "x" and got["b"].status == "failed" and got["b"].raw == ""
    with pytest.raises(Exception):
        adapters.predict(spark.createDataFrame([("a", "down")], "accession_no string, excerpt string"), _echo).collect()


def _echo():
    from skarn.sources import adapters as a

    class Local:
        def predict(self, text):
            if text == "fail":
                raise a.RowError
            if text == "down":
                raise a.UnavailableError
            return {"raw": text, "input_tokens": 1, "output_tokens": 2}

    return Local()


def test_tokenizers(spark):
    def make():
        return lambda t: [ord(c) for c in t]

    assert [r["ids"] for r in adapters.token_ids(spark.createDataFrame([("ab",), (None,)], "t string"), make, "t").collect()] == [[97, 98], []]


def test_ids_of_a_batch_go_on_before_they_are_many(spark):
    sizes = [0, 5, 3_000, 70_000, 1, 0, 2_500, 9]
    rows = [(i, None if n == 9 else chr(960 + i) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    got = adapters.token_ids(df, lambda: lambda t: [ord(c) for c in t], "t", most=2_000)
    assert [(r["k"], r["t"], r["ids"]) for r in got.collect()] == [(i, t, [ord(c) for c in t or ""]) for i, t in rows]


def test_memory_of_a_task_does_not_grow_with_its_ids(spark):
    rows = spark.range(400, numPartitions=1).select(F.repeat(F.lit("ab"), 50_000).alias("t"))

    def make():
        import resource

        # Its own growth, told in place of ids: 40 million of them would take 320 MB as a list.
        begun = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return lambda t: [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - begun, *map(ord, t)]

    most = adapters.token_ids(rows, make, "t").select(F.col("ids")[0].alias("kb"), F.size("ids").alias("n")).agg(F.max("kb"), F.sum("n")).first()
    assert most[1] == 400 * 100_001 and most[0] < 150_000


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert adapters.with_retry(call, sleep=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(KeyError):
        adapters.with_retry(lambda: {}["x"], permanent=(KeyError,), sleep=waits.append)


def test_caches(spark):
    rows = spark.createDataFrame([("m/x", "a:1", "p", "t"), ("m/x", "a:2", "p", "u")], "model string, acc string, prompt string, text string")
    keyed = readers.cache_keys(rows, "model", "acc", "prompt", "text")
    cache = keyed.limit(1).select("cache_key", F.lit("old").alias("raw"))
    assert sorted(r["cache_hit"] for r in readers.read_through(keyed, cache).collect()) == [False, True]


def test_stream(spark, raw, tmp_path):
    (raw / "bad.json").unlink()
    for _ in range(2):
        ingest.ingest(spark, str(raw), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        (raw / "again.json").write_text(json.dumps(filing("a")))
    assert sorted(r["accession_no"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
