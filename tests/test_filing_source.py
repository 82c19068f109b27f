"""The filing source asks the service for no more than the query needs; calls keep their pace."""

import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn.sources import adapters
from skarn.sources.filing_source import read_service, stream_service

SERVICE = "tests.test_filing_source:make"
COMPANIES = ("A", "B", "C")


class Broken(dict):
    def __getitem__(self, name):
        if name == "risk_factors":
            raise ValueError("no such part")
        return super().__getitem__(name)


class Service:
    """Four filings a company; says in a file what it was asked."""

    def __init__(self, options):
        self.log, self.size = options["log"], int(options.get("size", 12))

    def said(self, *what):
        with open(self.log, "a") as f:
            f.write(json.dumps(what) + "\n")

    def all(self, company):
        return [{"ticker": company, "accession_no": f"{company}{k}", "form_type": "10-K/A" if k == 3 else "8-K" if k == 2 else "10-K", "filing_date": f"202{k}-01-01"} for k in range(4)]

    def listing(self, company, forms):
        self.said("listing", company, forms)
        if company == "lost":
            raise adapters.RowError("unknown company")
        return self.all(company)

    def fetch(self, company, key):
        self.said("fetch", company, key)
        if key == "B0":
            raise adapters.RowError("gone")
        return Broken(next(x for x in self.all(company) if x["accession_no"] == key), cik=1, company_name=company, business="b", financials={"revenue": 1.0})

    def end(self):
        return int(Path(self.log + ".size").read_text()) if Path(self.log + ".size").exists() else self.size

    def feed(self, start, end):
        return [x for c in COMPANIES for x in self.all(c)][start:end]


def make(options):
    return Service(options)


@pytest.fixture
def asked(tmp_path):
    path = tmp_path / "asked"

    def read():
        return sorted(map(tuple, (json.loads(line) for line in path.read_text().splitlines())), key=repr) if path.exists() else []

    read.path = str(path)
    return read


def keys(df):
    return sorted(r["accession_no"] for r in df.select("accession_no").collect())


def test_everything_with_failures_told(spark, asked):
    rows = read_service(spark, SERVICE, [*COMPANIES, "lost"], log=asked.path, firstWait=0)
    assert rows.rdd.getNumPartitions() == 4
    got = rows.collect()
    bad = {r["ticker"]: r["reason"] for r in got if r["reason"]}
    assert set(bad) == {"B", "lost"} and "B0" in bad["B"] and "unknown company" in bad["lost"]
    good = [r for r in got if not r["reason"]]
    assert len(good) == 11 and all(r["risk_factors"] is None and r["parse_warnings"] == ["risk_factors_failed: no such part"] and r["business"] == "b" and r["financials"]["revenue"] == 1.0 for r in good)


def test_companies_and_forms_that_are_pruned_are_never_asked_for(spark, asked):
    rows = read_service(spark, SERVICE, COMPANIES, log=asked.path)
    assert keys(rows.where("ticker = 'A' and form_type = '8-K'")) == ["A2"]
    assert asked() == [("fetch", "A", "A2"), ("listing", "A", ["8-K"])]


def test_accession_numbers_are_pushed_down(spark, asked):
    rows = read_service(spark, SERVICE, COMPANIES, log=asked.path)
    assert keys(rows.where(F.col("accession_no").isin("A1", "C3"))) == ["A1", "C3"]
    assert [x for x in asked() if x[0] == "fetch"] == [("fetch", "A", "A1"), ("fetch", "C", "C3")]


def test_the_newest_of_a_form(spark, asked):
    rows = read_service(spark, SERVICE, ("A", "C"), forms=["10-K"], newest=1, log=asked.path)
    assert keys(rows) == ["A1", "C1"] and len([x for x in asked() if x[0] == "fetch"]) == 2
    assert keys(rows.where("form_type = '8-K'")) == [] and len([x for x in asked() if x[0] == "fetch"]) == 2
    assert keys(read_service(spark, SERVICE, ("A",), newest=2, log=asked.path).where("form_type = '8-K'")) == ["A2"]


def test_other_filters_stay_with_spark(spark, asked):
    rows = read_service(spark, SERVICE, COMPANIES, log=asked.path)
    assert keys(rows.where("filing_date > '2021-06-01' and ticker <> 'C' and accession_no = 'A3'")) == ["A3"]


def test_a_stream_goes_on_at_its_offset(spark, asked, tmp_path):
    def run(size):
        Path(asked.path + ".size").write_text(str(size))
        rows = stream_service(spark, SERVICE, forms=["10-K"], log=asked.path).where("reason is null")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "t")).trigger(availableNow=True).start().awaitTermination()
        return keys(spark.read.parquet(str(tmp_path / "t")))

    assert run(5) == ["A0", "A1"]
    assert run(9) == ["A0", "A1", "B1", "C0"]
    assert run(9) == ["A0", "A1", "B1", "C0"]
    fetched = [x[2] for x in asked() if x[0] == "fetch"]
    assert sorted(fetched) == ["A0", "A1", "B0", "B1", "C0"]


def quiet(options):
    return Service({"log": "/dev/null"})


def test_the_command_asks_a_service(spark, tmp_path):
    from skarn import __main__ as commands
    from skarn.sources import versions

    def run():
        a = commands.parser().parse_args(["ingest", "--service", "tests.test_filing_source:quiet", "--tickers", "A,B,C", "--newest", "2", "--out", str(tmp_path / "t")])
        return a.run(spark, a)

    assert run() == "5 new filings, 5 filings at " + str(tmp_path / "t") + "; 1 could not be read"
    assert run().startswith("0 new filings, 5 filings") and keys(versions.read(spark, str(tmp_path / "t"))) == ["A0", "A1", "B1", "C0", "C1"]
    with pytest.raises(ValueError):
        a = commands.parser().parse_args(["ingest", "--out", "x"])
        a.run(spark, a)


class Slow:
    def __init__(self, log):
        self.log = log

    def predict(self, text):
        with open(self.log, "a") as f:
            f.write(f"{time.time()}\n")
        time.sleep(0.05)
        if text == "odd":
            raise adapters.RowError
        return {"raw": text}


def test_a_service_is_kept_busy_and_never_hurried(spark, tmp_path):
    log = str(tmp_path / "calls")
    rows = spark.createDataFrame([(str(i), "odd" if i % 10 == 3 else f"t{i}") for i in range(80)], "accession_no string, excerpt string")
    got = adapters.predict(rows, lambda: Slow(log), concurrent=4, per_second=20, tasks=2).collect()
    assert {(r["accession_no"], r["raw"], r["status"]) for r in got} == {(str(i), "" if i % 10 == 3 else f"t{i}", "failed" if i % 10 == 3 else "generated") for i in range(80)}
    at = sorted(map(float, Path(log).read_text().split()))
    most = max(sum(t <= x < t + 1 for x in at) for t in at)
    assert len(at) == 80 and most <= 22, most
    assert at[-1] - at[0] < 80 / 20 * 1.6 + 1


def test_order_is_kept_and_calls_run_at_once():
    running, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01 * (x % 3))
        with lock:
            running[0] -= 1
        return -x

    assert list(adapters.in_order(call, range(30), 5, adapters.Pace(None))) == [(x, -x) for x in range(30)] and 1 < most[0] <= 5


def test_errors_by_class():
    calls, waits = [], []

    def call(x):
        calls.append(x)
        if x == "row":
            raise adapters.RowError
        if x == "busy" and calls.count(x) < 2:
            raise adapters.BusyError(7)
        if x == "shaky" and calls.count(x) < 3:
            raise OSError
        return x

    found = list(adapters.in_order(call, ["row", "busy", "shaky"], 1, adapters.Pace(None), 3, 1.0, waits.append))
    assert isinstance(found[0][1], adapters.RowError) and found[1:] == [("busy", "busy"), ("shaky", "shaky")] and waits == [7, 1.0, 2.0]

    def down(x):
        calls.append(x)
        raise adapters.UnavailableError

    calls.clear()
    with pytest.raises(adapters.UnavailableError):
        list(adapters.in_order(down, range(1000), 1, adapters.Pace(None)))
    assert len(calls) == 1


def test_a_pause_holds_everybody():
    now, slept = [0.0], []
    pace = adapters.Pace(10, lambda: now[0], slept.append)
    pace.wait()
    pace.pause(5)
    pace.wait()
    pace.wait()
    assert slept == pytest.approx([5, 5.1])
