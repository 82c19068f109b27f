"""Filings of a service as a Spark data source: a batch and a stream reader that ask for no more than a query needs.

    read_service(spark, "package.module:function", tickers, newest=1).where("form_type = '10-K'")

A partition is one company. Filters on ticker, form_type and accession_no (equal, or one of a list) are
pushed down: other companies get no partition, and the service is asked for no filing that can't be in the
result. Rows have reason as a last column: null, or why the filings of a company, or one of them,
couldn't be had; an attribute that can't be read is null and leaves a warning in its row.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from skarn.schemas import FILING_DDL
from skarn.session import ship_code

from .adapters import Pace, RowError, UnavailableError, with_retry

NAME = "skarn-filings"
PUSHED = ("ticker", "form_type", "accession_no")
#: Attributes that a filing can't do without.
KEYS = ("ticker", "accession_no", "form_type")


class FilingService(Protocol):
    """What a service must answer; made in each task by a function of the options."""

    def listing(self, company: str, forms: list[str] | None) -> Iterable[Mapping]:
        """What is known of a company's filings without reading them: accession_no, form_type, filing_date."""

    def fetch(self, company: str, accession_no: str) -> Mapping:
        """A filing by attribute; looking an attribute up may raise."""

    def end(self) -> int:
        """For streams: how many filings of all companies there have been."""

    def feed(self, start: int, end: int) -> Iterable[Mapping]:
        """For streams: (ticker, accession_no, form_type) of those from the start-th on, up to the end-th."""


@dataclass
class CompanyPartition(InputPartition):
    """A company, and, in a stream, the filings of it that are new."""

    company: str
    accessions: list[str] | None = None


def _service(options: dict):
    module, _, function = options["service"].partition(":")
    return getattr(importlib.import_module(module), function)(options)


class _Reading:
    """What both readers share: options, what was pushed down, and turning filings into rows."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.only = dict(options), schema, {}
        self.tickers = json.loads(options.get("tickers", "null"))
        self.forms = json.loads(options.get("forms", "null"))
        self.newest = int(options["newest"]) if options.get("newest") else None

    def allows(self, name: str, value) -> bool:
        return name not in self.only or value in self.only[name]

    def call(self, ask):
        wait, tries = float(self.options.get("firstwait", 1.5)), int(self.options.get("tries", 3))
        return with_retry(ask, tries, wait, (RowError, UnavailableError))

    def rows(self, company: str, accessions: Iterable[str], service, pace: Pace) -> Iterator[tuple]:
        for key in accessions:
            try:
                pace.wait()
                filing = self.call(lambda key=key: service.fetch(company, key))
                yield self.row(filing, company)
            except UnavailableError:
                raise
            except Exception as e:  # noqa: BLE001
                yield self.failure(company, f"{key}: {type(e).__name__}: {e}")

    def row(self, filing: Mapping, company: str) -> tuple:
        warnings, out = [], {}
        for field in self.schema.fields:
            if field.name in ("parse_warnings", "reason"):
                continue
            try:
                out[field.name] = filing[field.name]
            except KeyError:
                out[field.name] = None
            except Exception as e:  # noqa: BLE001
                if field.name in KEYS:
                    raise
                out[field.name] = None
                warnings.append(f"{field.name}_failed: {e}")
        out["ticker"] = company
        try:
            told = list(filing["parse_warnings"] or [])
        except KeyError:
            told = []
        out |= {"parse_warnings": told + warnings, "reason": None}
        return tuple(out[f.name] for f in self.schema.fields)

    def failure(self, company: str, reason: str) -> tuple:
        return tuple({"ticker": company, "reason": reason}.get(f.name) for f in self.schema.fields)


class FilingReader(_Reading, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if name not in PUSHED:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = values & self.only.get(name, values)
            # A row that tells of a failure has no form, so such filters leave it out, and Spark needn't ask again.

    def partitions(self):
        return [CompanyPartition(t) for t in self.tickers if self.allows("ticker", t)]

    def read(self, partition):
        service, pace = _service(self.options), Pace(float(self.options["persecond"]) if self.options.get("persecond") else None)
        company, forms = partition.company, self.forms
        if self.newest is None and "form_type" in self.only:
            forms = sorted(self.only["form_type"] & set(forms)) if forms else sorted(self.only["form_type"])
        told = not any(n in self.only for n in ("form_type", "accession_no"))
        if forms == []:
            return
        try:
            pace.wait()
            listed = self.call(lambda: list(service.listing(company, forms)))
        except UnavailableError:
            raise
        except Exception as e:  # noqa: BLE001
            if told:
                yield self.failure(company, f"listing: {type(e).__name__}: {e}")
            return
        listed = [x for x in listed if forms is None or x["form_type"] in forms]
        if self.newest is not None:
            listed = sorted(listed, key=lambda x: (x["filing_date"], x["accession_no"]), reverse=True)[: self.newest]
        wanted = [x["accession_no"] for x in listed if self.allows("form_type", x["form_type"]) and self.allows("accession_no", x["accession_no"])]
        for row in self.rows(company, wanted, service, pace):
            if told or row[-1] is None:
                yield row


class FilingStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are places in the service's feed, so a stream that starts again goes on where its checkpoint ends."""

    def initialOffset(self):
        return {"at": int(self.options.get("start", 0))}

    def latestOffset(self):
        return {"at": self.call(_service(self.options).end)}

    def partitions(self, start, end):
        new: dict[str, list[str]] = {}
        for x in self.call(lambda: list(_service(self.options).feed(start["at"], end["at"]))):
            if (self.tickers is None or x["ticker"] in self.tickers) and (self.forms is None or x["form_type"] in self.forms):
                new.setdefault(x["ticker"], []).append(x["accession_no"])
        return [CompanyPartition(t, keys) for t, keys in new.items()]

    def read(self, partition):
        pace = Pace(float(self.options["persecond"]) if self.options.get("persecond") else None)
        yield from self.rows(partition.company, partition.accessions, _service(self.options), pace)


class FilingSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return FILING_DDL + ", reason string"

    def reader(self, schema):
        return FilingReader(self.options, schema)

    def streamReader(self, schema):
        return FilingStreamReader(self.options, schema)


def _options(service: str, tickers, forms, newest, more: dict) -> dict[str, str]:
    out = {"service": service, **{k: str(v) for k, v in more.items() if v is not None}}
    out |= {k: json.dumps(list(v)) for k, v in (("tickers", tickers), ("forms", forms)) if v is not None}
    return out | ({"newest": str(newest)} if newest is not None else {})


def register(spark: SparkSession) -> None:
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingSource)


def read_service(spark: SparkSession, service: str, tickers: list[str], forms: list[str] | None = None, newest: int | None = None, **more) -> DataFrame:
    """Filings of companies, with reason: of all forms or some, all or the newest few of each company.

    service names a function (package.module:function) of the options that makes a FilingService. more are
    options: perSecond (calls a second of one company's task), tries, firstWait, and what the service reads.
    """
    register(spark)
    return spark.read.format(NAME).options(**_options(service, tickers, forms, newest, more)).load()


def stream_service(spark: SparkSession, service: str, tickers: list[str] | None = None, forms: list[str] | None = None, **more) -> DataFrame:
    """New filings of the service's feed as a stream; more may have start, the place in the feed to begin at."""
    register(spark)
    return spark.readStream.format(NAME).options(**_options(service, tickers, forms, None, more)).load()
