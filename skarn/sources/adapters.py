"""What plugs in from outside: labelers, predictors, tokenizers, and retries of calls.

A call is made for each row in a worker; its outcome is a status column, so one row's failure skips
that row, and only an error of the permanent kind ends the job.
"""

from __future__ import annotations

import json
import threading
import time
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skarn.schemas import RISK_CATEGORIES, TARGET_DDL


class RowError(Exception):
    """This row can't be served: it is skipped."""


class UnavailableError(Exception):
    """The service can't be used at all: the job ends."""


#: How a prompt is made, part of a run's identity: as the model was trained, or with the schema told.
PROMPT_MODES = ("trained", "schema")


def schema_prompt() -> str:
    """What the answer must look like, for a model that wasn't trained on it: field names and their kinds."""
    target = T._parse_datatype_string(TARGET_DDL).jsonValue()
    return "Answer with one JSON object and nothing else. Its fields:\n" + json.dumps(_kinds(target), indent=1) + f"\ncategory is one of: {', '.join(RISK_CATEGORIES)}."


def _kinds(kind):
    if isinstance(kind, str):
        return {"double": "number or null", "integer": "whole number or null"}.get(kind, kind)
    if kind["type"] == "array":
        return [_kinds(kind["elementType"])]
    return {f["name"]: _kinds(f["type"]) for f in kind["fields"]}


def system_prompt(mode: str, trained: str) -> str:
    """The system turn of a prompt mode: the trained one, followed by the schema in mode schema."""
    if mode not in PROMPT_MODES:
        raise ValueError(f"the prompt mode is one of {PROMPT_MODES}")
    return trained if mode == "trained" else f"{trained}\n{schema_prompt()}"


class Predictor(Protocol):
    name: str
    system_prompt: str

    def predict(self, excerpt: str) -> dict:
        """raw, stop_reason, input_tokens, output_tokens."""


def with_retry(call: Callable, tries: int = 3, first_wait: float = 1.5, permanent: tuple[type[Exception], ...] = (), sleep=time.sleep):
    """call's result; waits first_wait * 2^k after the k-th failure. Permanent errors aren't tried again."""
    for k in range(tries):
        try:
            return call()
        except permanent:
            raise
        except Exception:
            if k == tries - 1:
                raise
            sleep(first_wait * 2**k)


class BusyError(Exception):
    """The service wants to be left alone for a while: wait seconds."""

    def __init__(self, wait: float = 1.0):
        super().__init__(f"busy for {wait} s")
        self.wait = wait


class Pace:
    """Calls at even distances: per_second at most, by whichever threads; None doesn't wait."""

    def __init__(self, per_second: float | None, clock=time.monotonic, sleep=time.sleep):
        self.gap = 1.0 / per_second if per_second else 0.0
        self.next, self.lock, self.clock, self.sleep = 0.0, threading.Lock(), clock, sleep

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(self.next, self.clock())
            self.next = at + self.gap
        if (left := at - self.clock()) > 0:
            self.sleep(left)

    def pause(self, seconds: float) -> None:
        """Nobody calls for so long."""
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


def in_order(call: Callable, items, concurrent: int, pace: Pace, tries: int = 3, first_wait: float = 1.5, sleep=time.sleep):
    """(item, result or RowError) of each item in order, with as many calls at once as concurrent allows.

    Each try waits for its turn by pace. RowError isn't tried again; after BusyError everybody pauses for the
    time it names; UnavailableError ends it at once: no further call is begun. Anything else is tried again
    after first_wait * 2^k seconds, and ends it if it fails every time.
    """
    stopped = threading.Event()

    def once(item):
        for k in range(tries):
            if stopped.is_set():
                raise UnavailableError("stopped")
            pace.wait()
            try:
                return call(item)
            except RowError as e:
                return e
            except UnavailableError:
                stopped.set()
                raise
            except BusyError as e:
                if k == tries - 1:
                    raise
                pace.pause(e.wait)
                if not pace.gap:
                    sleep(e.wait)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(first_wait * 2**k)

    with ThreadPoolExecutor(concurrent) as pool:
        waiting: deque = deque()
        try:
            for item in items:
                waiting.append((item, pool.submit(once, item)))
                # What is under way has a bound, however many items there are.
                while len(waiting) >= 2 * concurrent:
                    done, future = waiting.popleft()
                    yield done, future.result()
            while waiting:
                done, future = waiting.popleft()
                yield done, future.result()
        finally:
            stopped.set()
            for _, future in waiting:
                future.cancel()


def _calls(rows: DataFrame, make: Callable, of: str, key: str, text: str, schema: str, outcome: Callable, tries: int, first_wait: float, concurrent: int, per_second: float | None, tasks: int | None) -> DataFrame:
    """A call for each row: outcome(result or RowError) gives the columns after key.

    With per_second, rows are dealt to so many tasks (1 if tasks is not given) and each has its share of the
    rate, so together they never exceed it, whatever number of them runs at once.
    """
    if per_second and not tasks:
        tasks = 1
    share = per_second / tasks if per_second else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        served, pace = make(), Pace(share)
        ask = getattr(served, of) if of else served
        for frame in frames:
            found = in_order(lambda kt: ask(kt[1]), zip(frame[key], frame[text]), concurrent, pace, tries, first_wait)
            yield outcome([(k, result) for (k, _), result in found])

    dealt = rows.select(key, text)
    return (dealt.repartition(tasks) if tasks else dealt).mapInPandas(run, schema)


def predict(rows: DataFrame, make: Callable[[], Predictor], key: str = "accession_no", text: str = "excerpt", tries: int = 3, first_wait: float = 1.5, concurrent: int = 1, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """(key, raw, stop_reason, input_tokens, output_tokens, status): an answer for each row, '' if it failed.

    Calls are tried again (see in_order()) unless the row or the service is said not to be served; what
    fails every time ends the job. A task has concurrent calls under way, and per_second bounds the calls of
    all tasks together (see _calls()).
    """

    def outcome(found):
        out = [(k, "", None, None, None, "failed") if isinstance(p, RowError) else (k, p["raw"], p.get("stop_reason"), p.get("input_tokens"), p.get("output_tokens"), "generated") for k, p in found]
        result = pd.DataFrame(out, columns=[key, "raw", "stop_reason", "input_tokens", "output_tokens", "status"])
        return result.astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    schema = f"{key} string, raw string, stop_reason string, input_tokens long, output_tokens long, status string"
    return _calls(rows, make, "predict", key, text, schema, outcome, tries, first_wait, concurrent, per_second, tasks)


def label(rows: DataFrame, make: Callable[[], Callable[[str], list[dict]]], key: str = "accession_no", text: str = "risk_text", tries: int = 3, first_wait: float = 1.5, concurrent: int = 1, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """(key, risks, status): labels of each row's text; a row whose labeler fails has null risks. Calls are made as in predict()."""

    def outcome(found):
        return pd.DataFrame([(k, None, "failed") if isinstance(p, RowError) else (k, p, "generated") for k, p in found], columns=[key, "risks", "status"])

    schema = f"{key} string, risks array<struct<title:string,category:string,summary:string>>, status string"
    return _calls(rows, make, "", key, text, schema, outcome, tries, first_wait, concurrent, per_second, tasks)


def token_ids(rows: DataFrame, make: Callable[[], Callable[[str], list[int]]], text: str, into: str = "ids", most: int = 1_000_000) -> DataFrame:
    """rows with the ids that a tokenizer gives text; null text has none. A task holds the ids of one text and up to most more."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            texts, start, ids, ends = batch.column(text), 0, array("i"), [0]
            for i in range(len(texts)):
                ids.extend(tokenizer(t) if (t := texts[i].as_py()) is not None else ())
                ends.append(len(ids))
                # Ids are packed, and go on before they are many: texts of a batch may be long.
                if len(ids) >= most or i + 1 == len(texts):
                    packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, i + 1 - start).columns, packed], [*batch.schema.names, into])
                    start, ids, ends = i + 1, array("i"), [0]

    return rows.mapInArrow(run, schema)
