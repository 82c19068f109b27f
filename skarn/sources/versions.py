"""Versioned tables: data goes into folders of its own, and creating one small file makes it the table.

A version is a file <table>/_versions/<number>.json that names the folders it consists of. It is made
only if no file of that name is there, so of two writers that started from the same version one is
refused, and whoever reads sees one whole version: the one that the largest number names. Until the file
is there a write has changed nothing; folders that no version names are removed by vacuum().

Counters of the rows are taken in the pass that writes them, and a guard looks at them before the commit.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

POINTERS = "_versions"
#: Folders whose names start so aren't listed by those who read the table's path as a plain one.
DATA = "_data-"
_NAME = re.compile(r"(\d{12})\.json")


class RefusedError(RuntimeError):
    """A write that would lose something."""


@dataclass(frozen=True)
class Version:
    """A committed state of a table: its number, its folders (relative to the table), and the counters of the write that made it."""

    path: str
    number: int
    folders: tuple[str, ...]
    counters: dict = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [f"{self.path}/{f}" if f else self.path for f in self.folders]


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in milliseconds) of what is in a folder; none if it isn't there."""
    fs, p = filesystem(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a table, ascending."""
    return sorted(int(m[1]) for name, _ in _names(spark, f"{path}/{POINTERS}") if (m := _NAME.fullmatch(name)))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version of a table, or the one of a number.

    A plain table, which has no versions yet, is version 0 with the files of its path; where nothing is, None.
    """
    found = numbers(spark, path)
    if number is not None and number not in found:
        raise ValueError(f"the table at {path} has no version {number}")
    if not found:
        plain = [name for name, _ in _names(spark, path) if name[0] not in "._"]
        return Version(path, 0, ("",)) if plain else None
    number = found[-1] if number is None else number
    fs, p = filesystem(spark, f"{path}/{POINTERS}/{number:012d}.json")
    stream = fs.open(p)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(path, number, tuple(said["folders"]), said["counters"])


def read(spark: SparkSession, path: str, schema=None, kind: str = "parquet", number: int | None = None) -> DataFrame:
    """The table as its newest version has it, or the version of a number: all of its folders, and of no other version."""
    version = current(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(version.paths())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text; False if there is one of that name already.

    The text is written beside it first, so the file is never seen in part. On a local disk a hard link
    gives it its name, elsewhere a rename that doesn't overwrite; either fails if the name is taken. The
    file system has to do that in one step, as HDFS does.
    """
    jvm = spark._jvm
    fs, target = filesystem(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            place = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(place(fs.makeQualified(target).toUri()), place(fs.makeQualified(draft).toUri()))
        else:
            _rename_once(spark, fs.makeQualified(draft), fs.makeQualified(target))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def _rename_once(spark: SparkSession, source, target) -> None:
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(source, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))


def write(
    rows: DataFrame,
    path: str,
    base: Version | None,
    counters: dict[str, Column] | None = None,
    guard: Callable[[dict], str | None] | None = None,
    append: bool = False,
    kind: str = "parquet",
    partition_by: str | None = None,
    drop: tuple[str, ...] = (),
    where: Column | None = None,
) -> Version:
    """Commits rows as the version after base: in place of it, or, with append, beside what base has.

    base is what current() gave before rows were read. counters are aggregates over rows, taken in the one
    job that writes them: rows that fail where, and columns of drop, are there for them alone. guard gets
    their values and may refuse: what it returns is the reason. RefusedError if it does, or if another version came after base;
    the table is then as it was, and the new folder is gone.

    Counters are observed at the top of the plan, in the tasks that write, so a task that is run again counts once.
    """
    spark, folder = rows.sparkSession, f"{DATA}{uuid.uuid4().hex}"
    observed = Observation()
    out = rows.observe(observed, *[c.alias(name) for name, c in counters.items()]) if counters else rows
    out = out if where is None else out.where(where)
    writer = out.drop(*drop).write.format(kind)
    target = f"{path}/{folder}"
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).save(target)
        found = dict(observed.get) if counters else {}
        if guard and (reason := guard(found)):
            raise RefusedError(reason)
        number = (base.number if base else 0) + 1
        folders = (*(base.folders if base and append else ()), folder)
        if not create_once(spark, f"{path}/{POINTERS}/{number:012d}.json", json.dumps({"folders": folders, "counters": found}, default=str)):
            raise RefusedError(f"another writer made version {number} of the table at {path}; the rows were made from version {number - 1}")
    except BaseException:
        fs, p = filesystem(spark, target)
        fs.delete(p, True)
        raise
    return Version(path, number, folders, found)


def count(rows: DataFrame, counters: dict[str, Column]) -> dict:
    """The counters of write(), without writing anything."""
    observed = Observation()
    rows.observe(observed, *[c.alias(name) for name, c in counters.items()]).write.format("noop").mode("overwrite").save()
    return dict(observed.get)


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 7 * 86400.0) -> int:
    """Removes versions but the newest keep ones, and folders that none of these has; returns how many folders.

    Only folders unchanged for older_than seconds go, so a write that isn't committed yet and whoever still
    reads an old version aren't hurt. The files of a plain table that versions have replaced stay.
    """
    found = numbers(spark, path)
    kept = found[-keep:] if keep > 0 else found[-1:]
    named = {f for n in kept for f in current(spark, path, n).folders}
    before = (time.time() - older_than) * 1000
    gone = [name for name, changed in _names(spark, path) if name.startswith(DATA) and name not in named and changed <= before]
    for n in found[: len(found) - len(kept)]:
        # A version goes before its folders do, and only if all of these may.
        if all(f in named or f in gone or not f for f in current(spark, path, n).folders):
            fs, p = filesystem(spark, f"{path}/{POINTERS}/{n:012d}.json")
            fs.delete(p, False)
    for name in gone:
        fs, p = filesystem(spark, f"{path}/{name}")
        fs.delete(p, True)
    return len(gone)
