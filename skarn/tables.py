"""Tables written on the way: lineage ends there, and lost executors cost a retry of one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    On one machine (master local) a new folder does where none is named; a cluster must name one, as
    its executors share no local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="skarn-")
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/skarn-{name}-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_skarn_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
