"""A cache of answers laid out by key: buckets of its key's hash, so that a lookup moves the rows that ask, not the cache.

The files are a Spark table in the folder of the cache; a session that doesn't know the table yet is told of
it. The number of buckets is settled by whoever makes the cache, in a file beside it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import create_once, filesystem

#: Buckets of a new cache: tasks of a lookup, and files of an append.
BUCKETS = 64
KEY = "cache_key"
ANSWERS_DDL = f"{KEY} string, raw string"


def _settled(spark: SparkSession, path: str, text: str) -> str:
    """text, or what an earlier caller has settled."""
    create_once(spark, f"{path}/_layout", text)
    fs, p = filesystem(spark, f"{path}/_layout")
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _table(spark: SparkSession, path: str, ddl: str, buckets: int) -> tuple[str, int]:
    """Name of the cache's table in this session's catalogue, and its number of buckets."""
    fs, p = filesystem(spark, path)
    place = fs.makeQualified(p).toString()
    n = int(_settled(spark, path, str(buckets)))
    name = f"skarn_cache_{hashlib.sha256(place.encode()).hexdigest()[:20]}"
    if not spark.catalog.tableExists(name):
        escaped = place.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {n} BUCKETS LOCATION '{escaped}/answers'")
    spark.catalog.refreshTable(name)  # others may have appended
    return name, n


def read_cache(spark: SparkSession, path: str, ddl: str = ANSWERS_DDL, buckets: int = BUCKETS) -> DataFrame:
    """The answers of a cache, distributed by cache_key; a cache that isn't there yet is made, empty."""
    return spark.table(_table(spark, path, ddl, buckets)[0])


def look_up(rows: DataFrame, path: str, ddl: str = ANSWERS_DDL) -> DataFrame:
    """rows (with cache_key) with what the cache has for them, and cache_hit; several answers of a key count as one.

    The cache is read where it lies: only rows are exchanged.
    """
    cached = read_cache(rows.sparkSession, path, ddl)
    return rows.join(cached.dropDuplicates([KEY]), KEY, "left").withColumn("cache_hit", F.col("raw").isNotNull())


def add_answers(answers: DataFrame, path: str, ddl: str = ANSWERS_DDL, buckets: int = BUCKETS) -> None:
    """Adds answers whose key the cache lacks, one for each key, to its buckets; failed ones (null raw) aren't kept.

    Of two jobs that add the same key at once both may; a lookup counts them as one.
    """
    spark = answers.sparkSession
    name, n = _table(spark, path, ddl, buckets)
    columns = [field.strip().split(" ")[0] for field in ddl.split(",")]
    fresh = answers.where(F.col("raw").isNotNull() & F.col(KEY).isNotNull()).select(*columns).dropDuplicates([KEY])
    fresh = fresh.join(spark.table(name).select(KEY), KEY, "left_anti").select(*columns)
    # Dealt as the buckets are, so that a task writes one file.
    fresh.repartition(n, KEY).write.format("parquet").mode("append").bucketBy(n, KEY).sortBy(KEY).saveAsTable(name)
