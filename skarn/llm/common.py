"""What several operators share: the shared folder, written tables, linking of nodes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.session import ship_code
from skarn.tables import shared_dir

#: Rows and bytes in an Arrow batch: long texts come in batches that stay in a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, and sees that workers have this package."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/skarn-{name}-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_skarn_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def tidy() -> None:
    """Gives freed memory of a Python worker back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def select_as(df: DataFrame, **kinds: str) -> DataFrame:
    """Only these columns, cast; whatever else df has, clashing names included, stays out."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b, and the smallest node that each reaches."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = idx[: len(a)], idx[len(a) :]
    while True:
        low = np.minimum(parent[x], parent[y])
        new = parent.copy()
        np.minimum.at(new, parent[x], low)
        np.minimum.at(new, parent[y], low)
        new = new[new]
        if np.array_equal(new, parent):
            return nodes, nodes[parent]
        parent = new


def _local_forest(batches):
    """A partition's edges, each node linked to the smallest one it reaches within the partition."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(x.shape[1] for x in held) > 2_000_000:
            yield _forest(held)
            held = []
    if held:
        yield _forest(held)


def _forest(held: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(held, axis=1)
    nodes, low = roots(a, b) if len(a) else (a, b)
    keep = nodes != low
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(low[keep], pa.int64())], ["u", "v"])


def with_least(rows: DataFrame, key: str, aggregate, name: str) -> DataFrame:
    """rows (a written table) with a column name: aggregate over all rows of the same key.

    The values are a written table too, so this is a plain join of two scans, of which Spark splits
    the partition of a key that holds many rows; a window or an aggregate below the join would not let it.
    discard() of the result removes the table of values, once nothing reads the result any more.
    """
    values = materialize(rows.groupBy(key).agg(aggregate.alias(name)), f"{name}-of")
    out = rows.join(values, key)
    out._skarn_path = values._skarn_path
    return out


#: Most bits of a sieve: its size is bounded however many keys there are.
SIEVE_BITS = 1 << 26


def sieve(keys: DataFrame, n: int):
    """A test Column -> Column that is true for all of the n long keys (column key) and false for most others.

    It is a bitmap of hashes, one row of SIEVE_BITS bits at most: rows that can't find a partner in a
    join needn't be exchanged. With very many keys it lets more rows pass, and the join still decides.
    """
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(10, (8 * n).bit_length()))

    def place(key):
        return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(bits))

    at = keys.select(place(F.col("key")).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    all_words = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")).alias("s"))
    table = materialize(all_words.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("bitmap")), "sieve")

    def test(key):
        p = place(key)
        return F.call_function("getbit", F.element_at(table.scalar(), (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1

    return test


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (u, v), v < u, either has one edge to a smaller node or is only such a node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "cc", forests: bool = False) -> DataFrame:
    """(node, comp) of every node of edges (a, b): comp is the smallest node that it reaches.

    Large-star and small-star rounds over tables in the shared folder; no list of links or nodes
    reaches the driver. Nodes without edges are not listed; null ends are ignored. forests says that each
    task's edges are few already (a forest), so that they needn't pass another Python worker first.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    local = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if forests else ends.mapInArrow(_local_forest, "u long, v long")
    now = materialize(local.distinct(), name)
    while not _is_stars(now):
        both = materialize(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), name)
        least = with_least(both, "u", F.least(F.min("v"), F.first("u")), "m")
        large = materialize(least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        lower = with_least(large, "u", F.min("v"), "m")
        small = materialize(lower.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), name)
        for done in (now, both, least, large, lower):
            discard(done)
        now = small
    roots_of = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return roots_of.union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
