"""Bootstrap intervals over clusters: exact multinomial resamples by splitting a tree of hash ranges.

A resample draws n times from n clusters. Clusters are dealt to blocks, which are ranges of a hash of
their key; the draws of a range are split between its halves by a binomial law whose chance is the
half's share of clusters, from the whole down to the blocks, and within a block each draw takes one of
its clusters. So every resample has exactly n draws, with the same law for any number of clusters, and
each block works out its own draws: no cluster is numbered, and no draw is exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.numeric import ratio
from skarn.session import ship_code
from skarn.tables import discard, materialize

RESAMPLES, CONFIDENCE, SEED, LEAST_CLUSTERS = 10_000, 0.95, 0, 3
#: Clusters of a block on average, as long as the tree has no more than so many levels: what every task is told of it has a bound.
BLOCK, LEVELS = 4096, 14
#: Draws that a task holds at once.
HELD = 1 << 22
_M1, _M2 = np.uint64(0x3F58476D1CE4E5B9), np.uint64(0x14D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit numbers; the query catalogue's SQL has the same."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def places(seed: int, block: int, resamples: np.ndarray, draws: np.ndarray, size: int) -> np.ndarray:
    """Place (from 0, below size) of each of the draws of each resample within a block, resample by resample."""
    keys = mix(mix(mix(np.uint64([seed])) + resamples.astype(np.uint64)) + np.uint64(block))
    starts = np.concatenate([[0], np.cumsum(draws)])
    nth = np.arange(starts[-1]) - np.repeat(starts[:-1], draws)
    value = mix(np.repeat(keys, draws) + nth.astype(np.uint64))
    return (((value >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def block_draws(seed: int, ends: np.ndarray, block: int, resamples: int) -> np.ndarray:
    """How many of the n draws of each resample go to a block; ends has the number of clusters up to each block, from 0 to n.

    Walks from the whole range down to the block. What a node draws is seeded by the node, so all blocks
    below it see the same, and their draws sum to n.
    """
    draws = np.full(resamples, ends[-1], np.int64)
    low, high, node = 0, len(ends) - 1, 1
    while high - low > 1:
        half = (low + high) // 2
        inside = ends[high] - ends[low]
        share = (ends[half] - ends[low]) / inside if inside else 0.0
        left = np.random.Generator(np.random.Philox(key=[seed % (1 << 63), node])).binomial(draws, share)
        if block < half:
            draws, high, node = left, half, 2 * node
        else:
            draws, low, node = draws - left, half, 2 * node + 1
    return draws


def resample_sums(stats: DataFrame, key: str, names: list[str], resamples: int, seed: int = SEED) -> DataFrame:
    """(r, draws, names): of each resample, how often it drew and the sums over the clusters drawn; r from 0.

    stats has a row for each cluster. A task takes one block, and, where there are few blocks, some of the
    resamples. Null statistics count as 0.
    """
    ship_code(stats.sparkSession)
    hashed = stats.select(F.col(key).alias("k"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - LEVELS).cast("int").alias("leaf"))
    counts = np.zeros(1 << LEVELS, np.int64)
    for r in hashed.groupBy("leaf").count().collect():  # 2^LEVELS rows at most
        counts[r["leaf"]] = r["count"]
    n = int(counts.sum())
    levels = min(LEVELS, max(0, (-(-n // BLOCK) - 1).bit_length()))
    ends = np.concatenate([[0], counts.reshape(1 << levels, -1).sum(axis=1).cumsum()])
    parts = max(1, 8 >> levels)
    rows = hashed.select(F.shiftright("leaf", LEVELS - levels).alias("block"), "k", *names).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key, table):
        block, part = (x.as_py() for x in key)
        size = table.num_rows
        table = table.sort_by([("k", "ascending"), *[(c, "ascending") for c in names]])
        values = np.stack([table.column(c).to_numpy() for c in names], axis=1)
        draws = block_draws(seed, ends, block, resamples)
        r, sums = np.arange(part, resamples, parts), []
        step = max(1, HELD // max(size, int(draws.max(initial=1))))
        for a in range(0, len(r), step):
            some = r[a : a + step]
            at = places(seed, block, some, draws[some], size)
            owner = np.repeat(np.arange(len(some)), draws[some])
            times = np.bincount(owner * size + at, minlength=len(some) * size).reshape(len(some), size)
            sums.append(times @ values)
        sums = np.concatenate(sums) if sums else np.zeros((0, len(names)))
        return pa.table([pa.array(r), pa.array(draws[r]), *[pa.array(sums[:, i]) for i in range(len(names))]], ["r", "draws", *names])

    columns = "".join(f", `{c}` double" for c in names)
    found = rows.groupBy("block", "part").applyInArrow(run, f"r long, draws long{columns}")
    return found.groupBy("r").agg(F.sum("draws").alias("draws"), *[F.sum(c).alias(c) for c in names])


def bootstrap(stats: DataFrame, key: str, metrics: list[str], resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE, least: int = 1, gaps: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(metric, low, high, draws): percentile intervals of ratios of sums, resampling clusters.

    stats has a row for each cluster: key, and <metric>_num and <metric>_den to be summed. A resample whose
    denominator is 0 doesn't count; a metric without resamples, or fewer than least clusters, has no row.
    gaps names differences of two metrics, taken within the resample. Draws are hashes of seed, resample
    and block, so they are the same in any partitioning.
    """
    spark, names, kind = stats.sparkSession, [f"{m}_{x}" for m in metrics for x in ("num", "den")], "metric string, low double, high double, draws long"
    # Written, as it is read twice and may be costly; the result has a row for each metric, so it needs no table afterwards.
    stats = materialize(stats.select(key, *names), "clusters")
    if resamples <= 0 or len(stats.select(key).limit(max(1, least)).collect()) < max(1, least):
        discard(stats)
        return spark.createDataFrame([], kind)
    sums = resample_sums(stats, key, names, resamples, seed)
    values = {m: ratio(F.col(f"{m}_num"), F.col(f"{m}_den")) for m in metrics}
    values |= {g: values[a] - values[b] for g, (a, b) in (gaps or {}).items()}
    long = sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]))).where("value is not null")
    tail = (1 - confidence) / 2
    found = long.groupBy("metric").agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count("*").alias("draws")).collect()
    discard(stats)
    return spark.createDataFrame(found, kind)
