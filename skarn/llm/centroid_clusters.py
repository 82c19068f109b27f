"""Centroid clustering in whole numbers, with block-norm screening.

A vector's components become integers, and rounds of Lloyd's method run over them exactly. Each vector
is compressed once to the norms of its segments. By Cauchy-Schwarz the squared distance of x and c is at
least the sum over segments of (|x_s| - |c_s|)^2, so norms alone give a lower bound: centroids whose
bound exceeds the best exact distance so far are pruned, and only the others get an exact one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, select_as, small_batches, tidy

#: Components of a vector, components of one segment, and what a component is multiplied by.
DIM, SEGMENT, SCALE = 64, 2, 1024
#: Added to each component before norms are taken, of vectors and centroids alike: distances stay, and norms see signs.
SHIFT = 1024
#: Integers up to this size are worked on as 64-bit numbers: squared distances of 64 components then fit. Vectors with a larger one use Python's integers.
NARROW = 1 << 27
#: Sums travel as digits of this base, so that sums of digits fit a long however many rows there are.
LIMB = 1 << 32
LONG = 1 << 63


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: int64 where all are NARROW, else Python's integers."""
    q = np.floor(values * scale)
    if np.abs(q).max(initial=0) <= NARROW:
        return q.astype(np.int64)
    out = np.empty(values.size, object)
    out[:] = [math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in values.ravel().tolist()]
    return out.reshape(values.shape)


def segment_norms(q: np.ndarray) -> np.ndarray:
    """Euclidean norms of the segments of each row of integers, moved by SHIFT."""
    return np.sqrt(np.add.reduceat((q.astype(np.float64) + SHIFT) ** 2, np.arange(0, q.shape[1], SEGMENT), axis=1)).astype(np.float32)


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, exact squared distance) of each row, ties to the smaller number; and how many exact distances that took.

    Integers beyond NARROW are not screened: every distance of theirs is exact.
    """
    n, k = len(q), len(centroids)
    kind = np.int64 if q.dtype == np.int64 and np.abs(centroids).max(initial=0) <= NARROW else object
    q, centroids = q.astype(kind), centroids.astype(kind)

    def exact(rows, j):
        return ((q[rows] - centroids[j]) ** 2).sum(axis=1)

    if kind is object:
        best, bound = np.zeros(n, np.int64), np.full((n, k), -np.inf)
    else:
        norms, c_norms = norms.astype(np.float64), segment_norms(centroids).astype(np.float64)
        # |x|^2 + |c|^2 - 2 sum |x_s| |c_s| is the same bound; the margin is above what rounding norms to 32 bits can add to it.
        squares = (norms**2).sum(axis=1)[:, None] + (c_norms**2).sum(axis=1)[None, :]
        bound = squares - 2 * (norms @ c_norms.T) - (1e-6 * squares + 1)
        best = bound.argmin(axis=1)
    distance = exact(np.arange(n), best)
    first, done = best.copy(), n
    for j in range(k):
        rows = np.flatnonzero((first != j) & ~(bound[:, j] > (0 if kind is object else distance)))
        if len(rows):
            d = exact(rows, j)
            better = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            best[rows[better]], distance[rows[better]] = j, d[better]
            done += len(rows)
    return best, distance, done


def prepared(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, norms, wide) of the vectors that take part: integers and segment norms as bytes.

    Vectors that are null, of another length, or with a null or non-finite component take no part. wide
    is null but for vectors with an integer beyond NARROW: then it has the components as doubles.
    """
    small_batches(vectors.sparkSession)
    rows = select_as(vectors, vec_id="long", embedding="array<double>")
    fits = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(fits, F.lit(False)))

    def pack(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            narrow = (np.abs(np.floor(values * scale)) <= NARROW).all(axis=1)
            q = quantised(np.where(narrow[:, None], values, 0), scale)
            norms, q = segment_norms(q), q.astype("<i4")
            wide = [None if ok else v.astype("<f8").tobytes() for ok, v in zip(narrow, values)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in q], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in norms], pa.binary()), pa.array(wide, pa.binary())],
                ["vec_id", "q", "norms", "wide"],
            )
        tidy()

    return rows.mapInArrow(pack, "vec_id long, q binary, norms binary, wide binary")


def _parts(batch: pa.RecordBatch, scale: int):
    """(rows, integers, norms) of a batch: the narrow ones together, the wide ones together."""
    wide = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(rows):
            part = batch.take(pa.array(rows))
            if wide[rows[0]]:
                q = quantised(np.array([np.frombuffer(x.as_py(), "<f8") for x in part.column(3)]), scale)
                yield rows, q, np.zeros((len(rows), 1))
            else:
                read = lambda c, kind: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(rows), -1)
                yield rows, read(part.column(1), "<i4").astype(np.int64), read(part.column(2), "<f4")


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int = SCALE) -> np.ndarray:
    """The k prepared vectors with smallest sha256 of "seed:vec_id", in that order; a null vec_id counts as an empty one, ties go by content."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "q", "wide").orderBy("h", "q", "wide").limit(k).collect()
    found = [quantised(np.frombuffer(r["wide"], "<f8"), scale) if r["wide"] else np.frombuffer(r["q"], "<i4").astype(np.int64) for r in rows]
    return np.array([list(map(int, v)) for v in found], object)


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> list:
    """(cluster, i, digit, v): sums over a cluster's vectors by component and digit; i = -1 counts them. k * DIM short rows."""

    def run(batches):
        k, dim = centroids.shape
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            for _, q, norms in _parts(batch, scale):
                best = nearest(q, norms, centroids)[0]
                count += np.bincount(best, minlength=k)
                for j in np.unique(best):
                    total[j] += q[best == j].sum(axis=0).astype(object)
        rows = [(j, -1, 0, int(count[j])) for j in range(k) if count[j]]
        for j in np.flatnonzero(count):
            for i, v in enumerate(total[j]):
                digit = 0
                # The last digit keeps the sign.
                while v:
                    low = v if abs(v) < LIMB else v % LIMB
                    rows.append((int(j), i, digit, int(low)))
                    v, digit = (v - low) // LIMB, digit + 1
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["cluster", "i", "digit", "v"])
        tidy()

    return vectors.mapInArrow(run, "cluster int, i int, digit int, v long").groupBy("cluster", "i", "digit").agg(F.sum("v").alias("v")).collect()


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component; those without vectors stay."""
    out, total = centroids.copy(), np.zeros(centroids.shape, object)
    count = {r["cluster"]: r["v"] for r in sums if r["i"] < 0}
    for r in sums:
        if r["i"] >= 0:
            total[r["cluster"], r["i"]] += r["v"] * LIMB ** r["digit"]
    for j, n in count.items():
        out[j] = total[j] // n
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of every prepared vector; a squared distance beyond a long is null."""

    def run(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for rows, q, norms in _parts(batch, scale):
                cluster[rows], distance[rows] = nearest(q, norms, centroids)[:2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array([d if d < LONG else None for d in distance.tolist()], pa.int64())], ["vec_id", "cluster", "distance"])
        tidy()

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors that are null, of another length than dim, or with a null or non-finite component take no
    part; a null vec_id does, and repeated rows count one by one. With fewer than k vectors each is a
    centroid; an empty table gives an empty result. Extra columns are not looked at. Distances and their
    sums that a long can't hold are null, the assignment is exact all the same. A row is one vector of dim
    numbers, so none is long. What reaches the driver in a round is k * dim sums, not rows.
    """
    rows = materialize(prepared(vectors, dim, scale), "vectors")
    centroids = first_centroids(rows, k, seed, scale)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(centroids, _sums(rows, centroids, scale))
    found = materialize(assign(rows, centroids, scale), "clusters")
    discard(rows)
    # At most k rows.
    wide = F.max(F.col("distance").isNull()).alias("wide")
    parts = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), wide).collect()
    sums = {r["cluster"]: None if r["wide"] else int(r["total"]) for r in parts}
    whole = None if None in sums.values() else sum(sums.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def long(value):
        return F.lit(value if value is not None and value < LONG else None).cast("long")

    def of(values):
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of([long(sums.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"),
        long(whole).alias("inertia"),
        of([F.lit(h) for h in hashes]).alias("centroid_sha256"),
    )
