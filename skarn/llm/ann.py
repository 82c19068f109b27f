"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample, with a price on full clusters so that lists come out even.
Every vector goes to the list of its nearest centroid and, near a boundary, to several. Centroids are
searched by a graph of neighbours in memory. A query reads the lists whose centroids are at most
`ratio` times as far as the nearest one; how far that must reach for the recall asked for is measured
on the sample, up to all lists where vectors need them, as is the number of lists that a vector goes to: as many
as make the fewest comparisons. Lists are joined with queries by list, and scores are exact.
"""

from __future__ import annotations

import hashlib
import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize, select_as, small_batches

_log = logging.getLogger(__name__)
#: Vectors of a list on average, most lists, sample for the fit: rows, and rows for each list.
LIST_SIZE, MOST_LISTS, FIT_ROWS, FIT_PER_LIST = 100, 8192, 20_000, 16
#: Lists that every query reads, however near its nearest centroid is.
LEAST_LISTS = 8
#: Lists that a vector goes to at most; how much farther than the nearest such a list may be.
COPIES, BOUNDARY = 4, 1.3
#: Graph neighbours of a centroid, centroids that a search for a vector's lists holds, the part of those held that a
#: step of a search opens, recall that the sample must reach, and recall below which there is no result.
DEGREE, BEAM, OPENED, RECALL, LEAST_RECALL = 24, 64, 32, 0.98, 0.9
#: Queries that recall is measured with; one in so many rows of the sample is kept out of the fit for that.
MEASURED, HELD_OUT = 400, 4
#: Vectors of a slice of a list: longer lists are read by several tasks. Bytes of vectors that a task holds.
SLICE, BIN_BYTES = 20_000, 32 << 20
#: Bytes of the sample's vectors in the driver, as doubles.
FIT_BYTES = 128 << 20


def _spread(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """k unit centroids of unit vectors x; a price on clusters over the mean size keeps them even."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    price = np.zeros(k, np.float32)
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T - price).argmax(axis=1) for a in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        price = np.maximum(0, price + 0.02 * (size * k / len(x) - 1)).astype(np.float32)
        order = np.argsort(near, kind="stable")
        edge = np.searchsorted(near[order], np.arange(k))
        full = size > 0
        sums = np.add.reduceat(x[order], edge[full], axis=0)
        c[full] = sums
        c[~full] = x[rng.choice(len(x), (~full).sum())]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Index:
    """Centroids, their graph, and how far a query must look."""

    dim: int
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    lists: int = 1
    ratio: float = 1.0
    copies: int = COPIES
    #: Measured on vectors kept out of the fit: share of true neighbours found, and comparisons of a query for each vector.
    recall: float = 1.0
    work: float = 1.0

    def nearest(self, x: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the held nearest for each row of x (unit length), found by the graph."""
        # A search that held fewer than BEAM would end where no neighbour is nearer.
        held, beam = (min(h, len(self.centroids)) for h in (held, max(held, BEAM)))
        out = [self._walk(x[a : a + 512].astype(np.float32), beam) for a in range(0, len(x), 512)]
        if not out:
            return np.zeros((0, held), np.int64), np.zeros((0, held))
        ids, sims = (np.concatenate(p)[:, :held] for p in zip(*out))
        return ids, np.sqrt(np.maximum(0, 2 - 2 * sims))

    def _walk(self, x: np.ndarray, held: int):
        """Opens the nearest centroids that aren't opened yet, some at once, until the held nearest known ones all are."""
        n, k, some = len(x), len(self.centroids), max(2, held // OPENED)
        rows = np.arange(n)[:, None]
        seen, mark = np.zeros((n, k), bool), np.zeros((n, k), np.int32)
        ids = np.tile(self.entries, (n, 1))
        seen[:, self.entries] = True
        sims = x @ self.centroids[self.entries].T
        done = np.zeros(ids.shape, bool)
        while True:
            if ids.shape[1] > held:
                keep = np.argpartition(-sims, held - 1, axis=1)[:, :held]
                ids, sims, done = ids[rows, keep], sims[rows, keep], done[rows, keep]
            open_to = np.where(done, -np.inf, sims)
            at = np.argpartition(-open_to, min(some, ids.shape[1]) - 1, axis=1)[:, :some]
            go = np.isfinite(open_to[rows, at])
            if go.any():
                done[rows, at] |= go
                new = self.graph[ids[rows, at]].reshape(n, -1)
                go = np.repeat(go, self.graph.shape[1], axis=1)
            elif ids.shape[1] >= held and np.isfinite(sims).all():
                order = np.argsort(-sims, axis=1, kind="stable")
                return ids[rows, order], sims[rows, order]
            else:
                # The graph has parts that the entries don't lead to: go on from unseen centroids.
                new = np.argsort(seen, axis=1, kind="stable")[:, :some]
                go = np.ones(new.shape, bool)
            r, c = np.nonzero(go & ~seen[rows, new])
            mark[r, new[r, c]] = c
            once = mark[r, new[r, c]] == c  # of those that are met twice in this step the last
            r, c = r[once], c[once]
            to = new[r, c]
            seen[r, to] = True
            s = np.full(new.shape, -np.inf, np.float32)
            s[r, c] = (self.centroids[to] * x[r]).sum(axis=1)
            ids, sims, done = np.hstack([ids, new]), np.hstack([sims, s]), np.hstack([done, np.isinf(s)])

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists that each vector is kept in."""
        ids, d = self.nearest(x, BEAM)
        near = d[:, : self.copies] <= BOUNDARY * d[:, :1] + 1e-6
        return [i[: self.copies][ok] for i, ok in zip(ids, near)]

    def lists_for(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists that each query reads."""
        ids, d = self.nearest(x, self.lists)
        ok = d <= self.ratio * d[:, :1] + 1e-6
        ok[:, :LEAST_LISTS] = True
        return [i[o] for i, o in zip(ids, ok)]


def fit(sample: np.ndarray, n: int, recall: float = RECALL) -> Index:
    """An index for n vectors, fitted on a sample of unit vectors."""
    rng = np.random.default_rng(3)
    x = sample.astype(np.float32)
    k = int(min(max(1, n // LIST_SIZE, min(16, len(x) // 4)), MOST_LISTS, max(1, len(x) // 4)))
    # Rows of the fit are nearer to centroids than others: neighbours are measured among rows kept out of it.
    mixed = rng.permutation(len(x))
    split = len(x) // HELD_OUT if len(x) >= 10 * MEASURED else 0
    rest, held = mixed[split:], x[mixed[:split] if split else mixed]
    c = _spread(x[rest], min(k, len(rest)), 10, rng)
    graph = np.zeros((k, min(DEGREE, max(1, k - 1))), np.int64)
    for a in range(0, k, 1024):
        s = c[a : a + 1024] @ c.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        graph[a : a + 1024] = np.argsort(-s, axis=1, kind="stable")[:, : graph.shape[1]]
    if graph.shape[1] > 8:  # some far ones, so that no part of the graph is shut off
        graph[:, -4:] = rng.integers(0, k, (k, 4))
    index = Index(x.shape[1], c, graph, rng.choice(k, min(k, 32), replace=False))
    index.lists = k
    if len(x) < 2:
        index.ratio = 4.0
        return index
    queries = np.arange(min(len(held), MEASURED))
    s = held[queries] @ held.T
    s[queries, queries] = -2
    top = np.argsort(-s, axis=1, kind="stable")[:, : min(5, len(held) - 1)]
    sims = held[queries] @ c.T
    ids = np.argsort(-sims, axis=1, kind="stable")
    d = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, ids, axis=1)))
    place = np.zeros((len(queries), k), np.int64)
    np.put_along_axis(place, ids, np.arange(k)[None, :], axis=1)
    wanted, best = np.unique(top), None
    for copies in sorted({1, 2, COPIES}):
        index.copies = copies
        lists = index.lists_of(held[wanted])
        kept, replicas = dict(zip(wanted.tolist(), lists)), np.mean([len(x) for x in lists])
        need = np.array([[min(place[i, j] for j in kept[int(t)]) for t in row] for i, row in enumerate(top)])
        found = _reach(need, d, k, recall)
        read = np.maximum((d[:, : found[0]] <= found[1] * d[:, :1] + 1e-6).sum(axis=1), min(LEAST_LISTS, k))
        work = float(read.mean() / k * replicas)
        # Replicas are worth a tenth of the work: they make up for boundaries that the sample doesn't show.
        if best is None or work <= 1.1 * best[0]:
            best = work, copies, found, float((need < read[:, None]).mean())
    index.work, index.copies, (index.lists, index.ratio), index.recall = best
    if index.recall < min(LEAST_RECALL, recall):
        raise RuntimeError(f"recall is {index.recall:.3f} on vectors kept out of the fit; more rows in the sample (fit_rows) may mend that")
    return index


def _reach(need: np.ndarray, d: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """(lists, ratio) that queries with distances d to all lists must reach, if their neighbours need so many lists."""
    # Enough lists, and far enough, for half the loss that the recall allows, as the sample is a sample.
    goal = (1 + recall) / 2
    lists = min(k, math.ceil((int(np.quantile(need, goal, method="higher")) + 1) * 1.2) + 2)
    far = d[:, lists - 1] / np.maximum(d[:, 0], 1e-6)
    for share in (0.9, 0.95, 1.0):  # the least reach at which what queries read reaches the goal
        ratio = float(np.quantile(far, share))
        read = np.maximum((d[:, :lists] <= ratio * d[:, :1] + 1e-6).sum(axis=1), LEAST_LISTS)
        if (need < read[:, None]).mean() >= goal:
            break
    return lists, ratio


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): dim finite components that aren't null, and not all zero."""
    keep = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = pc.list_flatten(column.take(pa.array(keep))).cast(pa.float64())
    x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(len(keep), dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return keep[ok], x[ok]


def _vectors(blobs, dim: int, kind: str) -> np.ndarray:
    """Rows of doubles from the bytes of vectors."""
    return np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of v with q, in double precision."""
    return (v * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(axis=1)))


def _parse(dim: int, kind: str):
    def run(batches):
        for batch in batches:
            keep, x = _matrix(batch.column(1), dim)
            x = (x + 0.0).astype(kind)
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "v", "key"])

    return run


def _assign(index, dim: int, kind: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1).to_pylist(), dim, kind)
            found = index.value.lists_of(_unit(x))
            n = np.array([len(f) for f in found])
            rows = pa.array(np.repeat(np.arange(len(found)), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), *[c.take(rows) for c in batch.columns]], ["list", *batch.schema.names])

    return run


def _ask(index, dim: int, kind: str, slices):
    """A row for each query and bin that it reads of, with the parts (list and slice) that it reads there."""

    def run(batches):
        bins, parts, start = slices.value  # of all lists: those of list i are from start[i] on
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1).to_pylist(), dim, kind)
            rows, bin_of, read = [], [], []
            for i, found in enumerate(index.value.lists_for(_unit(x))):
                at = np.concatenate([np.arange(start[j], start[j + 1]) for j in found])
                at = at[np.argsort(bins[at], kind="stable")]
                for group in np.split(at, np.flatnonzero(np.diff(bins[at])) + 1) if len(at) else ():
                    rows.append(i)
                    bin_of.append(bins[group[0]])
                    read.append(parts[group])
            yield pa.RecordBatch.from_arrays([pa.array(bin_of, pa.int64()), pa.array(read, pa.list_(pa.int64())), *[c.take(pa.array(rows, pa.int64())) for c in batch.columns]], ["bin", "parts", *batch.schema.names])

    return run


def _best(found: list, top: int) -> list:
    """The top distinct rows (query, id, score) of each query."""
    if not found:
        return found
    q, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.ones(len(q), bool)  # copies of a row follow each other, as their scores are equal
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[new], ids[new], score[new]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < top
    return [(q[keep], ids[keep], score[keep])]


def _search(dim: int, kind: str, top: int):
    """Best rows of each bin for each query that reads lists there."""

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            read = [np.array(p, np.int64) for p in queries.column("parts").to_pylist()]
            asks, part_of = np.repeat(np.arange(len(read)), [len(p) for p in read]), np.concatenate(read)
            order = np.argsort(part_of, kind="stable")
            asks, part_of = asks[order], part_of[order]
            v_part = rows.column("part").to_numpy()
            by_part = np.argsort(v_part, kind="stable")
            v_part = v_part[by_part]
            ids = rows.column("vec_id").to_numpy()
            q = _vectors(queries.column("v").to_pylist(), dim, kind)
            v = _vectors(rows.column("v").to_pylist(), dim, kind)
            q_unit, v_unit, held = _unit(q), _unit(v), 0
            for part in np.unique(part_of):
                qs = asks[slice(*np.searchsorted(part_of, [part, part + 1]))]
                vs = by_part[slice(*np.searchsorted(v_part, [part, part + 1]))]
                if not len(vs):
                    continue
                for a in range(0, len(qs), 1024):
                    sims = q_unit[qs[a : a + 1024]] @ v_unit[vs].T
                    # All rows within rounding of the last one wanted, then exact order.
                    cut = np.partition(sims, -top, axis=1)[:, -top] - 1e-9 if len(vs) > top else np.full(len(sims), -2.0)
                    for i, s, c in zip(qs[a : a + 1024], sims, cut):
                        near = vs[s >= c]
                        exact = _cosines(q[i], v[near])
                        first = np.lexsort((ids[near], -exact))[:top]
                        found.append((np.full(len(first), i), ids[near[first]], exact[first]))
                        held += len(first)
                    if held > 1_000_000:
                        found = _best(found, top)
                        held = 0
            found = _best(found, top)
        i, near, score = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"key": queries.column("key").combine_chunks().take(pa.array(i)).cast(pa.binary()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by every.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller vec_id.
    Rows with a null vec_id, and vectors that are null, zero, of another length than most, or with null or non-finite
    components take no part. Rows with the same vec_id count as one, the query's own id is no candidate.
    fit_rows bounds the sample that centroids are fitted on (more if lists need it: FIT_PER_LIST rows
    each, of FIT_BYTES bytes at most); every vector is indexed. Recall is measured on a part of the sample that is kept
    out of the fit, and logged; RuntimeError if it is under LEAST_RECALL. Vectors of so many dimensions that
    FIT_BYTES holds few of them get fewer lists. Too few rows give what there is; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = select_as(embeddings, vec_id="long", embedding="array<double>").where("vec_id is not null and embedding is not null")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None or not common["d"]:
        return empty
    dim = common["d"]
    # Floats go as floats: doubles would only make what is exchanged twice as large.
    kind = "f4" if embeddings.schema["embedding"].dataType.elementType == FloatType() else "f8"
    parsed = materialize(rows.mapInArrow(_parse(dim, kind), "vec_id long, v binary, key binary"), "vectors")
    n = parsed.count()
    if not n:
        return empty
    size = min(max(fit_rows, FIT_PER_LIST * min(MOST_LISTS, n // LIST_SIZE)), max(1, FIT_BYTES // (8 * dim)))
    chance = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1_000_000)) / 1e6
    sample = parsed.where(chance < size / n).select("v").collect()  # about size rows, a stated bound
    if not sample:
        sample = parsed.select("v").limit(1).collect()
    x = _unit(_vectors((r["v"] for r in sample), dim, kind))
    index = fit(x, n, recall)
    _log.info("nearest: %d lists, %d copies at most, recall %.3f and %.3f comparisons a vector, measured on vectors kept out of the fit", len(index.centroids), index.copies, index.recall, index.work)
    index = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids at most

    # Of equal vectors only the first k + 1 by id can be among the k nearest of any query.
    firsts = parsed.groupBy("key", "vec_id").agg(F.first("v").alias("v"))
    firsts = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    lists = materialize(firsts.select("vec_id", "v").mapInArrow(_assign(index, dim, kind), "list int, vec_id long, v binary"), "lists")
    asked = parsed.where(F.col("vec_id") % every == 0).select("vec_id", "key", "v")
    sizes = dict(lists.groupBy("list").count().collect())  # MOST_LISTS rows at most
    held_in = np.array([sizes.get(i, 0) for i in range(len(index.value.centroids))], np.int64)
    per = -(-held_in // SLICE)
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(held_in.sum()) * dim * 8 // BIN_BYTES))
    start = np.concatenate([[0], np.cumsum(per)])
    parts = np.repeat(np.arange(len(per)), per) << 32 | np.arange(start[-1]) - np.repeat(start[:-1], per)
    # Parts are dealt in turn, so that bins have about as many each; a query is sent once to each bin that it reads of.
    sent = spark.sparkContext.broadcast((np.arange(len(parts)) % bins, parts, start))
    firsts_of = spark.createDataFrame([(i, int(n), int(a)) for i, (n, a) in enumerate(zip(per, start)) if n], "list int, slices int, first long")
    points = asked.groupBy("key").agg(F.first("v").alias("v")).select("key", "v").mapInArrow(_ask(index, dim, kind, sent), "bin long, parts array<long>, key binary, v binary")
    held = lists.join(F.broadcast(firsts_of), "list").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")))
    held = held.select(((F.col("first") + F.col("slice")) % bins).alias("bin"), F.shiftleft(F.col("list").cast("long"), 32).bitwiseOR(F.col("slice")).alias("part"), "vec_id", "v")
    found = points.groupBy("bin").cogroup(held.groupBy("bin")).applyInArrow(_search(dim, kind, k + 1), "key binary, vec_id long, score double")
    found = found.dropDuplicates(["key", "vec_id"])
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    pairs = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(best.select("key", "vec_id", "score"), "key").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
