"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

1. Documents with the same set of word shingles are one class, with a bitmap signature: bit h mod W is
   set for each shingle hash h.
2. Sizes are cut into bands; two linked sets lie in a band's range. Of two linked sets, only a known
   number D of shingles differ, so if a band cuts the shingle hashes into more than D parts, at least
   one part is the same in both. A tile is a band, a part and the part's content: linked sets meet in
   a tile, and sets that merely share a frequent passage hardly ever do.
3. In a tile, differing bits of two signatures bound the overlap from above. Tiles of few classes give
   the pairs that pass the bound. Larger ones are covered by canopies: differing bits obey the triangle
   inequality, so a pivot takes everything within 2 D bits, and what is within D bits needs no pivot of
   its own. Each linked pair of a tile shares a canopy, and no tile gives all its pairs. A task sends
   only edges between classes that a first look at a few tiles hasn't connected yet.
4. Components of these candidate edges are groups in which sorted arrays are intersected exactly, with
   union-find so that sets already connected are not compared again. Groups that are too large for
   one task are cut into slices, each compared within and with pivots that all slices have; only what
   that leaves apart from the largest part of its group is compared block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import connected_components, discard, materialize, roots, select_as, sieve, small_batches, tidy, with_least

#: Entries of tiles that one task groups, shingles that one task compares, and classes of a tile whose pairs are all tested.
BUCKET_ENTRIES, GROUP_SHINGLES, PAIRS_UP_TO = 500_000, 500_000, 24
#: One in so many tiles is looked at before the others. Bits of a signature for each shingle: with few, unrelated
#: sets that share a tile would pass the bound and candidate groups would run together.
EARLY, BITS = 16, 4
#: Classes of a size band of a large group that all its slices are compared with.
PIVOTS = 8
_NO_ID = -(1 << 63)  # stands for a null doc_id within


class Bands:
    """Size bands of a threshold num / den, each with its number of parts."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold lies in (0, 1]")
        self.num, self.den = num, den
        self.low, self.parts, self.weak, self.spare = [1], [], [], []

    def reach(self, size: int) -> int:
        """Largest set that a set of this size can be linked with."""
        return size * self.den // self.num

    def differing(self, size: int) -> int:
        """Most shingles in which a set of this size differs from a linked set that is no smaller."""
        return size * (self.den - self.num) // self.num

    def upto(self, size: int) -> None:
        """Makes bands for sets of up to this size."""
        while self.low[-1] <= size:
            a = self.low[-1]
            b = max(a + 1, a * self.den * self.den // (self.num * self.num))
            d = self.differing(b - 1)
            # Parts with few shingles would bring unrelated sets together. With e parts more than
            # needed, e + 1 parts are the same, so sets with at most e such parts can leave them out.
            weak, spare = 0, 0
            for w in (2, 1):
                for e in range(d + 9):
                    rate = a / (d + 1 + e)
                    mean = (d + 1 + e) * math.exp(-rate) * (1 + rate if w == 2 else 1)
                    if e >= mean + 3 * math.sqrt(mean):
                        weak, spare = w, e
                        break
                if weak:
                    break
            self.low.append(b)
            self.parts.append(d + 1 + spare)
            self.weak.append(weak)
            self.spare.append(spare)

    def of(self, size: int) -> list[int]:
        """Bands whose range a set of this size lies in: its own, and lower ones whose sets reach it."""
        self.upto(size)
        own = int(np.searchsorted(self.low, size, "right")) - 1
        out = [own]
        while own and self.reach(self.low[own] - 1) >= size:
            own -= 1
            out.append(own)
        # A band in which no shingle may differ holds only equal sets, which are one class already.
        return [j for j in out if self.differing(self.low[j + 1] - 1)]


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles; with fewer words, one of the whole sequence."""
    _, _, row, hashes = tx.words(data, starts, True)
    first = np.searchsorted(row, np.arange(len(starts)))
    grams = tx.sequences(hashes, k)
    out = []
    for i in range(len(starts) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = tx.sequences(hashes[a:b], b - a)
            out.append(tx.mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    """A class's number: a hash of the set, as a signed long."""
    with np.errstate(over="ignore"):
        h = tx.mix(np.array([tx.mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(h.view(np.int64)[0])


def width_of(size: int) -> int:
    """64-bit words of a signature: a power of two, BITS bits or more for each shingle."""
    return 1 << max(0, (BITS * size - 1) // 64).bit_length()


def signature(s: np.ndarray) -> np.ndarray:
    w = width_of(len(s))
    bits = np.zeros(w * 64, np.uint8)
    bits[(tx.mix(s) % np.uint64(w * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def tile_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles that a set lies in."""
    out = []
    for j in bands.of(len(s)):
        k = bands.parts[j]
        part = (s % np.uint64(k)).astype(np.int64)
        count = np.bincount(part, minlength=k)
        total = np.zeros(k, np.uint64)
        np.add.at(total, part, tx.mix(s ^ np.uint64(0x5BD1E995)))
        key = tx.mix(total + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64)) + (np.arange(k, dtype=np.uint64) << np.uint64(32)))
        strong = count >= bands.weak[j]
        out.append(key if k - strong.sum() > bands.spare[j] else key[strong])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets_of(batch: pa.RecordBatch, k: int):
    data, starts = tx.texts(batch.column(1))
    for a, b in tx.chunks(starts):
        sets = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], k)
        yield from zip(range(a, b), sets)


def _describe(k: int):
    """doc_id, set size, class and signature of each document."""

    def run(batches):
        for batch in batches:
            n, cls, sig = [], [], []
            for _, s in _sets_of(batch, k):
                n.append(len(s))
                cls.append(set_hash(s))
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "cls", "sig"])
        tidy()

    return run


def _emit_tiles(k: int, num: int, den: int, buckets: int):
    """Blobs of (key, class) for each bucket of keys; a class once for each partition."""

    def run(batches):
        bands, seen = Bands(num, den), set()
        keys, owner, classes, held = [], [], [], 0
        for batch in batches:
            for _, s in _sets_of(batch, k):
                if not len(s) or (c := set_hash(s)) in seen:
                    continue
                seen.add(c)
                found = tile_keys(s, bands)
                keys.append(found)
                owner.append(np.full(len(found), len(classes), np.uint32))
                classes.append(c)
                held += len(found)
                if held > 1_000_000:
                    yield from _blobs(keys, owner, classes, buckets)
                    keys, owner, classes, held = [], [], [], 0
        if held:
            yield from _blobs(keys, owner, classes, buckets)
        tidy()

    return run


def _blobs(keys, owner, classes, buckets):
    key, own, cls = np.concatenate(keys), np.concatenate(owner), np.array(classes, np.int64)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    # Within a bucket 32 more bits of the key do: keys that agree by chance only make a tile larger.
    short = (key >> np.uint64(32)).astype(np.uint32)
    rows = []
    for b in range(buckets):
        pick = order[edges[b] : edges[b + 1]]
        if len(pick):
            # Keys of a class follow each other: its number goes once, with how many keys it has here.
            head = np.flatnonzero(np.concatenate([[True], np.diff(own[pick]) != 0]))
            rows.append((b, short[pick].tobytes(), np.diff(np.append(head, len(pick))).astype(np.uint32).tobytes(), cls[own[pick[head]]].tobytes()))
    for a in range(0, len(rows), 64):
        part = list(zip(*rows[a : a + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *[pa.array(c, pa.binary()) for c in part[1:]]], ["bucket", "k", "o", "c"])


def _join_tiles(table: pa.Table) -> pa.Table:
    """(tile, cls) of a bucket's tiles with two classes or more; tiles of the same classes are one."""
    tidy()
    keys, classes = [], []
    for key, count, cls in zip(*(table.column(c).to_pylist() for c in ("k", "o", "c"))):
        keys.append(np.frombuffer(key, np.uint32))
        classes.append(np.repeat(np.frombuffer(cls, np.int64), np.frombuffer(count, np.uint32)))
    key, cls = np.concatenate(keys), np.concatenate(classes)
    order = np.argsort(cls, kind="stable")
    key, cls = key[order], cls[order]
    order = np.argsort(key, kind="stable")
    key, cls = key[order], cls[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[fresh], cls[fresh]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    with np.errstate(over="ignore"):
        name = tx.mix(np.add.reduceat(tx.mix(cls.view(np.uint64)), start) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    _, once = np.unique(name, return_index=True)
    once = once[size[once] > 1]
    pick = np.concatenate([np.arange(s, s + n) for s, n in zip(start[once], size[once])]) if len(once) else np.zeros(0, np.int64)
    return pa.table({"tile": pa.array(np.repeat(name[once].view(np.int64), size[once])), "cls": pa.array(cls[pick])})


def _folded(sigs: list[np.ndarray], w: int) -> np.ndarray:
    """Signatures as rows of w words: wider ones are folded, which is what they would be at that width."""
    out = np.zeros((len(sigs), w), np.uint64)
    for i, s in enumerate(sigs):
        out[i] = np.bitwise_or.reduce(s.reshape(-1, w), axis=0)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _tile_edges(n: np.ndarray, sigs: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges of a tile, as places in it."""
    rows = _folded(sigs, min(len(s) for s in sigs))
    m = len(n)
    if m <= PAIRS_UP_TO:
        i, j = np.triu_indices(m, 1)
        apart = _apart(rows[i], rows[j])
        # overlap <= (n_i + n_j - apart) / 2, and linked means overlap * (den + num) >= num * (n_i + n_j)
        ok = ((n[i] + n[j] - apart) * (den + num) >= 2 * num * (n[i] + n[j])) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
        return i[ok], j[ok]
    d = int(n.max()) * (den - num) // num
    pool, out = np.arange(m), []
    while len(pool):
        p = pool[0]
        apart = _apart(rows, rows[p])
        near = np.flatnonzero(apart <= 2 * d)
        out.append(np.stack([np.full(len(near), p), near]))
        pool = pool[apart[pool] > d]
    a, b = np.concatenate(out, axis=1)
    return a[a != b], b[a != b]


def _candidates(num: int, den: int):
    """Edges (a, b) that connect the groups of classes with candidate edges in tiles (tile, cls, grp, n, sig)."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        tile, cls, grp, n = (table.column(c).to_numpy() for c in ("tile", "cls", "grp", "n"))
        order = np.lexsort((cls, tile))
        tile, cls, grp, n = tile[order], cls[order], grp[order], n[order]
        sigs = [np.frombuffer(x, np.uint64) for x in table.column("sig").take(pa.array(order)).to_pylist()]
        fresh = np.ones(len(tile), bool)
        fresh[1:] = (tile[1:] != tile[:-1]) | (cls[1:] != cls[:-1])
        keep = np.flatnonzero(fresh)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(tile[keep]) != 0, [True]]))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1:
                at = keep[s:e]
                a, b = _tile_edges(n[at], [sigs[x] for x in at], num, den)
                a, b = grp[at[a]], grp[at[b]]
                found_a.append(a[a != b])
                found_b.append(b[a != b])
        # Only what connects groups is needed of the task's edges: a forest, of fewer edges than groups.
        nodes, low = roots(np.concatenate(found_a), np.concatenate(found_b))
        keep = nodes != low
        return pa.table({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(low[keep], pa.int64())})

    return run


def link_sets(sets: list[np.ndarray], num: int, den: int, apart: np.ndarray | None = None, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect whatever links of Jaccard num / den or more connect among the sets.

    apart: a side for each set; pairs within side 1, or within side 2, are left to other calls.
    joined: a number for each set; sets of the same number are known to be connected.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, sets = n[order], [sets[i] for i in order]
    side = apart[order] if apart is not None else np.zeros(len(n), int)
    group = np.unique(joined[order], return_inverse=True)[1] if joined is not None else np.arange(len(n))
    sigs = _folded([signature(s) for s in sets], min(width_of(int(x)) for x in n)) if len(n) else None
    edges = []
    for i in range(len(n)):
        low = int(np.searchsorted(n[:i], -(-n[i] * num // den), "left"))
        other = np.arange(low, i)
        other = other[(group[other] != group[i]) & ((side[other] != side[i]) | (side[i] == 0))]
        if not len(other):
            continue
        bound = (n[other] + n[i] - _apart(sigs[other], sigs[i])) // 2
        need = -(-num * (n[other] + n[i]) // (den + num))
        other, slack = other[bound >= need], (bound - need)[bound >= need]
        other = other[np.argsort(-slack, kind="stable")]
        while len(other):
            now, other = other[:16], other[16:]
            # Intersection of sorted arrays: places of all their items in the sorted array of this set.
            items = np.concatenate([sets[j] for j in now])
            same = sets[i][np.minimum(np.searchsorted(sets[i], items), n[i] - 1)] == items
            overlap = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(n[now])[:-1]]))
            for j in now[overlap * den >= num * (n[now] + n[i] - overlap)]:
                if group[j] != group[i]:
                    edges.append((int(order[j]), int(order[i])))
                    group[group == group[j]] = group[i]
            other = other[group[other] != group[i]]
    return edges


def _link_group(k: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        tidy()
        table = table.combine_chunks().sort_by("part")  # one group after another, so that one is held at a time
        cls, part, side, comp = (table.column(c).to_numpy() for c in ("cls", "part", "side", "comp"))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0, [True]]))
        found = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            data, starts = tx.texts(table.column("text").slice(lo, hi - lo).combine_chunks())
            names, sets, sides, comps, seen = [], [], [], [], set()
            for a, b in tx.chunks(starts):
                for i, s in zip(range(a, b), shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], k)):
                    if len(s) and set_hash(s) == cls[lo + i] and cls[lo + i] not in seen:
                        seen.add(cls[lo + i])
                        names.append(int(cls[lo + i]))
                        sets.append(s)
                        sides.append(int(side[lo + i]))
                        comps.append(int(comp[lo + i]))
            if len(sets) > 1:
                found += [(names[x], names[y]) for x, y in link_sets(sets, num, den, np.array(sides), np.array(comps))]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(documents: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text).

    Two rows link when den * intersection >= num * union of their sets of shingle-word shingles
    (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words the whole sequence is one shingle.
    component_id is the smallest doc_id reachable by links, itself included. Null or empty text has
    size 0 and its own doc_id. Repeated rows count as copies; a null doc_id is the smallest only where
    all of a component's are null. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = select_as(documents, doc_id="long", text="string")
    described = materialize(docs.mapInArrow(_describe(shingle), "doc_id long, n long, cls long, sig binary"), "sets")
    # Whatever names a class goes by it alone: a class of a third of all rows is one row from here on.
    classes = materialize(described.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    rows = materialize(described.select("doc_id", "n", "cls"), "rows")
    discard(described)
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    per_shingle = 1.8 * (den - num) / num + 0.02
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles * per_shingle / BUCKET_ENTRIES))
    blobs = docs.mapInArrow(_emit_tiles(shingle, num, den, buckets), "bucket int, k binary, o binary, c binary")
    tiles = materialize(blobs.groupBy("bucket").applyInArrow(_join_tiles, "tile long, cls long").distinct(), "tiles")

    def candidates(rows: DataFrame) -> DataFrame:
        full = rows.join(classes.select("cls", "n", "sig"), "cls").withColumn("bin", F.pmod(F.xxhash64("tile"), F.lit(buckets)))
        return full.groupBy("bin").applyInArrow(_candidates(num, den), "a long, b long")

    # A few of the tiles connect most of a large group; the other tiles matter only where they hold
    # classes that aren't connected by then, and only for the edges between these.
    early = F.pmod(F.col("tile"), F.lit(EARLY)) == 0
    before = connected_components(candidates(tiles.where(early).withColumn("grp", F.col("cls"))), "early", forests=True)
    before = materialize(before.select(F.col("node").alias("cls"), F.col("comp").alias("grp")), "early")
    late = tiles.where(~early).join(before, "cls", "left").select("tile", "cls", F.coalesce("grp", "cls").alias("grp"))
    open_ = late.groupBy("tile").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("tile")
    cross = materialize(connected_components(candidates(late.join(open_, "tile")), "groups", forests=True), "cross")
    known = before.union(cross.select(F.col("node").alias("cls"), F.col("node").alias("grp"))).distinct()
    groups = known.join(cross.select(F.col("node").alias("grp"), "comp"), "grp", "left").select("cls", F.coalesce("comp", "grp").alias("grp"))
    groups = materialize(groups.join(classes.select("cls", "rep", "n"), "cls"), "grp")
    names = materialize(classes.select("cls", "rep"), "names")
    for done in (tiles, before, cross, classes):
        discard(done)

    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep"), "text")

    def links(parts: DataFrame) -> DataFrame:
        """Links found within the parts (cls, rep, part, side, comp, n)."""
        compared = parts.agg(F.sum("n")).first()[0] or 0
        bins = F.lit(max(buckets, math.ceil(compared / GROUP_SHINGLES)))
        parts = parts.select("cls", F.coalesce("rep", F.lit(_NO_ID)).alias("rep"), "part", "side", "comp", F.pmod(F.xxhash64("part", F.lit(1)), bins).alias("bin"))
        wanted = sieve(parts.select(F.col("rep").alias("key")), parts.count())
        parts = parts.join(texts.where(wanted(F.col("rep"))), "rep").select("bin", "part", "side", "comp", "cls", "text")
        return parts.groupBy("bin").applyInArrow(_link_group(shingle, num, den), "a long, b long")

    members = materialize(with_least(groups, "grp", F.sum("n"), "total"), "members")
    discard(groups)
    small = members.where(F.col("total") <= GROUP_SHINGLES).select("cls", "rep", F.col("grp").alias("part"), F.lit(0).alias("side"), F.col("cls").alias("comp"), "n")
    large = members.where(F.col("total") > GROUP_SHINGLES).select("cls", "rep", "grp", "n")
    found = links(small)
    if not large.isEmpty():
        large = materialize(large, "large")
        first = materialize(links(_slices(large, num, den)), "first")
        comps = connected_components(first, "slices", forests=True).select(F.col("node").alias("cls"), "comp")
        placed = materialize(large.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "placed")
        found = found.union(first).union(links(_blocks(placed, num, den)))
    comps = materialize(connected_components(found, "links", forests=True).join(names.select(F.col("cls").alias("node"), "rep"), "node"), "comps")
    comps = with_least(comps, "comp", F.min("rep"), "low")
    low = names.join(comps.select(F.col("node").alias("cls"), "low"), "cls", "left").select("cls", F.coalesce("low", "rep").alias("low"))
    low = materialize(low, "low")  # so that the join with rows is a plain one, of which Spark splits a class of many copies
    discard(names)
    return rows.join(low, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _band(num: int, den: int):
    """Number of a range of sizes: two linked sets lie in the same range or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("long") if num < den else F.col("n")


def _slices(members: DataFrame, num: int, den: int) -> DataFrame:
    """Parts of the groups that are too large for one task: slices by size and hash, each with the pivots of its range and the next."""
    half = GROUP_SHINGLES // 2
    rows = members.withColumn("band", _band(num, den)).withColumn("spot", F.xxhash64("cls", F.lit(3)))
    heads = rows.groupBy("grp", "band").agg(F.ceil(F.sum("n") / half).cast("long").alias("slices"))
    # Pivots are the least by hash of PIVOTS shares of a range: no task sorts a whole group for them.
    share = F.pmod(F.col("spot"), F.lit(PIVOTS))
    pivots = rows.groupBy("grp", "band", share.alias("k")).agg(F.min_by(F.struct("cls", "rep", "n"), "spot").alias("p"))
    slices = rows.join(heads, ["grp", "band"]).select("cls", "rep", "n", F.xxhash64("grp", "band", F.pmod("spot", "slices")).alias("part"))
    spread = heads.select("grp", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    own = spread.withColumn("part", F.xxhash64("grp", "band", "slice"))
    led = own.join(pivots, ["grp", "band"]).unionByName(own.withColumn("band", F.col("band") + 1).join(pivots, ["grp", "band"]))
    led = led.select("p.cls", "p.rep", "p.n", "part")
    out = slices.unionByName(led).distinct()
    return out.select("cls", "rep", "part", F.lit(0).alias("side"), F.col("cls").alias("comp"), "n")


def _blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """Blocks of large groups (cls, rep, grp, n, comp), where comp is what slices have connected.

    A block is a range of sizes and a slice of it by hash, of the group's largest comp or of the others;
    each pair of blocks within reach is a part, but for two of the largest comp, which is connected
    already. A block with itself is a part of side 0; two blocks are sides 1 and 2 of a part.
    """
    half = GROUP_SHINGLES // 2
    sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("held"))
    most = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("held", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    rows = members.join(most, "grp").withColumn("rest", (F.col("comp") != F.col("most")).cast("int")).withColumn("band", _band(num, den))
    cells = rows.groupBy("grp", "band", "rest").agg(F.ceil(F.sum("n") / half).cast("long").alias("slices"))
    rows = rows.join(cells, ["grp", "band", "rest"]).withColumn("slice", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("slices")))
    near = [cells.select("grp", (F.col("band") - step).alias("band"), F.struct(F.col("rest").alias("rest"), F.lit(step).alias("step"), F.col("slices").alias("slices")).alias("cell")) for step in (-1, 0, 1)]
    near = near[0].union(near[1]).union(near[2]).groupBy("grp", "band").agg(F.collect_list("cell").alias("cells"))  # six at most
    rows = rows.join(near, ["grp", "band"])
    mine = F.struct(F.col("band").alias("band"), F.col("rest").alias("rest"), F.col("slice").alias("slice"))

    def parts(cell):
        def part(s):
            other = F.struct((F.col("band") + cell["step"]).alias("band"), cell["rest"].alias("rest"), s.alias("slice"))
            side = F.when(other == mine, 0).when(mine < other, 1).otherwise(2)
            return F.struct(F.least(mine, other).alias("x"), F.greatest(mine, other).alias("y"), side.alias("side"))

        return F.transform(F.sequence(F.lit(0).cast("long"), cell["slices"] - 1), part)

    wanted = F.filter("cells", lambda c: (c["rest"] == 1) | (F.col("rest") == 1))
    out = rows.withColumn("p", F.explode(F.flatten(F.transform(wanted, parts))))
    return out.select("cls", "rep", F.xxhash64("grp", "p.x", "p.y").alias("part"), F.col("p.side").alias("side"), "comp", "n")


def keep_one(documents: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents without those whose component has a smaller doc_id; of rows with the same doc_id, all stay.

    Rows without text, and rows without doc_id, stay. All columns are as they were.
    """
    found = jaccard_components(documents, shingle, num, den)
    gone = materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    # Only rows that may go are exchanged; the others stay where they are.
    doubtful = sieve(gone.select(F.col("_gone").alias("key")), gone.count())(documents["doc_id"].cast("long"))
    stay = documents.where(documents["doc_id"].isNull() | ~doubtful)
    rest = documents.where(documents["doc_id"].isNotNull() & doubtful)
    return stay.union(rest.join(gone, rest["doc_id"].cast("long") == gone["_gone"], "left_anti"))
