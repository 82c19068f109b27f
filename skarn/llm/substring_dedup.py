"""Substring dedup by level-wise doubling.

Level 1 looks at windows of half the length. A window that occurs once can't be part of a longer one
that occurs twice, so only windows repeated at this level are extended to twice the length, which is
the length asked for; more levels would only tell how long repeats are. Level 1 need not hold every
window: of the half-length windows inside each full one, that of least hash stands for it (the
leftmost of equal ones). Equal full windows have the same one at the same place, so a full window can
only repeat if its stand-in does.

Every shuffle is pre-aggregated where texts are read: a hash that occurs often in a partition leaves
it once, so a passage that a third of all documents hold is one row for each partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import materialize, select_as, small_batches

#: Window entries that one task groups, and that a partition holds before it sends them on.
BUCKET_ENTRIES, HELD = 2_000_000, 1_500_000
#: State of an entry: occurs once in its partition; stands for several there; is known to repeat.
ONE, MANY, KNOWN = 0, 1, 2


def stand_ins(hashes: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each full window, place of its stand-in, hashes of half-length windows), by word number."""
    half = window // 2
    short = tx.sequences(hashes, half)
    n = len(hashes) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, short
    span = window - half + 1
    least, place = short[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, span):
        better = short[k : k + n] < least
        least[better] = short[k : k + n][better]
        place[better] = k
    start = np.flatnonzero(row[:n] == row[window - 1 :])
    return start, start + place[start], short


def _chunks_of(batch: pa.RecordBatch, at: int):
    data, starts = tx.texts(batch.column(at))
    for a, b in tx.chunks(starts):
        local = starts[a : b + 1] - starts[a]
        begin, end, row, hashes = tx.words(data[starts[a] : starts[b]], local, False)
        yield a, b, np.searchsorted(row, np.arange(b - a + 1)), row, hashes


class _Outbox:
    """Entries (hash, doc, row hash, place) of a partition, sent as blobs by bucket."""

    def __init__(self, buckets: int, reduce):
        self.buckets, self.reduce, self.parts, self.held = buckets, reduce, [], 0

    def add(self, hashes, docs, rows, places):
        self.parts.append((hashes, docs, rows, places))
        self.held += len(hashes)
        if self.held > HELD:
            yield from self.flush()

    def flush(self):
        if self.held:
            h, d, r, p = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.held = [], 0
            state, keep = self.reduce(h, d, p)
            h, d, r, p = h[keep], d[keep], r[keep], p[keep]
            # What is known already goes by document, so that no bucket gets more of it than others.
            bucket = (np.where(state == KNOWN, tx.mix(d.view(np.uint64) + r.view(np.uint64)), h) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            out = []
            for b in range(self.buckets):
                pick = order[edges[b] : edges[b + 1]]
                if len(pick):
                    pairs = np.stack([d[pick], r[pick]], axis=1)
                    own = np.concatenate([[0], np.cumsum((pairs[1:] != pairs[:-1]).any(axis=1))])
                    heads = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                    out.append((b, h[pick].tobytes(), own.astype(np.uint32).tobytes(), pairs[heads].tobytes(), p[pick].astype(np.uint32).tobytes(), state[pick].astype(np.uint8).tobytes()))
            for a in range(0, len(out), 64):
                part = list(zip(*out[a : a + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *[pa.array(x, pa.binary()) for x in part[1:]]], list("bhorps"))


_BLOB = "b int, h binary, o binary, r binary, p binary, s binary"


def _opened(table: pa.Table):
    hs, ds, rs, ps, ss = [], [], [], [], []
    for h, o, r, p, s in zip(*(table.column(c).to_pylist() for c in "horps")):
        pairs = np.frombuffer(r, np.int64).reshape(-1, 2)[np.frombuffer(o, np.uint32)]
        hs.append(np.frombuffer(h, np.uint64))
        ds.append(pairs[:, 0])
        rs.append(pairs[:, 1])
        ps.append(np.frombuffer(p, np.uint32).astype(np.int64))
        ss.append(np.frombuffer(s, np.uint8))
    return tuple(map(np.concatenate, (hs, ds, rs, ps, ss)))


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, group number in that order, and first place of each group."""
    order = np.argsort(h, kind="stable")
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
    return order, np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def _reduce_repeats(h, d, p):
    """State and origin of entries to send: a hash seen twice repeats, so all its entries are known; one more tells the others."""
    order, group, first = _groups(h)
    count = np.bincount(group, minlength=len(first))
    state = np.full(len(h), ONE, np.uint8)
    state[order] = np.where(count[group] > 1, KNOWN, ONE)
    lead = order[first[count > 1]]
    state = np.concatenate([state, np.full(len(lead), MANY, np.uint8)])
    return state, np.concatenate([np.arange(len(h)), lead])


def _reduce_first(h, d, p):
    """Of a hash's entries in the partition, all but the first are removed whatever others hold."""
    order = np.lexsort((p, d, h))
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    lead = order[first][group]
    later = (d[order] != d[lead]) | (p[order] != p[lead])
    state = np.full(len(h), ONE, np.uint8)
    state[order[later]] = KNOWN
    return state, np.arange(len(h))


def _doc_arrays(batch, a, row):
    docs = batch.column(0).to_numpy(zero_copy_only=False)
    rows = batch.column(1).to_numpy(zero_copy_only=False)
    return docs[a + row], rows[a + row]


def _level_one(window: int, buckets: int):
    def run(batches):
        box = _Outbox(buckets, _reduce_repeats)
        for batch in batches:
            for a, b, first, row, hashes in _chunks_of(batch, 2):
                _, place, short = stand_ins(hashes, row, window)
                place = np.unique(place)
                d, r = _doc_arrays(batch, a, row[place])
                yield from box.add(short[place], d, r, place - first[row[place]])
        yield from box.flush()

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Entries of a bucket whose hash others share, or that are known to repeat."""
    h, d, r, p, s = _opened(table)
    asks = s != KNOWN
    order, group, first = _groups(h[asks])
    weight = np.bincount(group, weights=np.where(s[asks][order] == MANY, 2, 1), minlength=len(first))
    hit = np.zeros(asks.sum(), bool)
    hit[order] = weight[group] > 1
    keep = s == KNOWN
    keep[np.flatnonzero(asks)[hit & (s[asks] == ONE)]] = True
    return pa.table({"doc": pa.array(d[keep]), "row": pa.array(r[keep]), "place": pa.array(p[keep].astype(np.int32))})


def _level_two(window: int, buckets: int):
    """Full windows of the documents whose stand-ins repeat."""

    def run(batches):
        box = _Outbox(buckets, _reduce_first)
        for batch in batches:
            known = batch.column(3).to_pylist()
            for a, b, first, row, hashes in _chunks_of(batch, 2):
                start, place, _ = stand_ins(hashes, row, window)
                if not len(start):
                    continue
                marked = np.zeros(len(hashes), bool)
                for i in range(a, b):
                    if known[i]:
                        marked[first[i - a] + np.array(known[i])] = True
                start = start[marked[place]]
                d, r = _doc_arrays(batch, a, row[start])
                yield from box.add(tx.sequences(hashes, window)[start], d, r, start - first[row[start]])
        yield from box.flush()

    return run


def _removals(table: pa.Table) -> pa.Table:
    """Windows of a bucket that start earlier elsewhere, and those known to."""
    h, d, r, p, s = _opened(table)
    asks = np.flatnonzero(s != KNOWN)
    gone = s == KNOWN
    if len(asks):
        order = asks[np.lexsort((p[asks], d[asks], h[asks]))]
        fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        later = (d[order] != d[lead]) | (p[order] != p[lead])
        gone[order[later]] = True
    return pa.table({"doc": pa.array(d[gone]), "row": pa.array(r[gone]), "place": pa.array(p[gone].astype(np.int32))})


def _keep_words(window: int):
    def run(batches):
        for batch in batches:
            n, removed, digest = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ws = (text or "").encode().split()  # bytes.split() cuts at just these separators
                n.append(len(ws))
                if starts:
                    cover = np.zeros(len(ws) + 1, np.int64)
                    at = np.array(starts)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    keep = np.cumsum(cover)[:-1] == 0
                    ws = [w for w, k in zip(ws, keep) if k]
                removed.append(n[-1] - len(ws))
                digest.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_windows(documents: DataFrame, window: int = 20) -> DataFrame:
    """(doc, row, place): windows of window consecutive words that start earlier elsewhere.

    doc is doc_id (the largest long for null), row a hash of the text that tells rows with the same
    doc_id apart, place the number of the first word. Earlier means a smaller doc, or the same doc and
    a smaller place; rows that are equal in both are not earlier than each other.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = documents.sparkSession
    small_batches(spark)
    docs = _rows(documents)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # There is a stand-in for about every fifth word, and a word takes some six bytes.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * 5 * BUCKET_ENTRIES)))
    ones = docs.mapInArrow(_level_one(window, buckets), _BLOB)
    survivors = ones.groupBy("b").applyInArrow(_repeats, "doc long, row long, place int")
    places = survivors.groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    # All columns of docs, used or not: so this exchange of whole texts is the one that remove_repeats() needs too.
    full = docs.join(places, ["doc", "row"]).select("doc", "row", "text", "places", "doc_id")
    twos = full.mapInArrow(_level_two(window, buckets), _BLOB)
    return twos.groupBy("b").applyInArrow(_removals, "doc long, row long, place int")


def _rows(documents: DataFrame) -> DataFrame:
    docs = select_as(documents, doc_id="long", text="string")
    return docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def remove_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; words are [^\\x20\\x09-\\x0D]+ of its whole text.

    A word goes if a window of window words over it starts earlier elsewhere (see repeated_windows());
    windows are judged on the input. Null text has no words and counts as empty; a null doc_id comes
    after all others. Equal rows are no repeats of each other, as neither starts earlier. An empty
    table gives an empty result.
    """
    docs = _rows(documents)
    gone = repeated_windows(documents, window).groupBy("doc", "row").agg(F.collect_set("place").alias("starts"))
    joined = docs.join(gone, ["doc", "row"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_keep_words(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
