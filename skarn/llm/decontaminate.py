"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Shared random walks (the CGK embedding) start at every character of the documents and of the items,
and bytes sampled from a walk are a key. An edited copy of an item has walks that no edit touches, so
it shares keys with the item wherever its edits lie; how long walks may be, so that copies with the full
share of edits are found at the recall asked for, is measured by the length of items. Items too short for
that are cut into one piece more than they may have edits, one of which is intact. A part of the item
around the key must then be within reach, and edit distance decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import select_as, small_batches

#: Share of an item's characters that edits may take; recall that keys are to reach with that many edits.
EDIT_SHARE, RECALL = 0.2, 0.99
#: Steps of the walks, longest first; lengths of items and copies of each that recall is measured on.
STEPS, LENGTHS, COPIES = (24, 22, 20, 18, 16, 14, 12), range(40, 401, 20), 400
#: Characters of a part, further share of its characters that it may have edited, and places of a part that are looked at together.
PART, PART_SHARE, NEAR = 64, 0.1, 16
#: Items of fewer words are sought as whole words. Characters of items that one pass over the documents takes.
WHOLE_WORDS, ITEM_CHARS = 3, 1 << 24
_OUT = "doc_id long, item_id long, start_char long, end_char long, edits int, similarity double"


def normal(text: str) -> str:
    """A-Z lower-cased, words joined by one space."""
    return b" ".join(text.encode().translate(bytes(tx.LOWER)).split()).decode("utf-8", "replace")


def letters(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a byte for each character, its place in data) of texts with A-Z lower-cased and white space as one space.

    Equal characters have equal bytes; different ones beyond ASCII may, which only adds candidates.
    """
    low = tx.LOWER[data]
    blank = tx._WS[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[starts[:-1][starts[:-1] < len(data)]] = True
    at = np.flatnonzero(((data & 0xC0) != 0x80) & ~(blank & before))
    out = low[at].copy()
    out[blank[at]] = 32
    wide = np.flatnonzero(out >= 128)
    if len(wide):
        more = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        b0, b1, b2 = (more[at[wide] + i] for i in range(3))
        out[wide] = 128 + ((b0 * 37 + b1 + np.where(b0 >= 0xE0, b2 * 11, 0)) & 127)
    return out, at


def _walk() -> np.ndarray:
    """The shared random walk, two steps at a time: for each pair of steps and pair of bytes (here and next), the
    bytes that the walk reads, and how far it moves on, as moves << 16 | first << 8 | second."""
    made = getattr(_walk, "made", None)
    if made is None:
        moves = np.random.default_rng(11).integers(0, 2, (STEPS[0], 256), dtype=np.uint32)
        here, after = np.divmod(np.arange(1 << 16, dtype=np.uint32), np.uint32(256))
        tables = []
        for n in range(0, STEPS[0], 2):
            second = np.where(moves[n][here] == 1, after, here)
            tables.append((moves[n][here] + moves[n + 1][second]) << 16 | here << 8 | second)
        made = _walk.made = np.array(tables, np.uint32)
    return made


def _walks(chars: np.ndarray, wanted: tuple[int, ...]):
    """(steps, first character, keys) of the walks of so many steps from each character on, block by block; 0s follow the last one."""
    data = np.concatenate([chars, np.zeros(max(wanted) + 2, np.uint8)]).astype(np.uint16)
    pairs, walk = data[:-1] << 8 | data[1:], _walk()
    for a in range(0, len(chars), 1 << 14):  # what a core's cache holds
        b = min(len(chars), a + (1 << 14))
        part, at, key = pairs[a : b + max(wanted) + 1], np.arange(b - a), np.zeros(b - a, np.uint64)
        for n in range(max(wanted) // 2):
            read = walk[n].take(part.take(at, mode="clip"), mode="clip")
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += read
            at += read >> 16
            if 2 * n + 2 in wanted:
                yield 2 * n + 2, a, key ^ (key >> np.uint64(31))


def keys_of(chars: np.ndarray, wanted: tuple[int, ...] = STEPS) -> dict[int, np.ndarray]:
    """Steps (even numbers) -> key of the walk of so many steps from each character on."""
    out = {s: np.zeros(len(chars), np.uint64) for s in wanted}
    for s, a, keys in _walks(chars, wanted):
        out[s][a : a + len(keys)] = keys
    return out


def edited(chars: np.ndarray, n: int, rng) -> np.ndarray:
    """chars after n edits at random: characters replaced, put in or taken out."""
    raw = bytearray(chars.tobytes())
    for where, how, what in rng.random((n, 3)).tolist():
        at, kind = int(where * len(raw)), int(how * 3)
        raw[at : at + (kind != 1)] = bytes([97 + int(what * 26)]) if kind != 2 else b""
    return np.frombuffer(bytes(raw), np.uint8)


def _apart(texts) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """(keys of all walks of texts, each text followed by 0s; the text's number and the place in it of each key)."""
    room = [len(t) + STEPS[0] + 2 for t in texts]
    data = np.concatenate([np.pad(t, (0, n - len(t))) for t, n in zip(texts, room)])
    copy, at = np.repeat(np.arange(len(texts)), room), np.concatenate([np.arange(n) for n in room])
    inside = at < np.repeat([len(t) for t in texts], room)
    return {s: k[inside] for s, k in keys_of(data).items()}, copy[inside], at[inside]


def _of_copy(keys: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """Keys that are equal only within a copy."""
    return (keys ^ copy.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ (copy.astype(np.uint64) << np.uint64(40))


def _held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where keys are that are among others."""
    marks = np.zeros(1 << 20, bool)
    marks[among >> np.uint64(44)] = True
    at, values = np.flatnonzero(marks[keys >> np.uint64(44)]), np.sort(among)
    return at[values[np.minimum(np.searchsorted(values, keys[at]), len(values) - 1)] == keys[at]]


def least_lengths(texts: list[np.ndarray], share: float, recall: float) -> dict[int, int]:
    """Steps -> characters that an item needs so that copies with the full share of edits have a key of it, at this recall."""
    rng, out, failed = np.random.default_rng(17), {}, set()
    for size in reversed(LENGTHS):
        long = [t for t in texts if len(t) >= size]
        if not long:
            continue
        pairs = []
        for _ in range(COPIES):
            t = long[int(rng.integers(0, len(long)))]
            at = int(rng.integers(0, len(t) - size + 1))
            t = t[at : at + size]
            pairs.append((t, edited(t, int(share * size), rng)))
        (a, a_copy, a_at), (b, b_copy, _) = (_apart(x) for x in zip(*pairs))
        found = {}
        for s in STEPS:
            whole = a_at < size - s
            found[s] = len(np.unique(a_copy[whole][_held(_of_copy(a[s], a_copy)[whole], _of_copy(b[s], b_copy))]))
        for s in STEPS:  # all lengths from there on must reach it
            if found[s] >= recall * COPIES and s not in failed:
                out[s] = size
            else:
                failed.add(s)
    return out


def least_edits(pattern: str, text: str) -> int:
    """Least edits that turn pattern into a part of text."""
    return best_end(pattern, text)[0]


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """(least edits that turn pattern into a part of text, where the first such part ends), by Myers' bit vectors."""
    m, end = len(pattern), 0
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for n, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, n
    return best, end


def within(masks: np.ndarray, size: np.ndarray, limit: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a part of each row of text is within limit edits of its pattern of up to 64 characters (masks by byte)."""
    one, flat, at = np.uint64(1), np.ascontiguousarray(masks).reshape(-1), np.arange(len(text)) * masks.shape[1]
    plus, minus = np.full(len(text), ~np.uint64(0)), np.zeros(len(text), np.uint64)
    high, score = (size - 1).astype(np.uint64), size.astype(np.int64)
    best = score.copy()
    for c in np.ascontiguousarray(text.T):
        eq = flat.take(at + c)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += ((ph >> high) & one).view(np.int64)
        score -= ((mh >> high) & one).view(np.int64)
        ph <<= one
        mh <<= one
        plus, minus = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best <= limit


class Items:
    """What a pass needs of its benchmark items: keys of walks or pieces, and parts to look at around them."""

    def __init__(self, items: list[tuple[int | None, str]], share: float = EDIT_SHARE, recall: float = RECALL):
        kept = [(i, normal(t)) for i, t in items]
        self.ids, self.texts = [i for i, t in kept if t], [t for _, t in kept if t]
        self.share, self.limits = share, [int(share * len(t)) for t in self.texts]
        raw = [np.frombuffer(t.encode(), np.uint8) for t in self.texts]
        chars = [letters(r, np.array([0, len(r)]))[0] for r in raw]
        lengths = least_lengths(chars, share, recall)
        seeds: dict[tuple[bool, int], list] = {}
        parts: list[tuple[int, np.ndarray]] = []
        self.item, self.begin = [], []
        for k, c in enumerate(chars):
            # Parts are even and at most PART long; a part of an item within its limit is within PART_SHARE more.
            edge = np.linspace(0, len(c), -(-len(c) // PART) + 1).astype(np.int64)
            first = len(parts)
            parts += [c[x:y] for x, y in zip(edge, edge[1:])]
            self.item += [k] * (len(edge) - 1)
            self.begin += edge[:-1].tolist()
            steps = next((s for s in STEPS if len(c) >= lengths.get(s, len(c) + 1)), None)
            if steps:
                keys = keys_of(c, (steps,))[steps][: max(1, len(c) - steps + 1)]
                at = np.arange(len(keys))
            else:  # some part has no more than its share of edits, and then one of its pieces is intact
                cut = [np.linspace(x, y, int(share * (y - x)) + 2).astype(np.int64) for x, y in zip(edge, edge[1:])]
                steps = -int(min(np.diff(x).min() for x in cut))
                at = np.concatenate([x[:-1] for x in cut])
                keys = tx.sequences(c.astype(np.uint64), -steps)[at]
            part = first + np.searchsorted(edge, at, "right") - 1
            seeds.setdefault(steps, []).append((keys, part, at - edge[part - first]))
        self.item, self.begin = np.array(self.item, np.int64), np.array(self.begin, np.int64)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.allowed = ((share + PART_SHARE) * self.size).astype(np.int64) + 1
        # Bits of the places of each byte in each part; only bytes that items have get columns.
        used = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint8)
        self.column = np.zeros(256, np.int64)
        self.column[used] = 1 + np.arange(len(used))
        self.masks = np.zeros((len(parts), len(used) + 1), np.uint64)
        for n, p in enumerate(parts):
            np.bitwise_or.at(self.masks[n], self.column[p], np.uint64(1) << np.arange(len(p), dtype=np.uint64))
        self.tables = {}
        for steps, found in seeds.items():
            keys, part, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            marks = np.zeros(1 << 18, bool)
            marks[keys >> np.uint64(46)] = True
            self.tables[steps] = (keys[order], part[order], at[order], marks)

    def places(self, chars: np.ndarray) -> np.ndarray:
        """(item, first character about where it would start) of every place that a key and the part around it show."""
        walks, groups = tuple(s for s in self.tables if s > 0), []

        def seek(steps, base, seen):
            values, part, at, marks = self.tables[steps]
            hit = np.flatnonzero(marks.take((seen >> np.uint64(46)).astype(np.int64)))
            low = np.searchsorted(values, seen[hit])
            same = values[np.minimum(low, len(values) - 1)] == seen[hit]
            hit, low = hit[same], low[same]
            n = np.searchsorted(values, seen[hit], "right") - low
            for a, b in _even(n, 1 << 20):
                m = n[a:b]
                s = np.repeat(low[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                start = (np.repeat(base + hit[a:b], m) - at[s] + PART) // NEAR
                groups.append(np.unique(part[s] << 32 | start))

        for steps, base, seen in _walks(chars, walks) if walks else ():
            seek(steps, base, seen)
        for steps in self.tables:
            if steps < 0:
                seek(steps, 0, tx.sequences(chars.astype(np.uint64), -steps))
        groups = np.unique(np.concatenate(groups)) if groups else np.zeros(0, np.int64)
        part, start = groups >> 32, (groups & 0xFFFFFFFF) * NEAR - PART
        around = int((self.share + PART_SHARE) * PART) + 2
        data = np.concatenate([np.zeros(PART + around, np.int64), self.column[chars], np.zeros(2 * (PART + around) + NEAR, np.int64)])
        ok = np.zeros(len(part), bool)
        for a in range(0, len(part), 4096):
            p = part[a : a + 4096]
            window = data[(start[a : a + 4096] + PART)[:, None] + np.arange(PART + 2 * around + NEAR)]
            ok[a : a + 4096] = within(self.masks[p], self.size[p], self.allowed[p], window)
        return np.unique(np.stack([self.item[part[ok]], start[ok] - self.begin[part[ok]]], axis=1), axis=0)


def _even(n: np.ndarray, size: int):
    """Ranges of n whose sums are about size."""
    total, a = np.concatenate([[0], np.cumsum(n)]), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, total[a] + size, "right")) - 1)
        yield a, b
        a = b


def _hits(items: Items, batch: pa.RecordBatch):
    """A row of find_leaks() for each document of the batch (ids, texts) and item that it holds."""
    ids, column = batch.column(0), batch.column(1)
    data, starts = tx.texts(column)
    for a, b in tx.chunks(starts):
        part, local = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        chars, at = letters(part, local)
        first = np.searchsorted(at, local)  # characters before each row
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        _verify(items, part, at, first, items.places(chars), best)
        count = np.cumsum((part & 0xC0) != 0x80)  # characters up to each byte
        for (r, k), (edits, x, y) in sorted(best.items()):
            lead = count[local[r]] - 1
            yield ids[a + r].as_py(), items.ids[k], int(count[at[x]] - 1 - lead), int(count[at[y - 1]] - lead), edits, 1 - edits / len(items.texts[k])


def _verify(items: Items, part, at, first, places, best) -> None:
    """Puts (edits, first character, end) of the best span of each (row, item) into best."""
    ends = np.append(at, len(part))

    def text_of(i, j):
        raw = part[ends[i] : ends[j]].tobytes().translate(bytes(tx.LOWER))
        return re.sub(rb"[\x20\x09-\x0D]+", b" ", raw).decode("utf-8", "replace")[: j - i]

    done: dict[tuple[int, int], int] = {}  # up to where a row was searched for an item
    for k, s in places.tolist():
        size, limit = len(items.texts[k]), items.limits[k]
        slack = limit + int(PART_SHARE * size) + NEAR + PART
        r, last = (int(np.searchsorted(first, min(max(x, 0), first[-1] - 1), "right")) - 1 for x in (s - slack, s + size + slack))
        for r in range(r, last + 1):
            i, j = max(int(first[r]), s - slack), min(int(first[r + 1]), s + size + slack)
            if i >= j or best.get((r, k), (1,))[0] == 0 or j <= done.get((r, k), -1):
                continue
            done[r, k] = j
            pad = " " if items.texts[k].count(" ") < WHOLE_WORDS - 1 else ""
            lead = pad if i == first[r] else ""
            pattern, text = pad + items.texts[k] + pad, lead + text_of(i, j) + (pad if j == first[r + 1] else "")
            edits, end = best_end(pattern, text)
            if edits > limit or (r, k) in best and edits >= best[r, k][0]:
                continue
            start = end - best_end(pattern[::-1], text[:end][::-1])[1]
            x = i - len(lead) + start + len(text[start:end]) - len(text[start:end].lstrip(" "))
            best[r, k] = (edits, x, x + len(text[start:end].strip(" ")))


def _passes(benchmark: DataFrame, share: float, recall: float):
    """Items for one pass over the documents each: parts of about ITEM_CHARS characters, by hash."""
    spark = benchmark.sparkSession
    items = select_as(benchmark, item_id="long", text="string").where("text is not null")
    parts = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS)
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        rows = sorted(((r["item_id"], r["text"]) for r in chosen), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast(Items(rows, share, recall))


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits, similarity): documents that hold a benchmark item, or most of it.

    An item counts as held if at most share of its characters need editing to find it in the document,
    A-Z in either case and any white space alike; the span is the part that shows it with the fewest
    edits, the first of these. One row for each document row and item; repeated items have rows each.
    Items without words, null items and null texts have no hits, null ids stay null; empty tables give
    an empty result. Items of fewer than three words are sought as whole words. Items go to the
    workers in parts of ITEM_CHARS characters at most, with a pass over documents for each.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = select_as(documents, doc_id="long", text="string").where("text is not null")
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])
    out = None
    for sent in _passes(benchmark, share, recall):

        def run(batches, sent=sent):
            for batch in batches:
                rows = list(_hits(sent.value, batch))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

        hits = docs.mapInArrow(run, _OUT)
        out = hits if out is None else out.union(hits)
    return spark.createDataFrame([], _OUT) if out is None else out


def remove_leaks(documents: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, recall: float = RECALL) -> DataFrame:
    """documents without those that hold a benchmark item; all columns as they were, null texts stay."""
    small_batches(documents.sparkSession)
    out = documents
    for sent in _passes(benchmark, share, recall):

        def run(batches, sent=sent):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                bad = {r[0] for r in _hits(sent.value, pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts], ["i", "text"]))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
