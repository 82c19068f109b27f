"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled into a minimal acyclic automaton whose arcs carry numbers:
their sum along a word is the word's place in a table of token ids. Equal suffixes share states. The
automaton is one file of flat arrays that every worker maps into memory. Words that it doesn't hold
are merged exactly as the tokenizer's merge ranks say, so ids never depend on the lexicon.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, select_as, small_batches, tidy
from .text import slices

#: Fixed value: how the byte-level tokenizer cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BETWEEN = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters of texts whose words are held at a time.
PIECE_CHARS = 1 << 20
#: Words of the lexicon, words longer than which none is frequent, and words that a worker remembers at most.
LEXICON_WORDS, LONGEST, REMEMBERED = 65_536, 64, 200_000


def _byte_chars() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Vocabulary and merges of a byte-level BPE file (a "tokenizers" JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        chars = _byte_chars()
        byte = {c: b for b, c in enumerate(chars)}
        vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take white space are not read")
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for t, i in [*vocab.items(), *((k.encode(), i) for k, i in self.special.items())]:
            self.bytes[i] = t
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = bytes(byte[c] for c in a), bytes(byte[c] for c in b)
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        pairs = sorted((k >> 32) * self.size + (k & 0xFFFFFFFF) for k in self.merges)
        self.pairs = np.array(pairs, np.int64)
        ranked = [self.merges[(k // self.size) << 32 | k % self.size] for k in pairs]
        self.pair_rank, self.rank_id = np.array([r for r, _ in ranked], np.int64), np.zeros(len(model["merges"]) + 1, np.int64)
        for r, i in ranked:
            self.rank_id[r] = i
        self.words = regex.compile(PATTERN).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def pieces(self, text: str, size: int) -> Iterator[str]:
        """text in parts of about size characters, cut where the words to both sides are the same without the cut."""
        at = 0
        while len(text) - at > size and not any(" " in s for s in self.special):
            # Letters end at a space, and a space and letters are one word: no word reaches over such a place.
            m = _BETWEEN.search(text, at + size)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of least rank is merged, the leftmost first, until no pair has a rank."""
        ids, merges = [self.first[b] for b in word], self.merges
        none = (1 << 60, 0)
        while len(ids) > 1:
            best, at = none, -1
            for i in range(len(ids) - 1):
                m = merges.get(ids[i] << 32 | ids[i + 1], none)
                if m[0] < best[0]:
                    best, at = m, i
            if at < 0:
                break
            a, b, new = ids[at], ids[at + 1], best[1]
            out, i = ids[:at], at
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a rank above all others where there is none, or where an id is -1."""
        none = len(self.rank_id)
        if not len(self.pairs):
            return np.full(a.shape, none)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], none)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words at once: one merge of every word in each round, words of like length together."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        first = np.array(self.first, np.int64)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64), (64, 200)):
            part = np.flatnonzero((size > low) & (size <= high))
            for c in range(0, len(part), 20_000):
                rows = part[c : c + 20_000]
                ids = np.full((len(rows), high + 1), -1, np.int64)
                inside = np.arange(high + 1) < size[rows, None]
                ids[inside] = first[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
                for i, own in zip(rows.tolist(), self._merged(ids)):
                    out[i] = own
        for i in np.flatnonzero(size > 200).tolist():
            out[i] = self.merge_long(words[i])
        return out

    def _merged(self, ids: np.ndarray) -> list[list[int]]:
        none, columns = len(self.rank_id), np.arange(ids.shape[1] - 1)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        while len(live):
            r = ranks[live]
            at = r.argmin(axis=1)  # the least rank, the leftmost of equal ones
            best = r[np.arange(len(live)), at]
            go = best < none
            live, at, best, r = live[go], at[go], best[go], r[go]
            if not len(live):
                break
            own, k = ids[live], np.arange(len(live))
            moved = columns + (columns > at[:, None])  # what stands behind the merged pair moves up
            own[:, :-1] = np.take_along_axis(own, moved, 1)
            own[:, -1] = -1
            own[k, at] = self.rank_id[best]
            r = np.take_along_axis(np.concatenate([r, np.full((len(r), 1), none)], axis=1), moved, 1)
            r[k, at] = self._ranks(own[k, at], own[k, at + 1])
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self._ranks(own[before, at[before] - 1], own[before, at[before]])
            ids[live], ranks[live] = own, r
        ends = (ids >= 0).sum(axis=1)
        return [row[:n] for row, n in zip(ids.tolist(), ends.tolist())]

    def merge_long(self, word: bytes) -> list[int]:
        """The same by a heap, for words too long for merge()'s scans."""
        import heapq

        ids: list[int | None] = [self.first[b] for b in word]
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = []

        def push(i):
            if 0 <= i and right[i] < len(ids) and (m := self.merges.get(ids[i] << 32 | ids[right[i]])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[right[i]], m[1]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if ids[i] != a or right[i] >= len(ids) or ids[right[i]] != b:
                continue
            j = right[i]
            ids[i], ids[j], right[i] = new, None, right[j]
            if right[j] < len(ids):
                left[right[j]] = i
            push(i)
            push(left[i])
        return [i for i in ids if i is not None]

    def split(self, text: str) -> list:
        """Words of a text; the id (an int) where it holds the string of a special token."""
        if self.marks is None or not self.marks.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.words(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.words(text[at:])


def compile_lexicon(words: dict[bytes, list[int]]) -> np.ndarray:
    """The minimal acyclic transducer of words, as one array of longs.

    Built word by word in sorted order: states of the last word's tail are replaced by equal ones
    that exist already, as soon as no further word can change them.
    """
    ordered = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, dict[int, int]]] = []  # registered: (final, {byte: state})
    path: list[list] = [[False, {}]]  # open states of the last word: [final, {byte: registered state}]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final, tuple(sorted(arcs.items())))
            if key not in register:
                register[key] = len(states)
                states.append((final, arcs))
            path[-1][1][last[len(path) - 1]] = register[key]

    for w in ordered:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        path += [[False, {}] for _ in w[common:]]
        path[-1][0] = True
        last = w
    close(0)
    root = len(states)
    states.append(tuple(path[0]))
    ends = [0] * len(states)  # words from a state on; states are numbered after those they lead to
    keys, target, add = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for b in sorted(arcs):
            keys.append(s << 8 | b)
            target.append(arcs[b])
            add.append(n)  # words that end here or go by a smaller byte come first
            n += ends[arcs[b]]
        ends[s] = n
    ids = [words[w] for w in ordered]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    parts = [np.array(x, np.int64) for x in (keys, target, add, [f for f, _ in states], [root])] + [starts, flat]
    return np.concatenate([np.array([len(p) for p in parts], np.int64), *parts])


class Lexicon:
    """A compiled lexicon, mapped from its file or given as the array itself."""

    def __init__(self, source: str | np.ndarray):
        data = np.memmap(source, np.int64, "r") if isinstance(source, str) else source
        at, parts = 7, []
        for n in data[:7].tolist():
            parts.append(data[at : at + n])
            at += n
        self.keys, self.target, self.add, self.final, root, self.starts, self.flat = parts
        self.root = int(root[0])

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, None if the lexicon lacks it; all words walk at once, byte by byte."""
        n = np.array([len(w) for w in words], np.int64)
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero((n > 0) & (n <= LONGEST))
        gone = np.ones(len(words), bool)
        gone[alive] = len(self.keys) == 0
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        step = 0
        while len(alive) and len(self.keys):
            key = state[alive] << 8 | flat[start[alive] + step].astype(np.int64)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            gone[alive[~ok]] = True
            alive, arc = alive[ok], arc[ok]
            state[alive] = self.target[arc]
            total[alive] += self.add[arc]
            step += 1
            alive = alive[n[alive] > step]
        ok = ~gone & (self.final[state] == 1)
        return [self.flat[self.starts[t] : self.starts[t + 1]].tolist() if k else None for k, t in zip(ok.tolist(), total.tolist())]


class Encoder:
    """Encodes and decodes with a lexicon, remembering words it has met."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.flat, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self._learn(list(self.tokenizer.special.values()), [[i] for i in self.tokenizer.special.values()])

    def _learn(self, words: list, ids: list[list[int]]) -> None:
        n, m = len(self.known), int(self.starts[len(self.known)])
        ends = m + np.cumsum([len(x) for x in ids], dtype=np.int64)
        total = int(ends[-1]) if len(ends) else m
        for name, size in (("flat", total), ("starts", n + len(words) + 1)):
            old = getattr(self, name)
            if size > len(old):
                grown = np.zeros(max(size, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.flat[m:total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total - m)
        self.starts[n + 1 : n + 1 + len(words)] = ends
        self.known.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's start in them (one more at the end).

        Long texts are cut where words end anyway, and pieces of PIECE_CHARS characters or so are held as words at a time.
        """
        ids, size, part, owner, held = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64), [], [], 0

        def spend():
            out, edge = self._encode(part)
            ids.append(out)
            np.add.at(size, owner, np.diff(edge))
            part.clear()
            owner.clear()

        for i, t in enumerate(texts):
            for piece in self.tokenizer.pieces(t or "", PIECE_CHARS):
                if held + len(piece) > PIECE_CHARS and part:
                    spend()
                    held = 0
                part.append(piece)
                owner.append(i)
                held += len(piece)
        if part:
            spend()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(size)])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        words, counts = [], []
        for t in texts:
            found = self.tokenizer.split(t) if t else []
            counts.append(len(found))
            words += found
        known = self.known
        places = list(map(known.get, words))
        unknown = [i for i, p in enumerate(places) if p is None]
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            raw = [w.encode() for w in new]
            ids = self.lexicon.find(raw)
            lacking = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(lacking, self.tokenizer.merge_many([raw[i] for i in lacking])):
                ids[i] = x
            self._learn(new, ids)
            for i in unknown:
                places[i] = known[words[i]]
        place = np.array(places, np.int64)
        size = self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(self.starts[place] - (ends - size), size) + np.arange(total)]
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return out, edge

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that ids stand for."""
        t = self.tokenizer
        size = t.lengths[ids]
        ends = np.cumsum(size)
        return t.flat[np.repeat(t.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


_encoders: dict = {}


def _encoder(path: str, lexicon: str) -> Encoder:
    """A worker's encoder, kept for the next task."""
    if (path, lexicon) not in _encoders:
        _encoders.clear()
        _encoders[path, lexicon] = Encoder(Tokenizer(path), Lexicon(SparkFiles.get(lexicon)))
    return _encoders[path, lexicon]


def piece_counts(documents: DataFrame) -> DataFrame:
    """(piece, n): pieces of text between white space, over all texts; a piece that occurs once in a part
    of the texts doesn't count there."""
    small_batches(documents.sparkSession)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(t.split())
            if len(counts) > 300_000:
                yield from _counted(counts)
                counts.clear()
        yield from _counted(counts)
        counts.clear()
        tidy()

    return select_as(documents, text="string").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _counted(counts: Counter):
    kept = [(w, n) for w, n in counts.items() if n > 1 and len(w) <= LONGEST]
    for a in range(0, len(kept), 10_000):
        w, n = zip(*kept[a : a + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], ["piece", "n"])


def build_lexicon(documents: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compiles the words most frequent in documents and sends the file to all workers; returns its name.

    Words are what the tokenizer cuts the most frequent pieces into, each with the space before it.
    What reaches the driver is at most words pieces of at most LONGEST characters.
    """
    spark, tokenizer = documents.sparkSession, Tokenizer(path)
    pieces = materialize(piece_counts(documents).withColumn("level", F.floor(8 * F.log2("n"))), "pieces")
    # The lowest level from which on there are at most words pieces: so no task sends more than it must.
    lowest, total = None, 0
    for r in sorted(pieces.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # some hundred levels
        total += r["count"]
        if total > words:
            break
        lowest = r["level"]
    counts: Counter = Counter()
    for r in pieces.where(F.col("level") >= lowest).collect() if lowest is not None else []:
        for w in tokenizer.words(" " + r["piece"]):
            counts[w] += r["n"]
    discard(pieces)
    top = [w.encode() for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:words]]
    lexicon = compile_lexicon(dict(zip(top, tokenizer.merge_many(top))))
    folder = tempfile.mkdtemp(prefix="skarn-")
    name = f"lexicon-{hashlib.sha256(lexicon.tobytes()).hexdigest()[:16]}-{os.path.basename(folder)}.bin"
    lexicon.tofile(os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def encode_documents(documents: DataFrame, path: str, lexicon: str) -> DataFrame:
    """(doc_id, ids, n_tokens): token ids of every row's whole text; none for null or empty text."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in slices(batches, 1):
            ids, edge = _encoder(path, lexicon).encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(edge))], ["doc_id", "ids", "n_tokens"])
        tidy()

    return select_as(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null."""
    small_batches(encoded.sparkSession)

    def run(batches):
        encoder = Encoder(Tokenizer(path), Lexicon(compile_lexicon({})))
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return select_as(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, encoded and decoded again.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded
    text in UTF-8. Null text counts as empty: no ids. Strings of special tokens become those tokens.
    Repeated rows are encoded one by one; an empty table gives an empty result.
    """
    rows = select_as(documents, doc_id="long", text="string")
    lexicon = build_lexicon(rows, path, words)

    def run(batches):
        for batch in slices(batches, 1):
            encoder = _encoder(path, lexicon)
            ids, edge = encoder.encode(batch.column(1).to_pylist())
            a, b = [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = ids[i:j]
                a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(encoder.decode(own).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edge)), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
