"""Numpy kernels over Arrow string columns: words, their hashes, and hashes of word sequences.

A word is [^\\x20\\x09-\\x0D]+. All of these separators are single bytes of UTF-8, so words are found
and hashed on bytes, for many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of the kernels takes at most, unless a single text is longer.
CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20260101)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            t = np.full(m, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and each row's start in them (one more at the end); null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()).fill_null("")
    n, off = len(column), column.offset
    starts = np.frombuffer(column.buffers()[1], np.int64, n + 1 + off)[off:]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes each."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batches, at: int, size: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column at has about size bytes in each, unless a single row has more."""
    for batch in batches:
        starts = texts(batch.column(at))[1]
        for a, b in chunks(starts, size):
            yield batch.slice(a, b - a)


def words(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of every word of the rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    if lower:
        data = LOWER[data]
    black = ~_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | edge[1:n]
    last = black.copy()
    last[:-1] &= ~black[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    value = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    row = np.searchsorted(starts, begin, "right") - 1
    return begin, end, row, value


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b; order counts."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each place on (len - k + 1 of them), by doubling."""
    if k <= 0 or len(hashes) < k:
        return np.zeros(0, np.uint64)
    done, out, power, size = 0, None, hashes, 1
    rest = k
    while rest:
        if rest & 1:
            out = power[: len(hashes) - size + 1] if out is None else joined(out[: len(hashes) - done - size + 1], power[done : len(hashes) - size + 1])
            done += size
        rest >>= 1
        if rest:
            power = joined(power[: len(power) - size], power[size:])
            size *= 2
    return out
