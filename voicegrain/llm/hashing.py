"""Word and shingle hashes of Arrow text columns, in numpy, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 2_000_000
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in data; offsets, from 0 to len(data), bound the documents."""
    word = ~_SEPARATOR[data]
    padded = np.concatenate(([False], word, [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (~padded[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (~padded[2:] | edge[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and where each document's words begin (len + 1 places)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    d, at = data[lo:hi], offsets - lo
    if lower:
        d = _LOWER[d]
    starts, ends = word_spans(d, at)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    values = _BYTE[d[~_SEPARATOR[d]]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, begin) ^ lengths.astype(np.uint64)), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingle hashes of each document, and where each document's begin.

    A document with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(first[:-1], count)
    size = np.repeat(n, count)
    acc = np.repeat(np.where(n < k, n, 0), count).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        part = hashes[np.minimum(place + j, max(len(hashes) - 1, 0))]
        acc = acc * np.uint64(_BASE) + np.where(j < size, part, np.uint64(0))
    acc = mix(acc)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        acc[a:b].sort()
    owner = np.repeat(np.arange(len(n)), count)
    fresh = np.ones(len(acc), bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return acc[fresh], kept[at]


def reduce_each(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    """ufunc over each document's values; `empty` where there are none."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out
