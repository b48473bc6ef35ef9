"""Array kernels shared by the text operators: words, word hashes, shingles and windows.

They work on the UTF-8 bytes of many documents at once.  Memory is bounded by ``SLICE`` bytes of
text and the words of the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 18
_ALL = (1 << 64) - 1
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and the number of words before each document."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words before each document.

    Eight bytes at a time are scrambled into the state, so no structure of the bytes cancels out;
    two seeds give independent hashes.
    """
    starts, ends, bounds = word_spans(data, offsets)
    n = ends - starts
    state = mix(n.astype(U64) + U64((2 * seed + 1) * 0xA24BAED4963EE407 & _ALL))
    if len(n):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eights = np.lib.stride_tricks.as_strided(np.frombuffer(padded, dtype=U64, count=1), shape=(len(data),), strides=(1,))
        live, at = np.arange(len(n)), 0
        while len(live):
            left = n[live] - at
            told = eights[starts[live] + at] & _LOW[np.minimum(left, 8)]
            state[live] = mix((state[live] ^ told) * U64(0x9E3779B97F4A7C15) + U64(seed))
            live, at = live[left > 8], at + 8
    return state, bounds


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive word hashes from each place; shorter by k-1 than the words.

    Neighbouring halves are scrambled together, and the powers of two that make up k are chained.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out, at, size, grams = None, 0, 1, words
    while size <= k:
        if k & size:
            part = grams[at : at + n]
            out = part if out is None else _joined(out, part)
            at += size
        if 2 * size <= k:
            grams = _joined(grams[:-size], grams[size:])
        size *= 2
    return mix(out + U64(k * 0x9FB21C651E98DF25 & _ALL))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, rows, bytes, offsets) of about SLICE bytes; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield at, to - at, _LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at]
        at = to
    pa.default_memory_pool().release_unused()  # else idle workers keep the largest batch they ever had


def columns(*schemas: str):
    """For mapInArrow: names and Arrow types written as "name type, name type"."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "longs": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for s in schemas for f in s.split(", ")])


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Lists of longs from concatenated values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
