"""Words and word shingles of Arrow text columns as 64-bit numbers, in numpy.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased. Its number is a polynomial of its
bytes modulo 2**64, mixed; a text that is longer than a block is cut at white space, so memory follows the
block and the longest word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_ROLL = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def give_back() -> None:
    """Returns what a task has freed to the machine, as Python workers stay when their task ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, BLOCK + 1)
        _tables[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _tables[0], _tables[1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins and ends; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most about BLOCK bytes that end at a row's end or at white space."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row > at:
                to = row
            else:
                stop = int(offsets[np.searchsorted(offsets, to, "left")])
                step = to
                while step < stop:  # long text: go on to the next white space
                    hit = np.flatnonzero(_SPACE[data[step : step + BLOCK]])
                    if len(hit):
                        step += int(hit[0])
                        break
                    step += BLOCK
                to = min(step, stop)
        yield at, to
        at = to


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, ends_too: bool = False) -> tuple[np.ndarray, ...]:
    """A number for each word, and where each row's words begin and end among them; with ``ends_too`` also the words' first and end bytes."""
    numbers, places, stops = [], [], []
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    for a, b in _cuts(data, offsets):
        x = data[a:b]
        space = _SPACE[x]
        begins = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)] - a
        edge = np.zeros(b - a + 1, bool)  # a text or block begins here
        edge[0] = edge[b - a] = True
        edge[begins] = True
        first = ~space
        first[1:] &= space[:-1] | edge[1:-1]
        last = ~space
        last[:-1] &= space[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(b - a + 1)
        v = _BYTE[_FOLD[x] if fold else x]
        v *= up[: b - a]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        numbers.append(mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        places.append(starts + a)
        stops.append(ends + a)
    none = [np.zeros(0, np.int64)]
    where = np.concatenate(places or none)
    bounds = np.searchsorted(where, offsets).astype(np.int64)
    out = (np.concatenate(numbers) if numbers else np.zeros(0, np.uint64), bounds)
    return (*out, where, np.concatenate(stops or none)) if ends_too else out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Row by row, the sorted distinct numbers of its k-word shingles; fewer words are one shingle."""
    n = len(words)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += words[j : n - k + 1 + j] * _ROLL[j] if n >= k else U(0)
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _ROLL[: b - a]).sum(dtype=np.uint64) + U(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(col: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    return shingles(*hash_words(*column_bytes(col)), k)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
