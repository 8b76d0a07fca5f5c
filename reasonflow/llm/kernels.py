"""Vectorised numpy kernels over the bytes of Arrow string columns.

All kernels work on the flat UTF-8 buffer of many documents at once: no Python
object is made per word.  Hashes are polynomials modulo 2**64 over random byte
codes, finished by a mixer; they depend on content alone, so every executor and
every run gets the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library
    _TRIM = None
#: Bytes 9-13 and 32 end a word; every other byte belongs to one.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled in one go, unless a single document is longer.
STEP_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a bijection that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def codes(seed: int, n: int = 256) -> np.ndarray:
    """n pseudo-random 64-bit codes, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (at least; the table is kept and grows)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, 64), U64(base))
            step[0] = 1
            have = _POWERS[base] = np.multiply.accumulate(step)
    return have


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the place where each begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``most`` bytes, one row at least."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
    release()


def release() -> None:
    """Gives freed memory back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each document."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
    rank = inside - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        value = codes(seed)[data[inside]] * powers(0x9E3779B97F4A7C15 + 2 * seed, int(length.max()))[rank]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(value, dtype=U64)))
        upto = np.cumsum(length)
        return mix(total[upto] - total[upto - length] + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Polynomial of each k consecutive values, by doubling: out[i] covers h[i:i+k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out, covered, part, size, factor = None, 0, h, 1, base
        while True:
            if k & size:
                piece = part[covered : covered + n]
                out = piece.copy() if out is None else out + piece * U64(pow(base, covered, 1 << 64))
                covered += size
            if covered == k:
                return mix(out)
            part = part[:-size] + part[size:] * U64(factor)
            factor = factor * factor % (1 << 64)
            size *= 2


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the least of v[i:i+w], the last one among equals."""
    n = len(v) - w + 1
    at, size = np.arange(len(v)), 1
    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(v[b] <= v[a], b, a)
    while size * 2 <= w:
        at = better(at[:-size], at[size:])
        size *= 2
    return better(at[:n], at[w - size : w - size + n]) if size < w else at[:n]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each element's group and rank in it."""
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
