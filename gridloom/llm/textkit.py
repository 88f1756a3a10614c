"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow string columns.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed.
All functions work on chunks of about CHUNK bytes, so memory stays bounded whatever the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
GRAM = 0xC2B2AE3D27D4EB4F | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(spec: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes inside any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in spec:
        out[a : b + 1] = True
    return out


NOT_SPACE = ~byte_set([(0x20, 0x20), (0x09, 0x0D)])
WORD_BYTES = byte_set([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64 for k below n (at least)."""
    return _powers(1 << max(18, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _trim():
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    return trim if trim is not None else lambda _: 0


def release() -> None:
    """Give freed memory back to the system: Python workers are kept between tasks and share the executor's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, raw


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows with about size bytes each."""
    off, raw = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, off[i : j + 1] - off[i], raw[off[i] : off[j]]
        i = j
    release()


def words(off: np.ndarray, data: np.ndarray, keep: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in keep, never across rows: starts, ends, first word of each row
    (one more than rows), and the bytes in which they stand."""
    text = LOWER[data] if lower else data
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), text
    inside = keep[text]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off), text


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of text[start:end) for every span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, q = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * p[: len(text)], out=total[1:])
    return mix((total[end] - total[start]) * q[start])


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width consecutive words, and where each row's begin; a row of fewer words (but
    not none) has the whole sequence as its only one."""
    n, rows = len(hashes), len(first) - 1
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(per)])
    if not n:
        return np.zeros(0, np.uint64), begin
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    row = np.repeat(np.arange(rows), per)
    at = first[row] + np.arange(begin[-1]) - begin[row]
    left = first[row + 1] - at
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = padded[at + k]
        out = out * np.uint64(GRAM) + (h if k == 0 else np.where(left > k, h, np.uint64(0)))
    return mix(out), begin


def shingle_sets(column: pa.Array, width: int = 5, keep: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row, in order."""
    for _, off, data in chunks(column):
        start, end, first, text = words(off, data, keep)
        h, begin = shingles(span_hashes(text, start, end), first, width)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield np.unique(h[a:b])
