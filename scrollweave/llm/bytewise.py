"""Whole-batch text work on UTF-8 bytes with numpy: no loop over characters.

Texts of an Arrow batch are taken in runs of documents of ``CHUNK`` bytes (or
one longer document), which bounds memory.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lean(work: Callable) -> Callable:
    """``work`` (batches to batches), which gives its task's free memory back at the end: Python workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which all bits of the result depend on all of ``x``."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Masks that keep the first k bytes of a little-endian word; ranges up to SHORT bytes are hashed in numpy.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
SHORT = 64


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number (beyond the end: 0): a view, eight numbers share each byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def same_ranges(at: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``size`` bytes from each a and from each b (in ``other``, if given) are the same."""
    same, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    other = at if other is None else other
    while len(live := live[size[live] > k]):
        if k < SHORT:
            differs = ((at[a[live] + k] ^ other[b[live] + k]) & FIRST[np.minimum(size[live] - k, 8)]) != 0
            same[live[differs]] = False
            live, k = live[~differs], k + 8
        else:
            left, right = memoryview(at.base), memoryview(other.base)
            for i, x, y, n in zip(live.tolist(), a[live].tolist(), b[live].tolist(), size[live].tolist(), strict=True):
                same[i] = left[x + k : x + n] == right[y + k : y + n]
            break
    return same


def distinct(hashes: np.ndarray, same) -> tuple[np.ndarray, np.ndarray, int]:
    """(code, first, n): equal codes for equal things, by their hashes and, where these are equal, ``same(a, b)`` of their numbers; the first thing of each code; codes from n on have a hash that another has."""
    codes, unique = pd.factorize(hashes)
    first, n = np.zeros(len(unique), np.int64), len(unique)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    codes = codes.astype(np.int64)
    rest = np.flatnonzero(first[codes] != np.arange(len(codes)))
    wrong = rest[~same(rest, first[codes[rest]])] if len(rest) else rest
    # Things that only share a hash: compared with one another, again by pairs with the first.
    while len(wrong):
        lead, codes[wrong[0]] = wrong[0], len(first)
        first = np.append(first, lead)
        equal = same(wrong[1:], np.full(len(wrong) - 1, lead)) & (hashes[wrong[1:]] == hashes[lead])
        codes[wrong[1:][equal]] = codes[lead]
        wrong = wrong[1:][~equal]
    return codes, first, n


class Text:
    """Some documents as one byte array; document i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._at: np.ndarray | None = None

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of set bytes of ``mask`` in each document."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.offsets))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document that holds each byte position."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def docs_of(self, at: np.ndarray) -> np.ndarray:
        """As :meth:`doc_of`, of positions in ascending order."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.offsets)))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of set bytes, cut at the edges of documents."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])

    @property
    def at(self) -> np.ndarray:
        if self._at is None:
            self._at = words_at(self.data)
        return self._at

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range: by its bytes and length, not its place."""
        size = ends - starts
        h, k = mix((size.astype(U) + U(1)) * BASE), 0
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        while len(live := live[size[live] > k]):
            word = self.at[starts[live] + k] & FIRST[np.minimum(size[live] - k, 8)]
            h[live] = mix((h[live] ^ word) * BASE + U(k))
            k += 8
        if len(long := np.flatnonzero(size > SHORT)):
            raw = memoryview(self.data)
            h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return h

    def codes(self, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(code, first, n) of byte ranges, as :func:`distinct`: bytes decide."""
        size = ends - starts
        same = lambda a, b: (size[a] == size[b]) & same_ranges(self.at, starts[a], starts[b], np.where(size[a] == size[b], size[a], 0))
        return distinct(self.hashes(starts, ends) if hashes is None else hashes, same)


def windows(values: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size`` successive values of one document, and the index of the first."""
    if len(values) < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(values) - size + 1
    h = values[:n].copy()
    for k in range(1, size):
        h *= BASE
        h ^= h >> U(32)
        h += values[k : k + n]
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    return mix(h[at]), at


def doc_key(docs: np.ndarray) -> np.ndarray:
    """A word to add to hashes, so that they are equal within a document only."""
    return mix(docs.astype(U) + U(0x1234567))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    return raw_bytes(pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Text]]:
    """(first row, row after the last, their Text), each of ``limit`` bytes or one row."""
    data, offsets = column_bytes(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, Text(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
