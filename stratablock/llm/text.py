"""Vectorised work on the bytes of a batch of texts.

A batch is one byte buffer plus document offsets, taken from Arrow without
copying. Words, hashes and n-grams are numpy arrays over that buffer, so no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one numpy working slice; a longer single document is its own slice.
SLICE_BYTES = 500_000

_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2**64."""
    if _pow["n"] <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, _B, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _pow.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _pow["up"][: n + 1], _pow["down"][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Rolling:
    """Hashes of any span of a sequence, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of ``k`` values, by start."""
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return whole[first:last], offsets - first


def slices(buf: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``size`` bytes: first, end, bytes, offsets."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
PLAIN = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: capitals count as letters.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of the documents of a slice: starts and ends in bytes, and where each document's words begin."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = PLAIN):
        inside = kind[buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[offsets[offsets <= n]] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.buf = buf

    def hashes(self) -> np.ndarray:
        roll = Rolling(_BYTE[self.buf])
        return roll.spans(self.starts, self.ends)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def group_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; an empty run sums to 0."""
    shape = (len(bounds) - 1, *values.shape[1:])
    out = np.zeros(shape, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=out.dtype)
    return out
