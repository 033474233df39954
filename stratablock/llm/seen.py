"""Bitmaps of fixed size telling which hashed keys occur more than once.

Tasks sort their keys and send, per segment of the bitmap, 16-bit positions;
a segment is merged in one stream and comes back as 8 KB of bits at most. The
whole bitmap has ``2**28`` bits (32 MB) at most, whatever the input, so it may be
broadcast.

It errs only one way: a key it calls single occurs once in the whole input; a
key it calls repeated may be single. Callers use it to leave out what cannot
have a partner, and decide exactly what remains.

Where keys have contents, a second bitmap tells which keys occur with
different contents. It errs one way too: a repeated key that it calls uniform
stands for the same 64-bit content each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import store

BITS = 28
#: Keys that a task gathers before it sends them.
FLUSH = 1_000_000

#: Bits of the second bitmap, of keys with many different contents.
BUSY_BITS = 24
#: A flush reports a key from so many different contents on.
_REPORT = 4

Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]]
Bitmaps = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def _low(bits: int) -> int:
    """Bits of a place within its segment: 1024 segments or more, so that they spread, and 16-bit places."""
    return max(3, min(16, bits - 10))


def _places(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def build(df: DataFrame, keys: Keys, busy_from: int = 0, bits: int = BITS, flush_at: int = FLUSH, least: int = 2, many_from: int = 0) -> Bitmaps:
    """The bitmaps of the keys (uint64) that ``keys`` makes of each Arrow batch of ``df``: repeated, mixed, busy.

    With ``busy_from``, ``keys`` also gives a content of each key. Mixed keys
    have different contents; busy ones (2 MB, or None) more than so many. Keys
    that share a bit with one count as such. With ``least`` 1 the first bitmap
    marks all keys. With ``many_from`` instead, busy keys are those that a task
    has found ``_REPORT`` times or more in a flush, and more than so many in all.
    """
    busy_from_any = busy_from or many_from
    in_segment = _low(bits)
    segments = 1 << (bits - in_segment)
    per = (1 << BUSY_BITS) // segments  # bits of the busy bitmap in a segment

    def often(k: np.ndarray, count: np.ndarray) -> list[tuple[int, bytes]]:
        """Rows of the keys that come often, by segment."""
        many = count >= _REPORT
        k, count = k[many], count[many]
        seg = _places(k, bits - in_segment)
        ends = np.flatnonzero(np.append(seg[1:] != seg[:-1], True)) + 1 if len(seg) else []
        return [(-1 - int(seg[x]), np.stack([k[x:y], count[x:y].astype(np.uint64)]).tobytes()) for x, y in zip([0, *ends][:-1], ends, strict=True)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, contents, n = [], [], 0

        def flush():
            k = np.concatenate(held)
            p, c = _places(k, bits), np.concatenate(contents) if busy_from else None
            by = np.argsort(p) if c is None else np.lexsort((c, p))
            p = p[by]
            keep = np.ones(len(p), bool)
            if c is None:
                keep[2:] = p[2:] != p[:-2]  # two of a kind tell as much as many
            else:
                first, third = c[by], np.zeros(len(p), bool)
                third[2:] = (p[2:] == p[:-2]) & (first[2:] == first[:-2])
                keep = ~third
                first = first[keep]
            p = p[keep]
            cuts = np.searchsorted(p, np.arange(segments + 1) << in_segment)
            low = (p & ((1 << in_segment) - 1)).astype(np.uint16)
            full = np.flatnonzero(np.diff(cuts))
            rows = [(int(s), low[cuts[s] : cuts[s + 1]].tobytes() + (first[cuts[s] : cuts[s + 1]].tobytes() if busy_from else b"")) for s in full]
            if busy_from:
                by = np.lexsort((c, k))
                k, c = k[by], c[by]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                rows += often(*np.unique(k[new], return_counts=True))
            elif many_from:
                rows += often(*np.unique(k, return_counts=True))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["segment", "low"])

        for batch in batches:
            k, c = keys(batch)
            if len(k):
                held.append(k)
                contents.append(c)
                n += len(k)
            if n >= flush_at:
                yield flush()
                held, contents, n = [], [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << in_segment
        at, count, known, differ, sums, done = None, None, None, None, {}, []

        def packed() -> bytes:
            if at >= 0:
                again = np.packbits(count >= least, bitorder="little").tobytes()
                return again + np.packbits(differ, bitorder="little").tobytes() if busy_from else again
            out = np.zeros(per, bool)
            for k, c in sums.items():
                if c > busy_from_any:
                    out[(k >> (64 - BUSY_BITS)) & (per - 1)] = True
            return np.packbits(out, bitorder="little").tobytes()

        for batch in batches:
            for s, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != at:
                    if at is not None:
                        done.append((at, packed()))
                    at, count, sums = s, np.zeros(width, np.uint8), {}
                    if busy_from and s >= 0:
                        known, differ = np.zeros(width, np.uint64), np.zeros(width, bool)
                raw = low.as_buffer()
                if s >= 0:
                    n = len(raw) // (10 if busy_from else 2)
                    place = np.frombuffer(raw, np.uint16, n)
                    if busy_from:
                        content = np.frombuffer(raw, np.uint64, n, 2 * n)
                        new = count[place] == 0
                        known[place[new]] = content[new]  # of several new ones the last stays, and the others differ from it
                        differ[place[known[place] != content]] = True
                    count += np.minimum(np.bincount(place, minlength=width), 2).astype(np.uint8)
                    np.minimum(count, 2, out=count)
                else:
                    for k, c in np.frombuffer(raw, np.uint64).reshape(2, -1).T.tolist():
                        sums[k] = sums.get(k, 0) + c
        if at is not None:
            done.append((at, packed()))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())], names=["segment", "bits"])

    parts = store.partitions(df.sparkSession)
    rows = (
        df.mapInArrow(send, "segment int, low binary")
        .repartition(parts, "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(merge, "segment int, bits binary")
        .toArrow()
    )
    size = (1 << in_segment) // 8
    again = np.zeros((segments, size), np.uint8)
    mixed = np.zeros((segments, size if busy_from else 0), np.uint8)
    busy = np.zeros((segments, per // 8), np.uint8)
    for s, b in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        raw = np.frombuffer(b.as_buffer(), np.uint8)
        if s >= 0:
            again[s], mixed[s] = raw[:size], raw[size:]
        else:
            busy[-1 - s] = raw
    return again.reshape(-1), mixed.reshape(-1), busy.reshape(-1) if busy.any() else None


def repeated(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """False: the key occurs once in the whole input. True: it may occur again."""
    p = _places(keys, bits)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1) > 0


def busy(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have many contents; equal keys get equal answers."""
    return repeated(bitmap, keys, BUSY_BITS)
