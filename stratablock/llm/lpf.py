"""Suffix-array dedup: longest-previous-factor arrays from neighbours in suffix order.

In a shard (``anchors``) windows whose hash occurs once there are left out: no
match starts at them. The suffix array of what remains is built by prefix
doubling; the ranks of every round stay, so the common prefix of any two
suffixes is read by descending through them. Positions are then visited in
suffix order: the previous and the next smaller position give each suffix its
longest earlier match. A match of at least ``threshold`` bytes removes the
later copy; the earliest copy is kept, or, with ``keep_first=False``, goes too.

Defined cases: null and empty texts have no bytes; repeated rows are different
places; texts shorter than the threshold keep all bytes. Removal is by bytes,
so kept bytes need not be valid UTF-8. Columns of the names that
``remove_repeats`` adds are replaced, others are carried.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors, store, text

THRESHOLD = 400


def _dense(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int32)
    sorted_key = key[order]
    step = np.zeros(len(order), np.int64)
    step[1:] = sorted_key[1:] != sorted_key[:-1]
    rank[order] = np.cumsum(step)
    return rank


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes ordered by their first ``depth`` symbols or more, then by position; and (length, ranks) of each round.

    Symbols are under 2**16; past the end a suffix is smaller than any other.
    """
    n = len(symbols)
    s = np.zeros(n + 4, np.uint64)
    s[:n] = symbols + 1
    key = (s[:n] << np.uint64(48)) | (s[1 : n + 1] << np.uint64(32)) | (s[2 : n + 2] << np.uint64(16)) | s[3 : n + 3]
    order = np.argsort(key)
    rank = _dense(order, key)
    width, rounds = 4, [(4, rank)]
    while width < depth:
        after = np.zeros(n, np.int64)
        if width < n:
            after[: n - width] = rank[width:] + np.int64(1)
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key)
        rank = _dense(order, key)
        width *= 2
        rounds.append((width, rank))
    return np.lexsort((np.arange(n), rank)), rounds


def common_prefix(i: np.ndarray, j: np.ndarray, symbols: np.ndarray, rounds: list[tuple[int, np.ndarray]], odd: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j, as far as the rounds tell: in fours, and ``odd`` symbols one by one."""
    n = len(symbols)
    i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for width, rank in reversed(rounds):
        ok = np.flatnonzero((i < n) & (j < n))
        same = ok[rank[i[ok]] == rank[j[ok]]]
        i[same] += width
        j[same] += width
        out[same] += width
    live = np.arange(len(i))
    for _ in range(odd):
        live = live[(i[live] < n) & (j[live] < n)]
        live = live[symbols[i[live]] == symbols[j[live]]]
        i[live] += 1
        j[live] += 1
        out[live] += 1
    return out


def previous_factors(order: np.ndarray, near: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose longest earlier match has at least ``threshold`` symbols, its length, and its source.

    ``near[k]`` is the common prefix of order[k-1] and order[k]. Only runs of
    neighbours that share ``threshold`` symbols can hold such a match; within
    them a stack gives the previous and the next smaller position.
    """
    at, length, source = [], [], []
    linked = near >= threshold
    inside = linked.copy()
    inside[:-1] |= linked[1:]
    idx = np.flatnonzero(inside)
    pos, lcp, joined = order[idx].tolist(), near[idx].tolist(), linked[idx].tolist()
    best: dict[int, tuple[int, int]] = {}

    def offer(p: int, n: int, q: int) -> None:
        if n >= threshold and n > best.get(p, (0, 0))[0]:
            best[p] = (n, q)

    stack: list[list[int]] = []  # positions rising, each with the common prefix to the one below
    for p, n, j in zip(pos, lcp, joined, strict=True):
        if not j:
            stack = []
        while stack and stack[-1][0] > p:
            top, below = stack.pop()
            offer(top, n, p)  # p is the next smaller position of top
            n = min(n, below)
        if stack:
            offer(p, n, stack[-1][0])
        stack.append([p, n if stack else 0])
    for p, (n, q) in best.items():
        at.append(p)
        length.append(n)
        source.append(q)
    return np.array(at, np.int64), np.array(length, np.int64), np.array(source, np.int64)


def repeated_runs(values: np.ndarray, ends: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of positions in windows whose hash occurs more than once; all others have no match.

    ``ends``: the end of each position's text.
    """
    h = text.Rolling(values).windows(window)
    inside = np.flatnonzero(np.arange(len(h)) + window <= ends[: len(h)])
    by = np.argsort(h[inside])
    same = h[inside][by]
    twice = np.zeros(len(by), bool)
    twice[1:] = same[1:] == same[:-1]
    twice[:-1] |= twice[1:]
    at = np.sort(inside[by[twice]])
    if not len(at):
        return []
    head = np.append(True, (at[1:] > at[:-1] + window) | (ends[at[1:]] != ends[at[:-1]]))
    tail = np.append(head[1:], True)
    return list(zip(at[head].tolist(), (at[tail] + window).tolist(), strict=True))


def engine_for(keep_first: bool):
    def engine(texts: list[tuple[int, bytes]], window: int) -> list[np.ndarray]:
        """For each (times, text), spans of bytes that a removed copy covers."""
        sizes = np.array([len(b) for _, b in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join(b for _, b in texts), np.uint8)
        parts = [[(0, n)] if t > 1 and n >= window and not keep_first else [] for (t, _), n in zip(texts, sizes.tolist(), strict=True)]
        # only runs of windows that occur again go into the suffix array
        runs = repeated_runs(text.byte_values(raw), np.repeat(starts[1:], sizes), window)
        if not runs:
            return [np.array(p, np.int32).reshape(-1, 2) for p in parts]
        first, end = (np.array(x) for x in zip(*runs, strict=True))
        length = end - first
        begin = np.concatenate([[0], np.cumsum(length + 1)])
        n = int(begin[-1])
        owner = np.repeat(np.arange(len(runs)), length + 1)
        source = first[owner] + np.arange(n) - begin[owner]
        stop = source == end[owner]
        symbols = np.where(stop, 256 + owner % 65_000, raw[np.minimum(source, len(raw) - 1)]).astype(np.int64)  # runs end at different symbols
        order, rounds = suffix_order(symbols, window)
        near = np.zeros(n, np.int64)
        near[1:] = common_prefix(order[:-1], order[1:], symbols, rounds, window % rounds[0][0])
        left = begin[owner] + length[owner] - np.arange(n)
        near[1:] = np.minimum(near[1:], np.minimum(left[order[:-1]], left[order[1:]]))  # a match ends with its run
        at, match, earlier = previous_factors(order, near, window)
        if not keep_first:
            at, match = np.concatenate([at, earlier]), np.concatenate([match, match])
        by = np.argsort(at, kind="stable")
        place = source[at[by]]
        whose = np.searchsorted(starts, place, "right") - 1
        for k, a, m in zip(whose.tolist(), (place - starts[whose]).tolist(), match[by].tolist(), strict=True):
            if parts[k] and parts[k][-1][0] <= a <= parts[k][-1][1]:
                parts[k][-1] = (parts[k][-1][0], max(parts[k][-1][1], a + m))
            else:
                parts[k].append((a, a + m))
        return [np.array(p, np.int32).reshape(-1, 2) for p in parts]

    return engine


def scheme(threshold: int = THRESHOLD, hot: int = 1500) -> anchors.Scheme:
    return anchors.Scheme(threshold, min(64, threshold), anchors.byte_units, engine_for(False), 500_000, hot)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, hot: int = 1500) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256; all copies of a repeat go."""
    docs = store.without(docs, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    rest = docs.schema.fields

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        size, removed, runs, kept, digest = [], [], [], [], []
        for body, spans in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), found, strict=True):
            raw = out = (body or "").encode("utf-8", "surrogatepass")
            runs.append(0)
            if spans:
                gone = anchors.covered(len(raw), spans)
                out = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs[-1] = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            size.append(len(raw))
            removed.append(len(raw) - len(out))
            kept.append(out)
            digest.append(hashlib.sha256(out).hexdigest())
        added = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), *added],
            names=[*(f.name for f in rest), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return anchors.apply_to_repeats(docs, scheme(threshold, hot), "suffixes", finish, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
