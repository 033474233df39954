"""Substring dedup: suffix automata of reference shards and matching statistics.

A shard's reference is the set of different texts that share anchors
(``anchors``). Its suffix automaton, over words, knows how often each of its
strings occurs; documents' texts are streamed through it, and at every word
the longest suffix that occurs at least twice is the matching statistic.
Maximal spans where it reaches the threshold are removed.

The automaton is not broadcast to all documents: a corpus has no bounded set
of references, and every shard would meet every document. Anchors send each
text to the one shard that can hold its match, and shards are of bounded size.

Defined cases: null and empty texts have no words and are never removed;
repeated rows count as different places, so both copies lose their words; texts
shorter than the threshold keep all words. Columns of the names that
``remove_repeats`` adds are replaced, others are carried.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors, store

THRESHOLD = 35


class SuffixAutomaton:
    """Of several texts, given as sequences of hashable symbols, each with a number of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of ``q`` for the strings that are at most one longer than those of ``p``."""
        nxt, link, length = self.next, self.link, self.length
        copy = self._state(length[p] + 1, nxt[q].copy(), link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def add(self, symbols, times: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
            else:
                new = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            count[last] += times

    def finish(self, least: int = 2) -> None:
        """Total the occurrences, and note for each state its longest suffix with ``least`` of them."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        count, link, length = self.count, self.link, self.length
        for s in reversed(order):
            if link[s] >= 0:
                count[link[s]] += count[s]
        self.often = often = [0] * len(length)
        self.least = least
        for s in order[1:]:
            often[s] = length[s] if count[s] >= least else often[link[s]]

    def matching(self, symbols) -> list[int]:
        """At each symbol, the length of the longest string ending there that occurs ``least`` times."""
        nxt, link, length, count, often, least = self.next, self.link, self.length, self.count, self.often, self.least
        s = n = 0
        out = []
        for c in symbols:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            out.append(n if count[s] >= least else often[s])
        return out


def engine(texts: list[tuple[int, bytes]], window: int) -> list[np.ndarray]:
    """For each (times, text), spans of words in windows that occur twice in the shard."""
    ids: dict[bytes, int] = {}
    streams = [[ids.setdefault(w, len(ids)) for w in body.split()] for _, body in texts]
    reference = SuffixAutomaton()
    for (times, _), stream in zip(texts, streams, strict=True):
        reference.add(stream, times)
    reference.finish()
    return [_spans(reference.matching(stream), window) for stream in streams]


def _spans(matched: list[int], window: int) -> np.ndarray:
    out, a, b = [], -1, -1
    for i, n in enumerate(matched):
        if n >= window:
            if a >= 0 and i + 1 - n <= b:
                a, b = min(a, i + 1 - n), i + 1
            else:
                if a >= 0:
                    out.append((a, b))
                a, b = i + 1 - n, i + 1
    if a >= 0:
        out.append((a, b))
    return np.array(out, np.int32).reshape(-1, 2)


def scheme(threshold: int = THRESHOLD, hot: int = 2000) -> anchors.Scheme:
    return anchors.Scheme(threshold, min(8, threshold), anchors.word_units, engine, 500_000, hot, alone=True)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, hot: int = 2000) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256."""
    docs = store.without(docs, "n_words", "n_removed", "kept_text", "kept_sha256")
    rest = docs.schema.fields

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        words, removed, kept, digest = [], [], [], []
        for body, spans in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), found, strict=True):
            w = left = (body or "").encode("utf-8", "surrogatepass").split()
            if spans:
                left = [x for x, g in zip(w, anchors.covered(len(w), spans).tolist(), strict=True) if not g]
            out = b" ".join(left)
            words.append(len(w))
            removed.append(len(w) - len(left))
            kept.append(out.decode("utf-8", "surrogatepass"))
            digest.append(hashlib.sha256(out).hexdigest())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
            names=[*(f.name for f in rest), "n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return anchors.apply_to_repeats(docs, scheme(threshold, hot), "substring", finish, f"{fields}, n_words long, n_removed long, kept_text string, kept_sha256 string")
