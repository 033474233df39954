"""Benchmark decontamination: an FM-index per training shard.

Each shard of documents gets an FM-index over its words: suffix order, the
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.
Test phrases are searched backward through wavelet ranks, all phrases at
once; occurrences are located by walking to a sampled position; overlapping
occurrences merge to removal spans.

Words that no phrase has cannot be part of an occurrence: the indexed text is
the runs of phrase words at least as long as the shortest phrase, each ended
by a separator of its own, so no match runs across.

The phrases are the only data sent to every task. They are sent in blocks of at most
``BLOCK_BYTES`` of benchmark text; a larger benchmark takes more passes over
the documents, one after another and without a shuffle.

Defined cases: null texts have no words; items without words have no phrase;
an item with a null id marks words but is not listed; an id that stands on
several items is listed once. An item larger than a block is a block of its
own. Documents of any length are searched whole, repeated rows each; an empty
table of documents gives no rows, an empty benchmark no hits. Columns of the
names that ``decontaminate`` adds are replaced, others are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import store, text

WINDOW = 10
BLOCK_BYTES = 2_000_000
SAMPLE = 8
#: Bytes of the documents of a shard.
SHARD_BYTES = 2_000_000


class Phrases:
    """Windows of the items of a benchmark block, as symbols of its own vocabulary.

    ``groups``: of each length, all different phrases as rows of symbols, and the
    items that have each one as a run of places in ``ids``. All are arrays: a
    block of 2 MB of text takes some 30 MB.
    """

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.ids = sorted({k for k, _ in items if k is not None})
        place = {k: n for n, k in enumerate(self.ids)}
        whose = np.array([place.get(k, -1) for k, _ in items], np.int64)
        buf, offsets = text.buffers(pa.array([t for _, t in items], pa.string()))
        words = text.Words(text.LOWER[buf], offsets, text.ALNUM)
        self.vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        symbols = (symbols + 1).astype(np.int32)
        item = words.docs()
        size = words.counts[item]
        first = np.arange(len(symbols)) - words.bounds[item]
        self.groups = []
        for n in np.unique(np.minimum(words.counts[words.counts > 0], window)).tolist():
            # all windows of longer items, or the whole of those of this length
            at = np.flatnonzero((size == n) & (first == 0) if n < window else first + n <= size)
            rows = np.ascontiguousarray(symbols[at[:, None] + np.arange(n)])
            _, one, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * n))).ravel(), return_index=True, return_inverse=True)
            pair = np.unique(np.stack([which, whose[item[at]]]), axis=1)
            pair = pair[:, pair[1] >= 0]
            bounds = np.searchsorted(pair[0], np.arange(len(one) + 1))
            self.groups.append((n, rows[one].astype(np.int64), bounds, pair[1].astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, else 0."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Wavelet:
    """A wavelet matrix: rank and access over a sequence of small integers, for arrays of queries."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        v = values
        for k in reversed(range(self.levels)):
            bit = (v >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            r = ones[at]
            at = np.where((symbol >> k) & 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            r = ones[at]
            bit = ones[at + 1] - r
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + r, at - r)
        return symbol, at - self.base[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Of symbols that end with a unique one, by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ranked = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Over runs of symbols 1..``symbols``, joined with a separator 0 after each run."""

    def __init__(self, joined: np.ndarray, symbols: int):
        n = len(joined)
        stops = np.flatnonzero(joined == 0)
        unique = joined + len(stops)
        unique[stops] = np.arange(len(stops))
        order = suffix_array(unique)
        before = joined[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=symbols + 1))])
        self.wavelet = Wavelet(before, symbols + 1)
        self.n = n
        mark = np.zeros(n, bool)
        mark[::SAMPLE] = True
        mark[0] = True
        mark[np.minimum(stops + 1, n - 1)] = True  # a walk ends before it would leave its run
        self.marked = mark[order]
        self.index = np.cumsum(self.marked) - 1
        self.position = order[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        out = np.zeros(len(patterns), bool)
        out[live] = True
        return np.where(out, lo, 0), np.where(out, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        walked = np.zeros(len(rows), np.int64)
        at = rows.copy()
        live = np.flatnonzero(~self.marked[at])
        while len(live):
            c, r = self.wavelet.access(at[live])
            at[live] = self.first[c] + r
            walked[live] += 1
            live = live[~self.marked[at[live]]]
        return self.position[self.index[at]] + walked


def occurrences(phrases: Phrases, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: first words of the occurrences, the length, the phrase of each, and phrases' items as runs."""
    if not phrases.groups or not len(symbols):
        return
    inside = symbols > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = bounds[bounds < len(symbols)]
    start[edges] = inside[edges]
    firsts = np.flatnonzero(start)
    stop = np.ones(len(symbols), bool)
    stop[:-1] = ~inside[1:] | start[1:]
    lasts = np.flatnonzero(inside & stop)
    long_enough = lasts - firsts + 1 >= phrases.shortest
    firsts, lasts = firsts[long_enough], lasts[long_enough]
    if not len(firsts):
        return
    size = lasts - firsts + 1
    ends = np.cumsum(size + 1)
    place = np.arange(ends[-1]) - np.repeat(ends - size - 1, size + 1) + np.repeat(firsts, size + 1)
    joined = symbols[np.minimum(place, len(symbols) - 1)].astype(np.int64)
    joined[ends - 1] = 0
    index = FMIndex(joined, len(phrases.vocabulary))
    for n, patterns, runs, owners in phrases.groups:
        lo, hi = index.search(patterns)
        count = hi - lo
        which = np.repeat(np.arange(len(patterns)), count)
        if len(which):
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
            yield place[index.locate(rows)], n, which, runs, owners


def _runs(hit: np.ndarray) -> np.ndarray:
    """Start and end of each run of hits."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step > 0), np.flatnonzero(step < 0)], 1)


ADDED = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, item_ids array<{}>, clean_text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_NAMES = ["n_words", "n_hit", "spans", "item_ids", "clean_text"]


def _search(docs: DataFrame, shared, kind: T.DataType, with_text: bool) -> DataFrame:
    item = to_arrow_type(kind)
    rest = [f for f in docs.schema.fields if f.name not in _NAMES]
    again = "spans" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            clean: list[str | None] = column("text").to_pylist() if with_text else [None] * n
            if again:
                old = column("spans").to_pylist()
                items = [set(x) for x in column("item_ids").to_pylist()]
            for i, j, buf, off in text.slices(*text.buffers(column("text")), SHARD_BYTES):
                words = text.Words(text.LOWER[buf], off, text.ALNUM)
                n_words[i:j] = words.counts
                hit = np.zeros(len(words.starts) + 1, np.int64)
                if len(words.starts) and len(phrases.vocabulary):
                    symbols = phrases.symbols(words.hashes())
                    for first, size, which, runs, owners in occurrences(phrases, symbols, words.bounds):
                        np.add.at(hit, first, 1)
                        np.add.at(hit, first + size, -1)
                        doc = np.searchsorted(words.bounds, first, "right") - 1
                        doc, which = np.unique(np.stack([doc, which]), axis=1)
                        n_own = runs[which + 1] - runs[which]
                        each = np.arange(n_own.sum()) - np.repeat(np.cumsum(n_own) - n_own - runs[which], n_own)
                        for d, o in np.unique(np.stack([np.repeat(doc, n_own), owners[each]]), axis=1).T.tolist():
                            items[i + d].add(phrases.ids[o])
                if again:
                    for d in range(i, j):
                        for s in old[d]:
                            hit[words.bounds[d - i] + s["start"]] += 1
                            hit[words.bounds[d - i] + s["end"]] -= 1
                covered = np.cumsum(hit[:-1]) > 0
                total = text.group_sum(covered.astype(np.int64), words.bounds)
                n_hit[i:j] = total
                for d in np.flatnonzero(total):
                    a, b = words.bounds[d], words.bounds[d + 1]
                    found = _runs(covered[a:b])
                    spans[i + d] = [{"start": x, "end": y} for x, y in found.tolist()]
                    if with_text:
                        raw, at, kept = buf[off[d] : off[d + 1]].tobytes(), 0, []
                        for x, y in found.tolist():
                            kept.append(raw[at : words.starts[a + x] - off[d]])
                            at = int(words.ends[a + y - 1] - off[d])
                        clean[i + d] = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(f.name) for f in rest),
                    pa.array(n_words), pa.array(n_hit), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(item)), pa.array(clean, pa.string()),
                ],
                names=[*(f.name for f in rest), *_NAMES],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.mapInArrow(run, fields + ADDED.format(kind.simpleString()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (words of merged occurrences), item_ids, and clean_text without the spans.

    ``benchmark`` has item_id, of any type that sorts, and text. A benchmark of
    several blocks takes one pass over the documents after another, each written
    as a table, so that one block at a time is held.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    kind = benchmark.schema["item_id"].dataType
    items = benchmark.select("item_id", "text").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    out = store.without(docs, *_NAMES)
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in block.collect()], window))
        out = _search(out, shared, kind, with_text)
        if k + 1 < blocks:
            out = store.cut(out, "decontaminated")
            shared.destroy()
    return out
