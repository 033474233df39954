"""Bringing equal windows of a corpus together without comparing all with all.

A window is ``window`` consecutive units (words or bytes) of one document. Its
anchor is the smallest hash among its runs of ``gram`` units, leftmost on
ties, so equal windows have equal anchors. Consecutive windows of a document
with the anchor in the same place form a segment; segments with equal anchors
meet in one shard, where an engine (suffix automaton or suffix array) decides
exactly which windows occur more than once.

Scale: texts are cut into segments once, and kept in a table with 24 bytes a
segment; later passes read only these. An anchor that occurs once in the corpus
cannot repeat a window, and is left out before anything is shuffled (``seen``);
one that always stands in the same segment repeats that segment as a whole: its
shard would be one text with its number. Equal segments are sent once a task
with their number, so a passage in a third of all documents is one row a task.
What the engine finds goes back to places by a join that Spark can split on
skew. First only hashes travel; the text of each different segment is then sent
from one place that was chosen for it. An anchor with over ``hot`` different
segments (a passage with different surroundings each time) is split by a longer
one, the window itself: windows that may repeat go to shards of their own, so
the work on one anchor is spread.

Texts travel in compressed bundles for their partition, segments and whole
documents alike, so the disk that a shuffle takes stays under the input's size.
A task holds the segments, or the spans, of one partition at a time:
``spark.sql.shuffle.partitions`` sets their size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seen, store, text

#: Bytes of texts that a task gathers before it bundles them.
BUNDLE_BYTES = 12_000_000
#: Bitmaps have eight bits a segment, up to so many (32 MB); beyond, more candidates are sent.
MOST_BITS = 28
_POS_BITS = 24
_STRIDE = 1 << 23


@dataclass(frozen=True)
class Scheme:
    """Window and anchor length in units; how a slice's units are found; the engine of a shard.

    ``alone``: whether contents that are alone with their anchor go to the engine too.
    """

    window: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], "Units"]
    engine: Callable[[list[tuple[int, bytes]], int], list[np.ndarray]]
    shard_bytes: int
    hot: int = 2000
    alone: bool = False


@dataclass
class Units:
    """Unit values of a slice of documents, each document's bounds, and each unit's first and last byte."""

    values: np.ndarray
    bounds: np.ndarray
    first: np.ndarray | None = None
    end: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.first is None else (int(self.first[a]), int(self.end[b - 1]))


def word_units(buf: np.ndarray, offsets: np.ndarray) -> Units:
    w = text.Words(buf, offsets)
    return Units(w.hashes(), w.bounds, w.starts, w.ends)


def byte_units(buf: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(text.byte_values(buf), offsets)


def segments(u: Units, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments: first window's start, last window's start, anchor key, content hash."""
    n = len(u.values)
    end = np.repeat(u.bounds[1:], np.diff(u.bounds))
    low = np.uint64((1 << _POS_BITS) - 1)
    parts = []
    for s in range(0, max(1, n - window + 1), _STRIDE):
        stop = min(n, s + _STRIDE + window - 1)
        roll = text.Rolling(u.values[s:stop])
        g = roll.windows(gram)
        if stop - s < window:
            continue
        m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        width, span = 1, window - gram + 1
        while width * 2 <= span:  # minima of windows of doubling width
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        starts = np.flatnonzero(np.arange(s, s + len(m)) + window <= end[s : s + len(m)])
        if not len(starts):
            continue
        pos = (m[starts] & low).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        a, b, key = starts[first], starts[last], g[pos[first]]
        content = text.mix(roll.spans(a, b + window) ^ text.mix(key + (b - a).astype(np.uint64)))
        parts.append((a + s, b + s, key, content))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: A segment: first and last window's start within its document, anchor key, content hash.
RECORD = np.dtype([("a", "<i4"), ("b", "<i4"), ("key", "<u8"), ("ck", "<u8")])


def _records(u: Units, a: np.ndarray, b: np.ndarray, key: np.ndarray, ck: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records in order of their documents, and how many each document has."""
    doc = np.searchsorted(u.bounds, a, "right") - 1
    out = np.empty(len(a), RECORD)
    base = u.bounds[doc]
    out["a"], out["b"], out["key"], out["ck"] = a - base, b - base, key, ck
    return out, np.bincount(doc, minlength=len(u.bounds) - 1)


def _packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """The records of each document, as bytes."""
    found = np.concatenate([np.empty(0, RECORD), *(x for x, _ in parts)])
    ends = np.concatenate([[0], *(n for _, n in parts)]).cumsum() * RECORD.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found.view(np.uint8))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The records of a batch, and the place of each one's document."""
    _, off, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, RECORD), np.zeros(0, np.int64)
    ends = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(RECORD)
    return found, np.repeat(np.arange(len(column)), np.diff(ends) // RECORD.itemsize)


def _with_records(docs: DataFrame, records: Callable[[pa.RecordBatch], pa.Array], only: bool = False) -> DataFrame:
    """``docs`` with the records of each row in ``__segments``; with ``only``, rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__segments")
            made = records(batch)
            out = batch.append_column("__segments", made) if at < 0 else batch.set_column(at, "__segments", made)
            yield out.filter(pc.greater(pc.binary_length(made), 0)) if only else out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "__segments")
    return docs.mapInArrow(run, f"{fields}, __segments binary")


@dataclass
class Bitmaps:
    """Of anchors (repeated, mixed, busy), of the segments whose text is sent, and of those found to repeat."""

    bits: int
    anchors: seen.Bitmaps
    chosen: np.ndarray | None = None
    found: np.ndarray | None = None


def _busy(found: np.ndarray, maps: Bitmaps) -> np.ndarray:
    return seen.busy(maps.anchors[2], found["key"]) if maps.anchors[2] is not None else np.zeros(len(found), bool)


def _windows(u: Units, found: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of the given segments on its own: where it starts among the units, and its hash."""
    n = found["b"] - found["a"] + 1
    first = u.bounds[doc] + found["a"]
    each = np.repeat(first + n - np.cumsum(n), n) + np.arange(n.sum())
    return each, text.Rolling(u.values).spans(each, each + window) if len(each) else np.zeros(0, np.uint64)


def _busy_windows(batch: pa.RecordBatch, scheme: Scheme, maps: Bitmaps) -> Iterator[tuple[Units, np.ndarray, np.ndarray]]:
    """For each slice of a batch, the windows of segments of busy anchors."""
    found, doc = _unpacked(batch.column(batch.schema.get_field_index("__segments")))
    hot = _busy(found, maps)
    found, doc = found[hot], doc[hot]
    none = np.zeros(0, np.int64)
    for i, j, buf, off in text.slices(*text.buffers(batch.column(batch.schema.get_field_index("text")))):
        x, y = np.searchsorted(doc, [i, j])
        if x == y:
            yield Units(none.view(np.uint64), np.zeros(j - i + 1, np.int64)), none, none.view(np.uint64)
            continue
        u = scheme.units(buf, off)
        yield u, *_windows(u, found[x:y], doc[x:y] - i, scheme.window)


def _content(windows: np.ndarray) -> np.ndarray:
    return text.mix(windows + np.uint64(3))


def _repeats(batch: pa.RecordBatch, scheme: Scheme, maps: Bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records of a batch that may repeat, their documents' places, whether each is a single window of a busy
    anchor, and whether it surely repeats as it is: its anchor always stands in the same content."""
    found, doc = _unpacked(batch.column(batch.schema.get_field_index("__segments")))
    fine = batch.column(batch.schema.get_field_index("__fine")).to_numpy(zero_copy_only=False)[doc] if len(doc) else np.zeros(0, bool)
    may = fine | (seen.repeated(maps.anchors[0], found["key"], maps.bits) & ~_busy(found, maps))
    found, doc, fine = found[may], doc[may], fine[may]
    sure = np.zeros(len(found), bool) if scheme.alone else ~fine & ~seen.repeated(maps.anchors[1], found["key"], maps.bits)
    return found, doc, fine, sure


def _places(found: np.ndarray, who: np.ndarray) -> np.ndarray:
    """A fingerprint of each record's place: its document, where it stands, and its content."""
    return text.mix(found["ck"] ^ text.mix(who + found["a"].astype(np.uint64)))


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, by[cuts[p] : cuts[p + 1]]


def _reduced(key: np.ndarray, ck: np.ndarray, times: np.ndarray, size: np.ndarray, place: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per content, ordered by key: total times and the smallest place."""
    by = np.lexsort((place, ck, key))
    key, ck, times, size, place, fine = key[by], ck[by], times[by], size[by], place[by], fine[by]
    first = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), (ck[1:] != ck[:-1]) | (key[1:] != key[:-1])))
    return key[first], ck[first], np.add.reduceat(times, first) if len(first) else times, size[first], place[first], fine[first]


def _contents(rows: DataFrame, scheme: Scheme, shared, parts: int) -> DataFrame:
    """Candidates without their text, once a task, by the partition of their anchor: bundles of
    key, content hash, times, length in units, one place, and whether it is a single window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            rows = _reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))
            out = [(p, pickle.dumps(tuple(x[at] for x in rows), 5)) for p, at in _by_part((rows[0] % np.uint64(parts)).astype(np.int64), parts)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "bundle"])

        for batch in batches:
            found, doc, fine, sure = _repeats(batch, scheme, shared.value)
            found, doc, fine = found[~sure], doc[~sure], fine[~sure]
            if len(found):
                who = batch.column(batch.schema.get_field_index("__who")).to_numpy().view(np.uint64)[doc]
                size = found["b"].astype(np.int64) - found["a"] + scheme.window
                held.append((found["key"], found["ck"], np.ones(len(size), np.int64), size, _places(found, who), fine))
                n += len(found)
            if n >= 500_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return rows.select("__who", "__segments", "__fine").mapInArrow(run, "part int, bundle binary")


def _groups(scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's contents: segments alone with their anchor, which repeat as a whole or not at all,
    with their span; and one pack of all others, which need the engine."""
    bundles = [(batch.column(0)[k].as_py(), pickle.loads(batch.column(1)[k].as_py())) for batch in batches for k in range(batch.num_rows)]
    if not bundles:
        return
    key, ck, times, size, place, fine = _reduced(*(np.concatenate(x) for x in zip(*(b for _, b in bundles), strict=True)))
    edge = np.append(True, key[1:] != key[:-1])
    alone = edge & np.append(edge[1:], True)
    if scheme.alone:
        fine = np.ones(len(fine), bool)
    again = np.flatnonzero(alone & ~fine & (times > 1))
    spans = [np.array([0, n], np.int32).tobytes() for n in size[again].tolist()]
    n = len(again)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int32()), pa.array(ck[again].view(np.int64)), pa.array(spans, pa.binary()), pa.nulls(n, pa.binary())], names=["part", "ck", "spans", "pack"]
    )
    engine = ~alone | (fine & (times > 1))
    if engine.any():
        pack = pickle.dumps((key[engine], ck[engine], times[engine], place[engine]), 5)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bundles[0][0]], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack], pa.binary())], names=["part", "ck", "spans", "pack"]
        )


def _texts(rows: DataFrame, scheme: Scheme, shared, parts: int) -> DataFrame:
    """Compressed bundles of the texts of chosen places, by the partition of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        cks, keys, bodies, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            c, k = np.array(cks, np.uint64), np.array(keys, np.uint64)
            out = []
            for p, at in _by_part((k % np.uint64(parts)).astype(np.int64), parts):
                own = [bodies[r] for r in at.tolist()]
                out.append((p, pack(pickle.dumps((c[at], np.array([len(x) for x in own], np.int64), b"".join(own)), 5))))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "bundle"])

        for batch in batches:
            found, doc, _, sure = _repeats(batch, scheme, shared.value)
            who = batch.column(batch.schema.get_field_index("__who")).to_numpy().view(np.uint64)[doc]
            mine = ~sure & seen.repeated(shared.value.chosen, _places(found, who), shared.value.bits)
            found, doc = found[mine], doc[mine]
            if not len(found):
                continue
            own = np.unique(doc)  # only these documents' units are needed
            doc = np.searchsorted(own, doc)
            column = batch.column(batch.schema.get_field_index("text")).take(pa.array(own))
            for i, j, buf, off in text.slices(*text.buffers(column)):
                x, y = np.searchsorted(doc, [i, j])
                u = scheme.units(buf, off)
                first = u.bounds[doc[x:y] - i]
                whole = buf.tobytes()
                for a, b in zip((first + found["a"][x:y]).tolist(), (first + found["b"][x:y] + scheme.window).tolist(), strict=True):
                    a, b = u.span(a, b)
                    bodies.append(whole[a:b])
                    held += b - a
            cks.extend(found["ck"].tolist())
            keys.extend(found["key"].tolist())
            if held >= BUNDLE_BYTES:
                yield flush()
                cks, keys, bodies, held = [], [], [], 0
        if cks:
            yield flush()

    return rows.select("text", "__who", "__segments", "__fine").mapInArrow(run, "part int, bundle binary")


def _engine(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The engine over shards of whole anchor groups of a partition: the pack of its contents, then their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        packs, bodies = [], {}
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 0:
                    packs.append(pickle.loads(raw))
                    continue
                ck, size, whole = pickle.loads(unpack(raw))
                end = np.cumsum(size)
                for c, x, y in zip(ck.tolist(), (end - size).tolist(), end.tolist(), strict=True):
                    bodies[c] = whole[x:y]
        if not packs:
            return
        key, ck, times, _ = (np.concatenate(x) for x in zip(*packs, strict=True))
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        shard, hits, spans, held = [], [], [], 0

        def solve() -> None:
            for r, found in zip(shard, scheme.engine([(int(times[r]), bodies[int(ck[r])]) for r in shard], scheme.window), strict=True):
                if len(found):
                    hits.append(int(ck[r : r + 1].view(np.int64)[0]))
                    spans.append(np.ascontiguousarray(found, np.int32).tobytes())
            shard.clear()

        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = [r for r in range(x, y) if int(ck[r]) in bodies]
            shard.extend(own)
            held += sum(len(bodies[int(ck[r])]) for r in own)
            if held >= scheme.shard_bytes:
                solve()
                held = 0
        if shard:
            solve()
        yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array(spans, pa.binary())], names=["ck", "spans"])

    return run


def _occurrences(rows: DataFrame, scheme: Scheme, shared) -> DataFrame:
    """part, doc_id, hash, at of repeats: with their spans if they repeat as they are, else with ck.

    Equal rows of a task give their places once.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    window = scheme.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            found, doc, fine, sure = _repeats(batch, scheme, shared.value)
            told = sure | seen.repeated(shared.value.found, text.mix(found["ck"]), shared.value.bits)
            found, doc, fine, sure = found[told], doc[told], fine[told], sure[told]
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            once = np.zeros(batch.num_rows, bool)
            level = np.zeros(batch.num_rows, bool)
            level[doc[fine]] = True
            for k in np.unique(doc).tolist():
                who = (ids[k], hashes[k], bool(level[k]))
                once[k] = who not in done
                done.add(who)
            if len(done) > 200_000:
                done.clear()
            keep = once[doc]
            found, doc, sure = found[keep], doc[keep], sure[keep]

            def out(doc: np.ndarray, at: np.ndarray, cks: pa.Array, spans: pa.Array, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take = pa.array(doc)
                return pa.RecordBatch.from_arrays(
                    [cks, batch.column(2).take(take), batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), spans],
                    names=["ck", "part", "doc_id", "hash", "at", "spans"],
                )

            # all whole repeats of a document are one row
            x, y, own = found["a"][sure], found["b"][sure], doc[sure]
            if len(own):
                # runs of windows that follow one another are one span
                head = np.append(True, (own[1:] != own[:-1]) | (x[1:] > y[:-1] + 1))
                tail = np.append(head[1:], True)
                x, y, own = x[head], y[tail], own[head]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                pairs = np.stack([x, y + window], axis=1).astype(np.int32)
                packed = [p.tobytes() for p in np.split(pairs, first[1:])]
                yield out(own[first], np.zeros(len(first)), pa.nulls(len(first), pa.int64()), pa.array(packed, pa.binary()))
            found, doc = found[~sure], doc[~sure]
            if len(doc):
                yield out(doc, found["a"], pa.array(found["ck"].view(np.int64)), pa.nulls(len(doc), pa.binary()))

    return rows.select("doc_id", "__hash", "__part", "__segments", "__fine").mapInArrow(run, f"ck long, part int, doc_id {kind}, hash long, at int, spans binary")


def _bundled(docs: DataFrame) -> DataFrame:
    """Whole rows of ``docs`` in compressed bundles by ``__part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            part = table.column("__part").to_numpy()
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
            parts, blobs = [], []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                piece = table.take(pa.array(by[x:y])).combine_chunks()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_table(piece)
                parts.append(int(part[by[x]]))
                blobs.append(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([x.to_pybytes() for x in blobs], pa.binary())], names=["part", "bundle"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BUNDLE_BYTES:
                yield flush()
                held, size = [], 0
        if sum(x.num_rows for x in held):
            yield flush()

    return docs.mapInArrow(run, "part int, bundle binary")


Finish = Callable[[pa.RecordBatch, list], pa.RecordBatch]


def _finished(finish: Finish) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one partition after another: spans first, then bundles of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, spans = None, [], {}

        def gather() -> None:
            """Spans of each (doc_id, hash): all pairs of start and end."""
            for doc, hashed, at, found in held:
                for d, h, x, f in zip(doc.to_pylist(), hashed.to_pylist(), at.to_pylist(), found.to_pylist(), strict=True):
                    spans.setdefault((d, h), []).append((x, f))
            held.clear()

        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])))
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(parts)], strict=True):
                if parts[x] != part:
                    part = parts[x]
                    held.clear()
                    spans = {}
                piece = batch.slice(x, y - x)
                if kinds[x] == 0:
                    held.append([piece.column(k) for k in range(2, 6)])
                    continue
                gather()
                for blob in piece.column(6):
                    for docs in pa.ipc.open_stream(blob.as_buffer()):
                        who = zip(docs.column(docs.schema.get_field_index("doc_id")).to_pylist(), docs.column(docs.schema.get_field_index("__hash")).to_pylist(), strict=True)
                        yield finish(docs, [spans.get(w) for w in who])

    return run


def apply_to_repeats(docs: DataFrame, scheme: Scheme, name: str, finish: Finish, schema: str) -> DataFrame:
    """``finish`` over all rows of ``docs`` (with doc_id and text; any other columns), in batches.

    It gets, for each row, None or the (at, spans) of windows that also start
    elsewhere, to be read with ``covered``. Rows are told apart by id and
    content, so equal rows get equal results; each still counts as a place.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    parts = store.partitions(spark)
    own = docs = store.without(docs, "__hash", "__who", "__part", "__segments", "__fine")
    own = own.withColumn("__hash", F.xxhash64("text")).withColumn("__who", F.xxhash64("doc_id", "__hash"))
    own = own.withColumn("__part", F.pmod("__who", F.lit(parts)).cast("int"))
    window, gram, units = scheme.window, scheme.gram, scheme.units

    def whole(batch: pa.RecordBatch) -> pa.Array:
        each = [units(buf, off) for _, _, buf, off in text.slices(*text.buffers(batch.column(batch.schema.get_field_index("text"))))]
        return _packed([_records(u, *segments(u, window, gram)) for u in each])

    # texts are cut up once; all passes below read the segments only, but where they need some texts
    table = store.cut(_with_records(own, whole), f"{name}-segments")
    many = (table.agg(F.sum(F.octet_length("__segments"))).first()[0] or 0) // RECORD.itemsize
    bits = min(max(20, (8 * many).bit_length()), MOST_BITS)

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        found, _ = _unpacked(batch.column(0))
        return found["key"].copy(), found["ck"].copy()

    maps = Bitmaps(bits, seen.build(table.select("__segments"), keys, scheme.hot, bits))
    rows = table.withColumn("__fine", F.lit(False))
    if maps.anchors[2] is not None:
        first = spark.sparkContext.broadcast(maps)

        def windows(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
            return np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in _busy_windows(batch, scheme, first.value))]), None

        again = spark.sparkContext.broadcast(seen.build(table.select("text", "__segments"), windows, bits=bits)[0])

        def single(batch: pa.RecordBatch) -> pa.Array:
            out = []
            for u, at, h in _busy_windows(batch, scheme, first.value):
                may = seen.repeated(again.value, h, bits)
                out.append(_records(u, at[may], at[may], h[may], _content(h[may])))
            return _packed(out)

        fine = store.cut(_with_records(table, single, only=True), f"{name}-windows")
        rows = rows.unionByName(fine.withColumn("__fine", F.lit(True)))
        first.destroy()
        again.destroy()
    shared = spark.sparkContext.broadcast(maps)
    groups = store.cut(_contents(rows, scheme, shared, parts).repartitionById(parts, "part").mapInArrow(partial(_groups, scheme), "part int, ck long, spans binary, pack binary"), f"{name}-groups")
    packs = groups.filter("pack is not null").select("part", "pack")

    def chosen(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
        return np.concatenate([np.zeros(0, np.uint64), *(pickle.loads(x)[3] for x in batch.column(0).to_pylist())]), None

    # each content's text is sent from one place
    maps.chosen = seen.build(packs.select("pack"), chosen, bits=bits, least=1)[0]
    shared.destroy()
    full = spark.sparkContext.broadcast(maps)
    both = packs.select("part", F.lit(0).alias("kind"), F.col("pack").alias("bundle")).unionByName(_texts(rows, scheme, full, parts).select("part", F.lit(1).alias("kind"), "bundle"))
    solved = both.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_engine(scheme), "ck long, spans binary")
    found = groups.filter("ck is not null").select("ck", "spans").unionByName(store.cut(solved, name))
    full.destroy()

    def repeating(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
        return text.mix(batch.column(0).to_numpy().view(np.uint64)), None

    last = spark.sparkContext.broadcast(Bitmaps(bits, maps.anchors, found=seen.build(found.select("ck"), repeating, bits=bits, least=1)[0]))
    # rows that bring their spans get a key of their own, so that they spread and match nothing
    places = _occurrences(rows, scheme, last).withColumn("ck", F.coalesce("ck", F.xxhash64("doc_id", "hash")))
    spans = (
        places.withColumnRenamed("spans", "own")
        .join(found, "ck", "left")
        .withColumn("spans", F.coalesce("own", "spans"))
        .filter("spans is not null")
        .select("part", F.lit(0).alias("kind"), "doc_id", "hash", "at", "spans", F.lit(None).cast("binary").alias("bundle"))
    )
    kind = docs.schema["doc_id"].dataType
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", kind), ("hash", "long"), ("at", "int"), ("spans", "binary"))]
    bundles = _bundled(table.select(*docs.columns, "__hash", "__part")).select("part", F.lit(1).alias("kind"), *nothing, "bundle")
    return spans.unionByName(bundles).repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_finished(finish), schema)


def covered(n: int, found) -> np.ndarray:
    """Which of ``n`` units the (at, spans) of a document cover."""
    step = np.zeros(n + 1, np.int64)
    pairs = np.concatenate([np.frombuffer(spans, np.int32).reshape(-1, 2) + at for at, spans in found])
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0
