"""Best-fit packing of tokenized documents by minimum bin slack.

Documents become token ids and are cut to pieces of at most ``capacity``. Only
how many pieces there are of each length decides the packing, and there are at
most ``capacity`` lengths. So one plan is made on the driver from that
histogram, whatever the number of pieces: per bin, a subset-sum dynamic
program over a bitset of reachable fill levels finds the fullest combination
of available lengths that holds the longest of them; the combination is used
as often as the lengths last and is removed. Pieces then find their place by
their rank within their length.

Ranks: pieces are spread over salted parts of each length, numbered in each
part, and shifted by the sizes of the parts before; no length meets in one
task. The plan has at most some thousand rows and is sent to all tasks.

Defined cases: a null text is empty, a document of the end id alone; equal
rows are packed each; an empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Texts of characters below this are split alike by both tokenizer libraries.
_SAFE = "ɏ"


@cache
def _encoders(vocabulary: str):
    """The tokenizer, and a faster one with the same vocabulary, merges and splitting."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return full, fast


def token_ids(body: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """The tokenizer's ids of a text, without special tokens added."""
    if not body:
        return []
    full, fast = _encoders(vocabulary)
    if max(body) <= _SAFE and SPECIAL not in body:
        return fast.encode_ordinary(body)
    return full.encode(body, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document longer than ``capacity`` is cut so that only its first piece may be shorter."""
    store.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, body in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*token_ids(body, vocabulary), END_ID], "<u4")
                n = len(ids)
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of (length, number) pairs, a multiset whose sum is the largest not over ``room``."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length, number in available:
        left, take = min(number, room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    fill, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            out[length] = out.get(length, 0) + take
            fill -= length * take
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths, each with how many bins it fills."""
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v > 0}
    out = []
    while left:
        longest = next(iter(left))
        rest = [(k, v - (k == longest)) for k, v in left.items() if v - (k == longest) > 0 and k <= capacity - longest]
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[k] // c for k, c in chosen.items())
        out.append((bins, chosen))
        for k, c in chosen.items():
            left[k] -= bins * c
            if not left[k]:
                del left[k]
    return out


def layout(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset), ordered by length and rank."""
    used: dict[int, int] = {}
    rows, bin_ = [], 0
    for bins, chosen in plan:
        at = 0
        for length, c in sorted(chosen.items(), reverse=True):
            rows.append((length, used.get(length, 0), c, bin_, at))
            used[length] = used.get(length, 0) + bins * c
            at += length * c
        bin_ += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), with sequence_id and its offset there."""
    spark = docs.sparkSession
    parts = store.partitions(spark)
    cut = store.cut(pieces(docs, capacity, vocabulary), "pieces")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = cut.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = spark.sparkContext.broadcast(layout(minimum_bin_slack(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        cut.withColumn("rank", F.row_number().over(order) - 1)
        .join(shift, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).cast("long").alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        reach = np.int64(1) << 50
        keys = table[:, 0] * reach + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = table[np.searchsorted(keys, length * reach + rank, "right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            rank = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(at[:, 3] + rank // at[:, 2]), pa.array(at[:, 4] + rank % at[:, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
