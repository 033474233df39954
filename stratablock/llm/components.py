"""Connected components of a table of links, by alternating large and small stars.

Every round hangs neighbours on the smallest node that is known nearby; rounds
grow with the logarithm of the longest chain. Nodes and links stay in tables:
minima are partial aggregates, and a hub's links meet its minimum by a join
that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Links that a task contracts at a time.
LOCAL = 500_000


def _contracted(links: DataFrame) -> DataFrame:
    """Each task's links as stars of the smallest nodes: as many classes, fewer links, shorter chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def rows() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in up]
            pairs = [(x, r) for x, r in pairs if x != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["hi", "lo"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
            if len(up) > LOCAL:
                yield rows()
                up = {}
        yield rows()

    return links.mapInArrow(run, "hi long, lo long")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that is not its own root."""
    e = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    e = store.cut(_contracted(e), "links")
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        nearest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(nearest, "hi")
        old, e = e, store.cut(
            small.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(nearest.select("hi", F.col("m").alias("lo")))
            .distinct(),
            "links",
        )
        store.drop(old)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
