"""Hard negatives by inner product, found in ball trees by branch and bound.

Rows are dealt to shards by their id. A shard has a ball tree for each label;
a node is a centre and a radius, so that a query's inner products with all
points below lie within |query| * radius of that with the centre. Queries, the
different vectors of the anchors, go to every shard, stream through its trees
in batches, and leave a node out when its bounds lie outside of the score
window or strictly beneath the query's current kth score (a tie may still win
by its id). Leaves are multiplied with all queries that reach them at once.
Each shard returns its first few rows of a query; the shards' are merged.

First the positives are found, in the trees of a query's own label; each
positive's score then opens a window, and the windows of a query go through the
trees of all other labels together.

Inner products are exact: whole entries in double precision as long as the sums
stay below 2**53, in Python's whole numbers beyond.

Scale: there are as many shards as partitions while each has some thousand
rows, at most ``SPREAD``, and more only where a shard would hold over
``SHARD_ROWS``; a query is sent to a shard once. Equal vectors of a label are
equally near to everything, so that a shard keeps the first ids of each, as many
as can rank: exact, and a vector that a third of all rows have costs no more
than another. A shard's task holds its points and one batch of queries.

Defined cases: rows with a null label, a null vector or a null or non-finite
entry take no part; equal rows (id, label, vector) count once, rows that share
only the id count each; shorter vectors end in zeros; a null id is no anchor
and comes after all others of its score; ties go by id; with fewer partners
than asked for, all are returned; empty tables, and anchors without positives
or negatives, give no rows. Other columns are not read. Whole entries are at
most ``vectors.LARGEST`` in size and scores must fit a long; both are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, vectors

#: Points of a leaf; queries of a batch.
LEAF, BATCH = 256, 1024
#: Rows of a shard at most on average, rows that are worth a shard of their own, and shards that small tables are spread over.
SHARD_ROWS, LEAST_ROWS, SPREAD = 1 << 18, 4096, 100
#: Stands for a null id, after all others.
_LAST = 2**63 - 1
_FOUND = "key string, ask long, vec_id long, score long, same boolean"


class Tree:
    """Points ``at`` (places in a matrix) under balls of at most ``LEAF`` points, halved across their longest stretch."""

    def __init__(self, points: np.ndarray, at: np.ndarray):
        rows = points[at].astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int]] = []  # centre, radius, places of a leaf, second child
        stack = [(np.arange(len(at)), -1)]
        while stack:
            own, parent = stack.pop()
            if parent >= 0:
                c, r, _, _ = self.nodes[parent]
                self.nodes[parent] = (c, r, None, len(self.nodes))
            part = rows[own]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            if len(own) <= LEAF or not away.any():
                self.nodes.append((centre, float(away.max()), at[own], 0))
                continue
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            half = np.argpartition(part @ (other - one), len(own) // 2)
            self.nodes.append((centre, float(away.max()), None, 0))
            stack.append((own[half[len(own) // 2 :]], len(self.nodes) - 1))
            stack.append((own[half[: len(own) // 2]], -1))


class Shard:
    """The points of a shard: the first ``kept`` ids of every label and vector, a tree for every label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, kept: int):
        by = np.lexsort((ids, labels))
        ids, labels, x = ids[by], labels[by], np.ascontiguousarray(x[by])
        if x.shape[1]:
            bytes_ = np.hstack([labels[:, None].astype(np.int64), x]).view(f"V{8 * (x.shape[1] + 1)}").ravel()
            same = np.unique(bytes_, return_inverse=True)[1]
        else:
            same = np.unique(labels, return_inverse=True)[1]
        group = np.argsort(same, kind="stable")
        first = np.searchsorted(same[group], same[group])
        keep = np.zeros(len(ids), bool)
        keep[group[np.arange(len(ids)) - first < kept]] = True
        by = np.argsort(ids[keep], kind="stable")
        self.ids, self.labels, self.x = ids[keep][by], labels[keep][by], x[keep][by]
        self.largest = int(np.abs(self.x).max(initial=0))
        if self.largest > vectors.LARGEST:
            raise ValueError(f"entries up to {self.largest}: at most {vectors.LARGEST} are offered")
        self.trees = {label: Tree(self.x, np.flatnonzero(self.labels == label)) for label in np.unique(self.labels).tolist()}

    def search(self, q: np.ndarray, labels: np.ndarray, own: np.ndarray, lows: np.ndarray, highs: np.ndarray, same_label: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For asks (query ``own``, scores from ``lows`` to ``highs``): ask, place and score of the first ``k`` points of its label, or of others."""
        n, m = len(self.ids), max(self.x.shape[1], q.shape[1])
        x = np.pad(self.x, ((0, 0), (0, m - self.x.shape[1])))
        q = np.pad(q, ((0, 0), (0, m - q.shape[1])))
        bound = max(m, 1) * max(self.largest, 1) * int(np.abs(q).max(initial=1))
        exact = np.float64 if bound < 2**53 and (bound + 1) * n < 2**62 else object
        x, qf, q, none = x.astype(exact), q.astype(np.float64), q.astype(exact), -(2**62) if exact is not object else -(10**60)
        if exact is object:  # the ends of longs are no bounds
            lows, highs = (np.where(np.abs(a.astype(float)) >= 2.0**63, 10**59 * np.sign(a).astype(object), a.astype(object)) for a in (lows, highs))
        norms = np.sqrt((qf**2).sum(axis=1))
        best = np.full((len(own), k), none, object if exact is object else np.int64)
        score = lambda keys: keys // n  # noqa: E731  keys order by score, then by the smaller place
        for label, tree in self.trees.items():
            stack = [(0, np.flatnonzero((labels[own] == label) == same_label))]
            while stack:
                node, asks = stack.pop()
                if not len(asks):
                    continue
                centre, radius, leaf, second = tree.nodes[node]
                centre = np.pad(centre, (0, m - len(centre)))
                used = np.unique(own[asks])
                mid = qf[used] @ centre
                slack = norms[used] * radius + 1 + 1e-9 * norms[used] * (np.sqrt(centre @ centre) + radius)
                place = np.searchsorted(used, own[asks])
                upper, lower = (mid + slack)[place], (mid - slack)[place]
                asks = asks[(upper >= lows[asks]) & (lower <= highs[asks]) & (upper >= score(best[asks, -1]).astype(np.float64))]
                if leaf is None:
                    first = qf[used].sum(axis=0) @ np.pad(tree.nodes[node + 1][0] - tree.nodes[second][0], (0, m - len(tree.nodes[second][0])))
                    stack.extend([(second, asks), (node + 1, asks)] if first >= 0 else [(node + 1, asks), (second, asks)])
                elif len(asks):
                    used = np.unique(own[asks])
                    found = q[used] @ x[leaf].T
                    found = (found if exact is object else found.astype(np.int64))[np.searchsorted(used, own[asks])]
                    keys = np.where((found >= lows[asks, None]) & (found <= highs[asks, None]), found * n + (n - 1 - leaf), none)
                    better = keys.max(axis=1) > best[asks, -1]
                    both = np.concatenate([best[asks[better]], keys[better]], axis=1)
                    if exact is not object:
                        both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    best[asks[better]] = np.sort(both, axis=1)[:, ::-1][:, :k]
        ask, column = np.nonzero(best > none)
        keys = best[ask, column]
        scores = score(keys)
        if len(scores) and max(abs(int(scores.max())), abs(int(scores.min()))) >= 2**63:
            raise ValueError("scores do not fit a long")
        return ask, (n - 1 - keys % n).astype(np.int64), scores.astype(np.int64)


def _searched(points: DataFrame, queries: DataFrame, shards: int, same_label: bool, k: int, kept: int) -> DataFrame:
    """Each shard's first ``k`` rows of each ask of ``queries`` (key, label, x, asks)."""
    dealt = points.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "label", "x",
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<struct<ask:bigint,low:bigint,high:bigint>>").alias("asks"),
    ).unionByName(
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("long").alias("vec_id"), "label", "x", "key", "asks")
    ).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, at = None, -1
        for batch in batches:
            place, is_query = batch.column("shard").to_numpy(), ~batch.column("key").is_null().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((place[1:] != place[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, len(place)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if place[a] != at:
                    held, shard, at = [], None, place[a]
                if not is_query[a]:
                    held.append(part.select(["vec_id", "label", "x"]))
                    continue
                if shard is None and held:
                    table = pa.Table.from_batches(held)
                    shard = Shard(table["vec_id"].to_numpy(), table["label"].to_numpy(), vectors.matrix(table["x"]), kept)
                    held = []
                if shard is not None:
                    yield _answers(shard, part, same_label, k)

    store.bound_batches(points.sparkSession, rows=BATCH)
    return dealt.mapInArrow(run, _FOUND)


def _answers(shard: Shard, part: pa.RecordBatch, same_label: bool, k: int) -> pa.RecordBatch:
    q, labels, asks = vectors.matrix(part.column("x")), part.column("label").to_numpy(), part.column("asks")
    ends = asks.offsets.to_numpy()
    each = asks.values.slice(ends[0], ends[-1] - ends[0])
    own = np.repeat(np.arange(len(q)), np.diff(ends))
    names, lows, highs = (each.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    ask, place, score = shard.search(q, labels, own, lows, highs, same_label, k)
    width = min(q.shape[1], shard.x.shape[1])
    there = own[ask]
    same = (shard.x[place][:, :width] == q[there][:, :width]).all(axis=1) & ~shard.x[place][:, width:].any(axis=1) & ~q[there][:, width:].any(axis=1) & (shard.labels[place] == labels[there])
    return pa.RecordBatch.from_arrays([part.column("key").take(pa.array(there)), pa.array(names[ask]), pa.array(shard.ids[place]), pa.array(score), pa.array(same)], names=["key", "ask", "vec_id", "score", "same"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each ask, with their ``rank`` from 1."""
    order = Window.partitionBy("key", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id (a long), label (a whole number) and the vector. An anchor's positives are its first rows of the same label by
    score; of each, the first rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    taken = rows.filter(F.col("label").isNotNull() & vectors.finite(F.col(vector)))
    points = taken.select(F.coalesce("vec_id", F.lit(_LAST)).cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vectors.whole(F.col(vector), scale).alias("x"), F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor"))
    points = store.cut(points.distinct(), "points")
    n, spread = taken.count(), store.partitions(rows.sparkSession)
    shards = max(-(-n // SHARD_ROWS), min(spread, SPREAD, -(-n // LEAST_ROWS)), 1)
    key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>")), 256)
    anchors = points.filter("anchor").withColumn("key", key)
    queries = anchors.select("key", "label", "x").distinct()
    everything = F.array(F.struct(F.lit(0).cast("long").alias("ask"), F.lit(-(2**63)).alias("low"), F.lit(_LAST).alias("high")))
    kept = max(positives + 1, negatives)
    near = _searched(points, queries.withColumn("asks", everything), shards, True, positives + 1, kept)
    near = store.cut(_first(near, positives + 1).select("key", "vec_id", "score", "same", "rank"), "positives")

    s = F.col("score")  # a window of negative scores is empty
    windows = near.filter((s >= 0) & (F.lit(low) <= high)).select("key", F.struct(s.alias("ask"), F.expr(f"(score * {low} + 99) div 100").alias("low"), F.expr(f"score * {high} div 100").alias("high")).alias("ask"))
    asks = windows.groupBy("key").agg(F.collect_set("ask").alias("asks"))  # at most positives + 1
    hard = _first(_searched(points, queries.join(asks, "key"), shards, False, negatives, kept), negatives)

    others = Window.partitionBy("anchor_id", "key").orderBy("place")
    pairs = anchors.select(F.col("vec_id").alias("anchor_id"), "key").join(near.withColumnRenamed("rank", "place"), "key")
    pairs = pairs.filter(~(F.col("same") & (F.col("vec_id") == F.col("anchor_id")))).withColumn("nth", F.row_number().over(others)).filter(F.col("nth") <= positives)
    pairs = pairs.select("key", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select("key", F.col("ask").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return pairs.join(hard, ["key", "positive_score"]).select("anchor_id", back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")
