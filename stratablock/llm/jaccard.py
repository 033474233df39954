"""N-gram Jaccard join by prefix trees.

A document's set is its distinct word n-grams; documents link when the
Jaccard similarity of their sets reaches the threshold, and classes are the
connected components of links.

1. Equal sets are one node. A bitmap of fixed size (``seen``) tells n-grams
   that occur in one document only, and another those that occur in over
   ``OFTEN``. All sets choose their rarest by one global order: single n-grams,
   repeated ones, those of many documents, each by hash. So what half of a
   corpus has in common leads no block, as long as a set has rarer n-grams.
2. Two sets that link share ``l`` of their rarest ``n - ceil(t n) + l``
   n-grams, for any l; here l is one more than a tenth of the smaller set. A set
   with too few repeated n-grams among these has no partner and sends nothing.
   The others send them; the smallest node of each n-gram leads a block, and
   a node belongs to the blocks of its leaders. It leaves those through which
   it shares least, up to half of what a partner must share with it: of two
   sets that link, both leave out less than they share, so they still meet.
3. A block's nodes are dealt into parts of at most ``CHUNK`` nodes or
   ``PART_BYTES``; every two parts meet in one task. The sets of one are stored
   in a trie; each set of the other traverses it with the overlap so far, shared
   by all sets below a branch, and leaves a branch when what remains of both
   sides cannot reach the threshold. Two nodes that share several blocks count in
   the one of their smallest common leader.
4. What leaves a task is a number of links for each node, and links enough to
   connect its classes: never a row for each pair. Links are contracted to
   components in tables (``components``). A node's links count with the number
   of copies of the other's text, and its own copies are links of each other.

Nothing is capped: the order and the bitmap only decide how much is sent. To
count the links of m near copies takes m * m / 2 comparisons, spread over
(m / ``CHUNK``) ** 2 / 2 tasks.

Defined cases: null and empty texts have no set, no link, and their own id as
class; a text with fewer words than ``n`` has one n-gram, all its words; a row
with a null id takes part, counts as a link, and gets the class of its group;
equal rows have equal results, and each counts as a link of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import seen, store, text
from .components import components

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 75
CHUNK = 128
PART_BYTES = 4_000_000
#: Partners must share one n-gram in so many among the rarest.
SHARE = 10
#: Documents from which on an n-gram counts as frequent.
OFTEN = 64
#: Bits of the bitmap of nodes whose sets are needed (8 MB).
NODE_BITS = 26
_SINGLE = np.uint64(1 << 63)


def sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text, its distinct n-gram hashes (63 bits, never null), ascending."""
    for _, _, buf, off in text.slices(*text.buffers(column)):
        w = text.Words(text.LOWER[buf], off)
        roll = text.Rolling(w.hashes())
        grams = roll.windows(words) >> np.uint64(1)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= words:
                g = np.sort(grams[a : b - words + 1])
                keep = np.ones(len(g), bool)
                keep[1:] = g[1:] != g[:-1]
                yield g[keep]
            elif b > a:
                yield roll.spans(np.array([a]), np.array([b])) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)


def needed(n: int, threshold: int) -> int:
    """The least overlap of a set of ``n`` with any set that links to it."""
    return -(-threshold * n // 100)


def shared_by(n: int) -> int:
    """``l`` of a set of ``n``."""
    return 1 + n // SHARE


def least_shared(n: int, threshold: int) -> int:
    """The least number of n-grams that any partner of a set of ``n`` shares among the rarest."""
    return shared_by(needed(n, threshold))


def _node(s: np.ndarray) -> int:
    """The name of a set: a hash of its members in order."""
    return int(text.signed(text.Rolling(text.mix(s)).spans(np.array([0]), np.array([len(s)])))[0])


def _by_rarity(again: np.ndarray, often: np.ndarray | None) -> np.ndarray:
    """Repeated n-grams, those of many documents last."""
    if often is None or not len(again):
        return again
    late = seen.busy(often, again << np.uint64(1))
    return np.concatenate([again[~late], again[late]])


def _prepare(docs: DataFrame, bitmap, often, words: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, node; and once a task for each node that may have partners, what it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, late = bitmap.value, often.value
        sent: set[int] = set()
        for batch in batches:
            n, node, tokens = [], [], []
            for s in sets(batch.column(1), words):
                n.append(len(s))
                tokens.append(None)
                node.append(_node(s) if len(s) else None)
                if not len(s):
                    continue
                again = seen.repeated(flags, s << np.uint64(1))
                rarest = min(len(s), len(s) - needed(len(s), threshold) + shared_by(len(s)))
                rare = rarest - int((~again).sum())
                if rare >= least_shared(len(s), threshold) and node[-1] not in sent:
                    sent.add(node[-1])
                    tokens[-1] = _by_rarity(s[again], late)[:rare].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(tokens, pa.binary())],
                names=["doc_id", "n_shingles", "node", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, tokens binary")


def _bodies(docs: DataFrame, bitmap, wanted, words: int) -> DataFrame:
    """node, body: the sets of wanted nodes in the global order, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            node, body = [], []
            for s in sets(batch.column(0), words):
                name = _node(s) if len(s) else None
                if name is None or name in sent or not seen.repeated(wanted.value, _spread(np.array([name])), NODE_BITS)[0]:
                    continue
                sent.add(name)
                again = seen.repeated(bitmap.value, s << np.uint64(1))
                node.append(name)
                body.append(np.concatenate([s[again], s[~again] | _SINGLE]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(body, pa.binary())], names=["node", "body"])

    return docs.select("text").mapInArrow(run, "node long, body binary")


def _spread(nodes: np.ndarray) -> np.ndarray:
    return text.mix(nodes.view(np.uint64))


def _tokens(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            if each:
                size = [len(x) for x in each]
                node, n = (np.repeat(batch.column(k).to_numpy(), size) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(node), pa.array(n.astype(np.int32))], names=["token", "node", "n"])

    return rows.filter("tokens is not null").select("node", "n_shingles", "tokens").mapInArrow(run, "token long, node long, n int")


def _blocks(tokens: DataFrame, threshold: int) -> DataFrame:
    """leader, node, tokens: the blocks of each node, less those that it may leave."""
    shared = tokens.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").select("token", "leader")
    each = tokens.join(shared, "token").groupBy("node", "leader").agg(F.count("*").alias("tokens"), F.first("n").alias("n"))
    smallest = F.ceil(F.col("n") * threshold / 100)
    own = Window.partitionBy("node")
    up_to = own.orderBy("tokens", "leader").rowsBetween(Window.unboundedPreceding, 0)
    told = each.withColumns({"all": F.sum("tokens").over(own), "weakest": F.sum("tokens").over(up_to), "least": 1 + F.floor(smallest / SHARE)})
    return told.filter((F.col("all") >= F.col("least")) & (F.col("weakest") > F.floor((F.col("least") - 1) / 2))).select("leader", "node", "tokens")


class PrefixTree:
    """A trie of ascending sets. Edges hold runs of members; a branch knows the sizes of the sets below."""

    __slots__ = ("run", "kids", "ends", "least", "most")

    def __init__(self, run: np.ndarray):
        self.run = run
        self.kids: dict[int, PrefixTree] = {}
        self.ends: list[int] = []
        self.least, self.most = 1 << 60, 0

    def add(self, members: np.ndarray, number: int) -> None:
        at, here, size = 0, self, len(members)
        while True:
            here.least, here.most = min(here.least, size), max(here.most, size)
            if at == size:
                here.ends.append(number)
                return
            nxt = here.kids.get(int(members[at]))
            if nxt is None:
                leaf = PrefixTree(members[at:])
                leaf.least = leaf.most = size
                leaf.ends.append(number)
                here.kids[int(members[at])] = leaf
                return
            m = min(len(nxt.run), size - at)
            differ = np.flatnonzero(nxt.run[:m] != members[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(nxt.run):  # part the edge
                upper = PrefixTree(nxt.run[:same])
                upper.least, upper.most = nxt.least, nxt.most
                nxt.run = nxt.run[same:]
                upper.kids[int(nxt.run[0])] = nxt
                here.kids[int(members[at])] = upper
                nxt = upper
            here, at = nxt, at + same

    def links(self, query: np.ndarray, threshold: int) -> Iterator[int]:
        """All sets that link to ``query``."""
        n = len(query)
        stack = [(kid, 0, 0, 0) for kid in self.kids.values()]
        while stack:
            branch, depth, at, overlap = stack.pop()
            if not _can(overlap, n - at, depth, branch, n, threshold):
                continue
            run = branch.run
            rest = query[at:]
            place = np.searchsorted(rest, run)
            hit = place < len(rest)
            if hit.any():
                overlap += int((rest[place[hit]] == run[hit]).sum())
            at += int(place[-1]) + int(place[-1] < len(rest) and rest[place[-1]] == run[-1])
            depth += len(run)
            if branch.ends and overlap * (100 + threshold) >= threshold * (n + depth):
                yield from branch.ends
            if branch.kids and _can(overlap, n - at, depth, branch, n, threshold):
                stack.extend((kid, depth, at, overlap) for kid in branch.kids.values())


def _can(overlap: int, left: int, depth: int, branch: PrefixTree, n: int, threshold: int) -> bool:
    """Whether what remains of the query and of some set below can reach the threshold."""
    size = min(max(depth + left, branch.least), branch.most)
    return (overlap + min(left, size - depth)) * (100 + threshold) >= threshold * (n + size)


class Classes:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def join_sets(members: list[np.ndarray], threshold: int, others: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """All links (k, y) of ``others`` to ``members``, or among ``members``."""
    tree = PrefixTree(np.zeros(0, np.uint64))
    if others is None:
        for k in sorted(range(len(members)), key=lambda k: len(members[k])):
            for y in tree.links(members[k], threshold):
                yield k, y
            tree.add(members[k], k)
        return
    for y, m in enumerate(members):
        tree.add(m, y)
    for k, query in enumerate(others):
        for y in tree.links(query, threshold):
            yield k, y


_GROUP = ["leader", "lo", "hi"]


def _join_groups(rows: DataFrame, threshold: int) -> DataFrame:
    """For each two parts of a block that meet (``_GROUP``; rows: part, node, copies, smaller, body): a, n, the
    copies of the nodes that link to node a; and a, b, links that connect the classes found here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def solve() -> pa.RecordBatch:
            two = at[1] != at[2]
            left = [r for r in held if not two or r[0] == at[1]]
            right = [r for r in held if two and r[0] == at[2]]
            ours, theirs = (left, right) if two else (left, left)
            sets_ = [[np.frombuffer(r[4], np.uint64) for r in side] for side in (left, right)]
            smaller = [[frozenset(r[3]) for r in side] for side in (ours, theirs)]
            count: dict[int, int] = {}
            classes, place, links = Classes(len(held)), {r[1]: k for k, r in enumerate(held)}, []
            for k, y in join_sets(sets_[0], threshold, sets_[1] if two else None):
                a, b = theirs[k], ours[y]
                if not smaller[1][k].isdisjoint(smaller[0][y]):
                    continue  # they count in a block of a smaller leader
                count[a[1]] = count.get(a[1], 0) + b[2]
                count[b[1]] = count.get(b[1], 0) + a[2]
                if classes.find(place[a[1]]) != classes.find(place[b[1]]):
                    classes.join(place[a[1]], place[b[1]])
                    links.append((a[1], b[1]))
            none, some = [None] * len(count), [None] * len(links)
            return pa.RecordBatch.from_arrays(
                [pa.array([*count, *(a for a, _ in links)], pa.int64()), pa.array([*none, *(b for _, b in links)], pa.int64()), pa.array([*count.values(), *some], pa.int64())],
                names=["a", "b", "n"],
            )

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for leader, lo, hi, *row in zip(*columns, strict=True):
                if (leader, lo, hi) != at:
                    if len(held) > 1:
                        yield solve()
                    at, held = (leader, lo, hi), []
                held.append(row)
        if len(held) > 1:
            yield solve()

    return (
        rows.repartition(store.partitions(rows.sparkSession), *_GROUP)
        .sortWithinPartitions(*_GROUP)
        .select(*_GROUP, "part", "node", "copies", "smaller", "body")
        .mapInArrow(run, "a long, b long, n long")
    )


def _groups(blocks: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """leader, lo, hi, part, node, copies, smaller: each node of a block in every two parts of it that its own is one of."""
    told = blocks.select("leader", "node").join(nodes.select("node", "copies", F.col("n_shingles").alias("size")), "node")
    own = blocks.groupBy("node").agg(F.collect_list("leader").alias("leaders"))
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") * 8 / PART_BYTES))
    sizes = told.groupBy("leader").agg(parts.alias("parts"), F.count("*").alias("all")).filter("all > 1").drop("all")
    dealt = told.join(own, "node").join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    smaller = F.filter("leaders", lambda x: x < F.col("leader"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    each = dealt.select("leader", "part", "node", "copies", smaller.alias("smaller"), other)
    return each.select("leader", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "copies", "smaller")


def classes(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text).

    n_links: how many other rows the row's text links with, equal texts included.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
        return np.concatenate([np.zeros(0, np.uint64), *sets(batch.column(0), words)]) << np.uint64(1), None

    again, _, often = seen.build(docs.select("text"), keys, many_from=OFTEN)
    bitmap, often = spark.sparkContext.broadcast(again), spark.sparkContext.broadcast(often)
    rows = store.cut(_prepare(docs, bitmap, often, words, threshold), "sets")
    blocks = store.cut(_blocks(_tokens(rows), threshold), "blocks")

    def names(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
        return _spread(batch.column(0).to_numpy()), None

    wanted = spark.sparkContext.broadcast(seen.build(blocks.select("node"), names, bits=NODE_BITS, least=1)[0])
    sent = _bodies(docs, bitmap, wanted, words).join(blocks.select("node").distinct(), "node", "left_semi")
    bodies = store.cut(sent.groupBy("node").agg(F.first("body").alias("body")), "bodies")
    for flags in (bitmap, often, wanted):
        flags.destroy()
    own = rows.select("doc_id", "n_shingles", "node")
    nodes = own.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    nodes = store.cut(nodes, "nodes")
    found = store.cut(_join_groups(_groups(blocks, nodes, chunk).join(bodies, "node"), threshold), "found")
    roots = components(found.filter("b is not null"), "a", "b")
    members = store.cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    least = store.cut(members.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id")), "least")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # tables of nodes, each read by a join of its own, which Spark may split where a class or a text is hot
    classed = store.cut(members.join(least, "root").select("node", "component_id"), "classed")
    told = nodes.join(classed, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    told = store.cut(told, "told")
    for table in (blocks, bodies, nodes, found, members, least, classed):
        store.drop(table)
    return (
        own.filter("node is not null")
        .join(told, "node")
        .select("doc_id", "n_shingles", "component_id", "n_links")
        .unionByName(own.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    )
