"""Building graphs: distinct edges, dense node numbers, base centre, padding to dense form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays
from . import rings as ring_ops

#: Vertices less than this above the lowest one belong to the base when semantics do not tell.
BASE_TOLERANCE = 0.1
KEY = ["file", "obj"]


def directed_edges(rings: DataFrame) -> DataFrame:
    """file, obj, src, dst: both directions of the edges of outer rings, each once. A ring of one vertex gives a loop."""
    outer = ring_ops.edges(rings.filter("ring = 0").select(*KEY, "vids"))
    both = F.explode(F.array(F.struct(F.col("vid").alias("src"), F.col("nxt").alias("dst")), F.struct(F.col("nxt").alias("src"), F.col("vid").alias("dst"))))
    return outer.select(*KEY, both.alias("e")).select(*KEY, "e.src", "e.dst").distinct()


def undirected_edges(directed: DataFrame) -> DataFrame:
    return directed.filter("src <= dst")


def nodes(directed: DataFrame) -> DataFrame:
    """file, obj, vid, node: active vertices numbered densely from 0 by ascending id."""
    order = Window.partitionBy(*KEY).orderBy("vid")
    active = directed.select(*KEY, F.col("src").alias("vid")).distinct()
    return active.withColumn("node", F.row_number().over(order) - 1)


def local_edges(directed: DataFrame, numbered: DataFrame) -> DataFrame:
    """Edges between node numbers."""
    src = numbered.select(*KEY, F.col("vid").alias("src"), F.col("node").alias("s"))
    dst = numbered.select(*KEY, F.col("vid").alias("dst"), F.col("node").alias("d"))
    return directed.join(session.shuffled(src), [*KEY, "src"]).join(session.shuffled(dst), [*KEY, "dst"]).select(*KEY, F.col("s").alias("src"), F.col("d").alias("dst"))


def _gathered(directed: DataFrame) -> DataFrame:
    """One row per graph: its ``edges``, and its ``active`` vertices in the order of their numbers."""
    graphs = directed.groupBy(*KEY).agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    return graphs.withColumn("active", F.array_sort(F.array_distinct(F.transform("edges", lambda e: e["src"]))))


def pairs(directed: DataFrame) -> DataFrame:
    """file, obj, i, j, src, dst, joined: all ordered pairs of a graph's active vertices, loops included, by node number and by id, and whether an edge joins them.

    A graph's edges are brought together and its pairs unfold where they are: the pairs, many times the edges, are never shuffled or sorted.
    """
    # outer generators: from others Spark infers a filter that works the arrays out again
    first = _gathered(directed).select(*KEY, "edges", "active", F.posexplode_outer("active").alias("i", "src"))
    both = first.select(*KEY, "edges", "i", "src", F.posexplode_outer("active").alias("j", "dst"))
    return both.select(*KEY, "i", "j", "src", "dst", F.array_contains("edges", F.struct("src", "dst")).alias("joined"))


def sizes(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy(*KEY).agg(F.count("*").alias("n_nodes"))


def check_n_max(observed: int, wanted: int | None) -> int:
    """The padded size: the observed maximum, or a wanted one that is not smaller."""
    if wanted is None:
        return observed
    if wanted < observed:
        raise ValueError(f"n_max={wanted} is smaller than the largest graph, which has {observed} nodes")
    return wanted


def base_centers(rings: DataFrame, vertices: DataFrame, numbered: DataFrame) -> DataFrame:
    """file, obj, cx, cy, cz: the mean of the distinct vertices of all ground faces, holes included;
    without any, of the active vertices near the lowest one. Falls back as a whole, not by axis."""
    at = vertices.select("file", "vid", "x", "y", "z")
    mean = [F.avg(c).alias(n) for c, n in (("x", "cx"), ("y", "cy"), ("z", "cz"))]
    on_ground = rings.filter(F.get("surfaces", F.col("surface")) == "GroundSurface")
    ground = on_ground.select(*KEY, F.explode("vids").alias("vid")).distinct().join(session.shuffled(at), ["file", "vid"]).groupBy(*KEY).agg(*mean)
    lowest = Window.partitionBy(*KEY)
    near = (
        numbered.select(*KEY, "vid")
        .join(session.shuffled(at), ["file", "vid"])
        .withColumn("low", F.min("z").over(lowest))
        .filter(F.abs(F.col("z") - F.col("low")) < BASE_TOLERANCE)
        .groupBy(*KEY)
        .agg(F.struct(*mean).alias("fallback"))
    )
    semantic = ground.select(*KEY, F.struct("cx", "cy", "cz").alias("semantic"))
    return near.join(session.shuffled(semantic), KEY, "left").select(*KEY, F.coalesce("semantic", "fallback").alias("c")).select(*KEY, "c.*")


def positions(numbered: DataFrame, vertices: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """file, obj, node, x, y, z as floats, cast last; relative to the base centre when centres are given."""
    at = numbered.join(session.shuffled(vertices.select("file", "vid", "x", "y", "z")), ["file", "vid"])
    if centers is None:
        return at.select(*KEY, "node", *(F.col(c).cast("float").alias(c) for c in "xyz"))
    moved = at.join(session.shuffled(centers), KEY, "left")
    return moved.select(*KEY, "node", *((F.col(c) - F.coalesce(F.col(f"c{c}"), F.lit(0.0))).cast("float").alias(c) for c in "xyz"))


def sequences(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """file, obj, tokens: the outer rings of each object in document order as (x, y, z, is_end), a separator after each."""
    at = ring_ops.located(rings.filter("ring = 0").select(*ring_ops.PLACE, "vids"), vertices)
    token = lambda x, y, z, end: F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"), F.lit(end).cast("float").alias("is_end"))
    zero = F.lit(0.0)
    ring = F.concat(F.transform("points", lambda p: token(p["x"], p["y"], p["z"], 0)), F.array(token(zero, zero, zero, 1)))
    one = at.select(*KEY, F.struct("geom", "shell", "face", ring.alias("tokens")).alias("r"))
    return one.groupBy(*KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["tokens"])).alias("tokens"))


def padded_nodes(at: DataFrame, n_max: int) -> DataFrame:
    """n_max rows per graph: virtual nodes have zero coordinates, class 1 and mask 0. A graph's nodes are brought together, and its rows unfold there."""
    graphs = at.groupBy(*KEY).agg(F.collect_list(F.struct("node", "x", "y", "z")).alias("own"))
    rows = graphs.select(*KEY, "own", F.explode(F.sequence(F.lit(0), F.lit(n_max - 1))).alias("node"))
    found = rows.select(*KEY, "node", F.get(F.filter("own", lambda n: n["node"] == F.col("node")), 0).alias("n"))
    return found.select(
        *KEY, "node", *(F.coalesce(F.col("n")[c], F.lit(0.0)).cast("float").alias(c) for c in "xyz"),
        F.col("n.x").isNull().cast("int").alias("category"), F.col("n.x").isNotNull().cast("int").alias("mask"),
    )


def transformed(padded: DataFrame, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Padded graphs after a caller's transform, which may change columns but neither keys nor rows."""
    if hook is None:
        return padded
    out = padded.transform(hook)
    if missing := {*KEY, "node"} - set(out.columns):
        raise ValueError(f"the transform dropped {', '.join(sorted(missing))}")
    return out


def _dense_rows(graphs: DataFrame, n_max: int) -> DataFrame:
    """file, obj, node, adjacent of graphs that hold their ``edges`` (src, dst) by node number: rows unfold where these are."""
    places = F.sequence(F.lit(0), F.lit(n_max - 1))
    rows = graphs.select(*KEY, "edges", F.explode(places).alias("node"))
    near = F.transform(F.filter("edges", lambda e: e["src"] == F.col("node")), lambda e: e["dst"])
    cells = arrays.let(near, lambda own: F.transform(places, lambda j: F.coalesce(F.array_contains(own, j), F.lit(False)).cast("int")))
    return rows.select(*KEY, "node", cells.alias("adjacent"))


def dense_adjacency(at: DataFrame, local: DataFrame, n_max: int) -> DataFrame:
    """One row per graph and node, with its row of the n_max by n_max adjacency."""
    graphs = local.groupBy(*KEY).agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    return _dense_rows(at.select(*KEY).distinct().join(session.shuffled(graphs), KEY, "left"), n_max)


def dense_active(directed: DataFrame, n_max: int) -> DataFrame:
    """``dense_adjacency`` of all active vertices, numbered where their graph's edges are: nothing is joined."""
    number = lambda v: (F.array_position("active", v) - 1).cast("int")
    edges = F.transform("edges", lambda e: F.struct(number(e["src"]).alias("src"), number(e["dst"]).alias("dst")))
    return _dense_rows(_gathered(directed).select(*KEY, edges.alias("edges")), n_max)


def sparse(at: DataFrame, local: DataFrame) -> DataFrame:
    """One row per graph: ``points`` (x, y, z by node), and its edges as ``offsets`` and ``indices``: node k is joined to indices[offsets[k]] up to offsets[k + 1]."""
    points = at.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "x", "y", "z"))), lambda n: F.array(n["x"], n["y"], n["z"])).alias("points"))
    ends = local.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("e"))
    before = F.transform(F.sequence(F.lit(0), F.size("points")), lambda k: F.coalesce(F.size(F.filter("e", lambda x: x["src"] < k)), F.lit(0)))
    rows = points.join(session.shuffled(ends), KEY, "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<src:int,dst:int>>")))
    return rows.select(*KEY, "points", before.alias("offsets"), F.transform("e", lambda x: x["dst"].cast("int")).alias("indices"))


def dense(g: Column, n_max: int) -> dict[str, Column]:
    """A sparse graph (a struct) padded to ``n_max`` nodes: x [n][3], node_categories [n][2] (active, virtual), y [n][n][1], node_mask [n], as floats."""
    n, places = F.size(g["points"]), F.sequence(F.lit(0), F.lit(n_max - 1))
    bit = lambda c: c.cast("int").cast("float")
    near = lambda k: F.when(k < n, F.slice(g["indices"], F.get(g["offsets"], k) + 1, F.get(g["offsets"], k + 1) - F.get(g["offsets"], k))).otherwise(F.array().cast("array<int>"))
    fits = F.when(n <= n_max, n).otherwise(F.raise_error(F.format_string("a graph has %d nodes, more than n_max", n)).cast("int"))
    return {
        "x": F.concat(g["points"], F.array_repeat(F.array(*[F.lit(0.0).cast("float")] * 3), n_max - fits)),
        "node_categories": F.transform(places, lambda k: F.array(bit(k < n), bit(k >= n))),
        "y": F.transform(places, lambda i: arrays.let(near(i), lambda own: F.transform(places, lambda j: F.array(bit(F.array_contains(own, j)))))),
        "node_mask": F.transform(places, lambda k: bit(k < n)),
    }


def collate(graphs: DataFrame, levels: list[DataFrame], n_max: int) -> DataFrame:
    """One row per batch, in batch order: x, node_categories, y, node_mask, ids, types; with several levels of detail a struct of these for each, ``lod_0``, ``lod_1``, ...

    ``graphs``: obj, batch, place; each level: ``sparse`` graphs with their ``type``. Graphs that a level lacks are left out of all.
    Graphs travel sparse; a batch is expanded once, where it is.
    """
    own = ("type", "points", "offsets", "indices")
    rows = graphs.select("obj", "batch", "place")
    for k, level in enumerate(levels):
        rows = rows.join(session.shuffled(level.select("obj", F.struct(*own).alias(f"lod_{k}"))), "obj")
    names = [f"lod_{k}" for k in range(len(levels))]
    held = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "obj", *names))).alias("g"))

    def batch(name: str) -> dict[str, Column]:
        def stacked(c: str) -> Column:
            return F.transform("g", lambda g: dense(g[name], n_max)[c]).alias(c)

        tensors = {c: stacked(c) for c in ("x", "node_categories", "y", "node_mask")}
        return tensors | {"ids": F.transform("g", lambda g: g["obj"]).alias("ids"), "types": F.transform("g", lambda g: g[name]["type"]).alias("types")}

    if len(levels) == 1:
        return held.select("batch", *batch(names[0]).values())
    return held.select("batch", *(F.struct(*batch(name).values()).alias(name) for name in names))
