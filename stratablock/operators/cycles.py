"""Faces of a graph: chordless cycles of 3 to 8 nodes.

A graph's neighbours are gathered once to one row; paths grow from their
smallest node beside them, with no further shuffle. A step that touches an inner node of the path would make a chord and is never made; a path
whose end touches its start is a cycle and grows no further. So nothing is
enumerated only to be rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session

LONGEST = 8


def threshold_edges(probs: DataFrame, threshold: float = 0.5, key: str = "id") -> DataFrame:
    """key, src, dst of pairs over the threshold in the upper triangle, and their mirrors."""
    upper = probs.filter((F.col("src") < F.col("dst")) & (F.col("prob") > threshold)).select(key, "src", "dst")
    return upper.unionByName(upper.select(key, F.col("dst").alias("src"), F.col("src").alias("dst")))


def active_edges(probs: DataFrame, classes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Active nodes (class 0) of graphs with at least three, renumbered; and the probabilities among them."""
    from pyspark.sql import Window

    active = classes.filter("class = 0").withColumn("n", F.count("*").over(Window.partitionBy(key))).filter("n >= 3")
    numbered = active.withColumn("new", F.row_number().over(Window.partitionBy(key).orderBy("node")) - 1).select(key, "node", "new")
    # a graph's active nodes meet its key once: the pairs are neither shuffled nor joined by node
    held = numbered.groupBy(key).agg(F.array_sort(F.collect_list("node")).alias("__nodes"))
    number = lambda c: (F.array_position("__nodes", F.col(c)) - 1).cast("int")
    among = probs.join(session.shuffled(held), key).select(key, number("src").alias("src"), number("dst").alias("dst"), "prob").filter("src >= 0 and dst >= 0")
    return numbered, among


def _may_follow(size: int) -> Callable[[Column], Column]:
    """Whether a node may be the ``size``-th of a path: new, over the start, and no chord to an inner node."""
    inner = F.slice("path", 2, size - 3) if size > 3 else F.array().cast("array<int>")

    def may(v: Column) -> Column:
        fresh = (v > F.col("path")[0]) & ~F.array_contains("path", v)
        canonical = ~F.array_contains("start_near", v) | (F.col("path")[1] < v)
        return fresh & canonical & ~F.arrays_overlap(F.element_at("adj", v), inner)

    return may


def chordless(edges: DataFrame, longest: int = LONGEST, key: str = "id") -> DataFrame:
    """key, cycle ARRAY<INT>: each starts at its smallest node, with the smaller neighbour next.

    ``edges``: key, src, dst, both directions; loops are ignored.
    """
    near = (
        edges.filter("src <> dst").select(key, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).distinct()
        .groupBy(key, "src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    )
    graphs = near.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("src", "near"))).alias("adj"))
    paths = graphs.select(key, "adj", F.explode("adj").alias("start", "start_near"))
    paths = paths.select(key, "adj", "start_near", F.explode(F.transform(F.filter("start_near", lambda v: v > F.col("start")), lambda v: F.array("start", v))).alias("path"))
    paths = paths.withColumn("closed", F.lit(False))
    none = F.array(F.lit(None).cast("int"))
    for size in range(3, longest + 1):
        ends = F.filter(F.element_at("adj", F.element_at("path", -1)), _may_follow(size))
        grown = paths.withColumn("next", F.explode(F.when(F.col("closed"), none).otherwise(ends)))
        paths = grown.select(
            key, "adj", "start_near",
            F.when(F.col("closed"), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"),
            (F.col("closed") | F.coalesce(F.array_contains("start_near", F.col("next")), F.lit(False))).alias("closed"),
        )
    return paths.filter("closed").select(key, F.col("path").alias("cycle"))
