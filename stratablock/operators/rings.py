"""Rings of mesh faces: successor edges, signed area, orientation.

A ring table has the keys of its file and object (``file``, ``obj``), its place
(``geom``, ``shell``, ``face``, ``ring``) and ``vids ARRAY<INT>``, the last vertex not
repeated. A vertex table has ``file``, ``vid``, ``x``, ``y``, ``z``. Rings are
small, so work inside a ring is a higher-order function over its array and
only coordinates need a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays

PLACE = ["file", "obj_pos", "obj", "geom", "shell", "face", "ring"]


def edges(rings: DataFrame) -> DataFrame:
    """One row per ring edge: the ring's columns without vids, and pos, vid, nxt."""
    rest = [c for c in rings.columns if c != "vids"]
    return rings.select(*rest, F.inline(arrays.ring_edges(F.col("vids"))))


def located(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rings with ``points``: the (x, y, z) of their vertices in ring order. Rings with a vertex that does not exist are dropped."""
    rest = [c for c in rings.columns if c != "vids"]
    flat = rings.select(*rest, F.size("vids").alias("__n"), F.posexplode("vids").alias("pos", "vid"))
    held = [c for c in rest if c not in PLACE]
    return (
        flat.join(session.shuffled(vertices.select("file", "vid", "x", "y", "z")), ["file", "vid"])
        .groupBy(*(c for c in PLACE if c in rest))
        .agg(
            *(F.first(c).alias(c) for c in held),
            F.first("__n").alias("__n"),
            F.array_sort(F.collect_list(F.struct("pos", "vid", "x", "y", "z"))).alias("points"),
        )
        .filter(F.size("points") == F.col("__n"))
        .drop("__n")
        .withColumn("vids", F.transform("points", lambda p: p["vid"]))
    )


def signed_area(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rings with ``area``: in the plane of x and y, positive when counterclockwise."""
    return located(rings, vertices).withColumn("area", arrays.shoelace(F.col("points")))


def oriented(areas: DataFrame, ccw) -> DataFrame:
    """Rings turned to the wanted orientation by full reversal; a ring of zero area stays as it is.

    ``ccw``: a Boolean, or a column.
    """
    want = F.lit(ccw) if isinstance(ccw, bool) else ccw
    wrong = F.when(want, F.col("area") < 0).otherwise(F.col("area") > 0)
    return areas.withColumn("vids", F.when(wrong, F.reverse("vids")).otherwise(F.col("vids"))).withColumn("reversed", wrong)
