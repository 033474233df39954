"""Detailed solids to extruded blocks.

A solid whose semantics name a ground and a roof surface, and that has faces
of both, becomes one block: its ground faces, the same faces raised to the
median height of its roof vertices, and a wall for every ground edge. Other
geometries pass as they are. Raised vertices are numbered after the file's own,
in the order of their first visit: objects, geometries, ground faces, outer
ring before holes, along the turned rings. Only that numbering needs a sort of
a whole file; it is of rows of a few integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays
from . import mesh
from . import rings as ring_ops

GEOM = ["file", "obj_pos", "obj", "geom"]


def surface_indices(geometries: DataFrame) -> DataFrame:
    """Geometries with the last index of each surface type; a missing wall is appended."""
    index = {k: mesh.last_index(F.col("surfaces"), f"{k.capitalize()}Surface") for k in ("ground", "roof", "wall")}
    out = geometries.select(*GEOM, "geom_type", "surfaces", *(c.cast("int").alias(k) for k, c in index.items()))
    return out.withColumns(
        {
            "surfaces": F.when(F.col("wall").isNull(), F.concat("surfaces", F.array(F.lit("WallSurface")))).otherwise(F.col("surfaces")),
            "wall": F.coalesce("wall", F.size("surfaces")),
        }
    )


def heights(rings: DataFrame, indices: DataFrame, vertices: DataFrame) -> DataFrame:
    """Convertible geometries with ``height``: the median over every roof ring vertex, repeats included, of the stored z."""
    known = indices.filter((F.col("geom_type") == mesh.SOLID) & F.col("ground").isNotNull() & F.col("roof").isNotNull())
    faces = rings.select(*GEOM, "surface", "vids").join(session.shuffled(known), GEOM)
    ground = faces.filter("surface = ground").select(*GEOM).distinct()
    roof = faces.filter("surface = roof and surface <> ground").select(*GEOM, F.explode("vids").alias("vid"))
    median = roof.join(session.shuffled(vertices.select("file", "vid", "raw_z")), ["file", "vid"]).groupBy(*GEOM).agg(F.median("raw_z").alias("height"))
    return known.join(session.shuffled(median), GEOM).join(session.shuffled(ground), GEOM, "left_semi")


def ground_rings(rings: DataFrame, converted: DataFrame, vertices: DataFrame, outer_ccw: bool = False) -> DataFrame:
    """Ground rings of converted geometries: outer rings turned one way, holes the other."""
    own = rings.select(*ring_ops.PLACE, "surface", "vids").join(session.shuffled(converted.select(*GEOM, "ground")), GEOM).filter("surface = ground")
    areas = ring_ops.signed_area(own.drop("ground", "surface"), vertices.select("file", "vid", "x", "y", F.col("raw_z").alias("z")))
    ccw = F.when(F.col("ring") == 0, F.lit(outer_ccw)).otherwise(F.lit(not outer_ccw))
    return ring_ops.oriented(areas, ccw).select(*ring_ops.PLACE, "vids")


def roof_vertices(ground: DataFrame, converted: DataFrame, vertices: DataFrame) -> DataFrame:
    """file, obj_pos, obj, geom, vid, roof_vid, x, y, z of every raised vertex; x and y as stored."""
    order = F.struct("obj_pos", "geom", "shell", "face", "ring", "pos")
    first = ground.select(*ring_ops.PLACE, F.posexplode("vids").alias("pos", "vid")).groupBy(*GEOM, "vid").agg(F.min(order).alias("at"))
    count = vertices.groupBy("file").agg(F.count("*").alias("v"))
    # numbers inside a geometry, shifted by the geometries before it in the file: one row of these for each
    inside = first.withColumn("rank", F.row_number().over(Window.partitionBy(*GEOM).orderBy("at")) - 1)
    before = Window.partitionBy("file").orderBy("obj_pos", "geom").rowsBetween(Window.unboundedPreceding, -1)
    sizes = first.groupBy(*GEOM).agg(F.count("*").alias("n")).join(session.shuffled(count), "file")
    shifts = sizes.select(*GEOM, (F.col("v") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("shift"))
    return (
        inside.join(session.shuffled(shifts), GEOM)
        .withColumn("roof_vid", (F.col("rank") + F.col("shift")).cast("int"))
        .join(session.shuffled(vertices.select("file", "vid", "x", "y")), ["file", "vid"])
        .join(session.shuffled(converted.select(*GEOM, "height")), GEOM)
        .select(*GEOM, "vid", "roof_vid", "x", "y", F.col("height").alias("z"))
    )


def block_faces(ground: DataFrame, raised: DataFrame, converted: DataFrame, turn_roof: bool = False) -> DataFrame:
    """file, obj_pos, obj, geom, face, surface, rings: the block's faces, densely numbered in output order.

    Per ground face: itself, its raised copy, the walls of its outer ring, the
    walls of each hole. Walls shared by ground faces stay, as each face builds
    its own. With ``turn_roof`` raised rings run against their ground ring.
    """
    lift = raised.groupBy(*GEOM).agg(F.map_from_entries(F.collect_list(F.struct("vid", "roof_vid"))).alias("lift"))
    faces = (
        ground.groupBy(*GEOM, "shell", "face")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "vids"))), lambda r: r["vids"]).alias("rings"))
        .join(session.shuffled(lift), GEOM)
        .join(session.shuffled(converted.select(*GEOM, "ground", "roof", "wall")), GEOM)
    )
    up = lambda v: F.element_at("lift", v)
    wall = lambda e: F.struct(F.col("wall").alias("surface"), F.array(F.array(e["vid"], e["nxt"], up(e["nxt"]), up(e["vid"]))).alias("rings"))
    walls = F.flatten(F.transform("rings", lambda r: F.transform(arrays.ring_edges(r), wall)))
    raised_rings = F.transform("rings", lambda r: F.reverse(F.transform(r, up)) if turn_roof else F.transform(r, up))
    out = F.concat(
        F.array(F.struct(F.col("ground").alias("surface"), F.col("rings")), F.struct(F.col("roof").alias("surface"), raised_rings.alias("rings"))), walls
    )
    per_geom = faces.groupBy(*GEOM).agg(F.array_sort(F.collect_list(F.struct("shell", "face", out.alias("out")))).alias("all"))
    flat = F.flatten(F.transform("all", lambda f: f["out"]))
    return per_geom.select(*GEOM, F.posexplode(flat).alias("face", "f")).select(*GEOM, "face", "f.surface", "f.rings")


def convert(geometries: DataFrame, rings: DataFrame, vertices: DataFrame, outer_ccw: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks' faces, the raised vertices, and the converted geometries with their height and surfaces.

    With ``outer_ccw`` ground rings run counterclockwise and roofs against them, so that walls face outward.
    """
    converted = heights(rings, surface_indices(geometries), vertices)
    ground = ground_rings(rings, converted, vertices, outer_ccw)
    raised = roof_vertices(ground, converted, vertices)
    return block_faces(ground, raised, converted, outer_ccw), raised, converted
