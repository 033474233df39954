"""City documents from reconstructed graphs, and several documents combined to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import documents
from . import cycles, dataset, planes

#: Surface types in the order of their semantic index.
SURFACE_TYPES = ("GroundSurface", "RoofSurface", "WallSurface")
_SURFACES = "[" + ",".join(f'{{"type":"{t}"}}' for t in SURFACE_TYPES) + "]"


def building_faces(edges: DataFrame, key: str = "id") -> DataFrame:
    """key, face, cycle, numbered in the order of the cycles."""
    found = cycles.chordless(edges, key=key)
    return found.withColumn("face", F.row_number().over(Window.partitionBy(key).orderBy("cycle")) - 1)


def reconstruct(nodes: DataFrame, probs: DataFrame, threshold: float = 0.5, key: str = "id") -> DataFrame:
    """key, vertices, boundaries, surface_values of every graph with a face; others give no row."""
    faces = building_faces(cycles.threshold_edges(probs, threshold, key), key)
    index = F.array_position(F.array(*map(F.lit, SURFACE_TYPES)), F.col("surface_type")) - 1
    moved = planes.straightened(planes.corners(faces, nodes, key), [key, "face"])
    shell = moved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("face", index.cast("int").alias("s"), "p"))).alias("f"))
    points = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node", "x", "y", "z"))).alias("n"))
    # corners in the order of their nodes: each node reads its own run of them
    found = shell.join(session.shuffled(points), key).withColumn("corners", F.array_sort(F.flatten(F.transform("f", lambda f: F.transform(f["p"], lambda c: F.struct(c["node"], c["x"], c["y"], c["z"]))))))
    found = found.withColumn("own", F.transform("corners", lambda c: c["node"]))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "xyz"), F.lit(0).alias("size"))

    def averaged(n: Column) -> Column:
        first = F.array_position("own", n["node"]).cast("int")
        run = F.slice("corners", F.greatest(first, F.lit(1)), F.size(F.filter("own", lambda v: v == n["node"])))
        total = F.aggregate(
            run,
            zero,
            lambda a, c: F.struct(*((a[k] + c[k]).alias(k) for k in "xyz"), (a["size"] + 1).alias("size")),
            lambda a: F.array(*(a[k] / a["size"] for k in "xyz")),
        )
        return F.when(first > 0, total).otherwise(F.array(n["x"], n["y"], n["z"]))

    return found.select(
        key,
        F.transform("n", averaged).alias("vertices"),
        F.transform("f", lambda f: F.array(F.transform(f["p"], lambda c: c["node"]))).alias("boundaries"),
        F.transform("f", lambda f: f["s"]).alias("surface_values"),
    )


def _object(name: Column, boundaries: Column, values: Column) -> Column:
    """The JSON member of one building."""
    return F.concat(
        documents.quoted(name), F.lit(':{"type":"Building","geometry":[{"type":"Solid","lod":"1","boundaries":['), F.to_json(boundaries),
        F.lit(f'],"semantics":{{"surfaces":{_SURFACES},"values":['), F.to_json(values), F.lit("]}}]}"),
    )


def _document(objects: Column, vertices: Column) -> Column:
    return F.concat(
        F.lit('{"type":"CityJSON","version":"1.1","CityObjects":{'), objects, F.lit('},"vertices":'), F.to_json(vertices),
        F.lit(',"metadata":{"datasetLod":"1"}}'),
    )


def document(buildings: DataFrame, name: Column) -> DataFrame:
    """``buildings`` (of ``reconstruct``) with ``json``: a document of one building called ``name``."""
    return buildings.withColumn("json", _document(_object(name, F.col("boundaries"), F.col("surface_values")), F.col("vertices")))


def combined(merged: DataFrame, buildings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """file_name and json of all buildings together, or of each group of ``by``. ``merged``: of ``merge``; ``buildings``: by, name, surface_values.

    Members are written from names and boundaries alone; a document's vertices meet them once.
    """
    keys = by or ["__all"]
    whole, own = (df if by else df.withColumn("__all", F.lit(0)) for df in (merged, buildings))
    each = whole.select(*keys, F.explode("objects").alias("name", "boundaries")).join(session.shuffled(own.select(*keys, "name", "surface_values")), [*keys, "name"])
    text = _object(F.col("name"), F.col("boundaries"), F.col("surface_values"))
    members = each.groupBy(*keys).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("name", text.alias("text")))), lambda m: m["text"])).alias("o"))
    out = whole.select(*keys, "vertices").join(session.shuffled(members), keys)
    return out.select(*(by or []), F.lit("all_buildings.city.json").alias("file_name"), _document(F.col("o"), F.col("vertices")).alias("json"))


def file_names(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``file_name``: building_0000.city.json and on, without gaps."""
    ranked = dataset.sorted_ranks(rows, order, "__place")
    return ranked.withColumn("file_name", F.format_string("building_%04d.city.json", F.col("__place"))).drop("__place")


def vertex_offsets(sizes: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """``sizes`` (n) with ``offset``: the vertices of all documents before, within ``by``."""
    if not by:
        return dataset.sorted_ranks(sizes, order, "offset", value=F.col("n"))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def merge(documents: DataFrame, by: list[str], order: str) -> DataFrame:
    """Documents of a group as one: vertices end to end, boundaries shifted, of equal names the last object.

    ``documents``: by, order, name, vertices, boundaries [face][ring][vid].
    """
    sized = vertex_offsets(documents.withColumn("n", F.size("vertices")), order, by)
    shift = F.transform("boundaries", lambda f: F.transform(f, lambda r: F.transform(r, lambda v: (v + F.col("offset")).cast("int"))))
    moved = sized.select(*by, order, "name", "vertices", shift.alias("boundaries"))
    points = moved.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "vertices"))), lambda x: x["vertices"])).alias("vertices"))
    last = moved.groupBy(*by, "name").agg(F.max_by("boundaries", order).alias("boundaries"))
    objects = last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "boundaries")))).alias("objects"))
    return points.join(session.shuffled(objects), by)
