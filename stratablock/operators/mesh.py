"""City documents as relational mesh tables.

``documents``: one row per file (``file`` and the parsed columns of
``sources.cityjson``). Boundaries differ in depth by geometry type; they arrive
as JSON text and are parsed to ``[shell][face][ring][vid]``, with one shell for
surfaces. All explosions keep document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOLID, SURFACES = "Solid", ("MultiSurface", "CompositeSurface")
_DEEP, _FLAT = "array<array<array<array<int>>>>", "array<array<array<int>>>"


def vertices(documents: DataFrame) -> DataFrame:
    """file, vid, x, y, z, and raw_z: coordinates are de-quantized when the document has a transform."""
    flat = documents.select("file", "transform", F.posexplode("vertices").alias("vid", "v"))

    def axis(k: int) -> Column:
        raw = F.col("v")[k]
        return F.coalesce(raw * F.col("transform.scale")[k] + F.col("transform.translate")[k], raw)

    return flat.select("file", "vid", axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"), F.col("v")[2].alias("raw_z"))


def objects(documents: DataFrame) -> DataFrame:
    """file, obj_pos, obj, type, geometry. Of equal ids the last value wins, in the place of the first."""
    flat = documents.select("file", F.posexplode(F.map_entries("CityObjects")).alias("pos", "e"))
    return (
        flat.select("file", "pos", F.col("e.key").alias("obj"), F.col("e.value").alias("o"))
        .groupBy("file", "obj")
        .agg(F.min("pos").alias("obj_pos"), F.max_by("o", "pos").alias("o"))
        .select("file", "obj_pos", "obj", F.coalesce("o.type", F.lit("Unknown")).alias("type"), F.col("o.geometry").alias("geometry"))
    )


def first_object(objects_: DataFrame) -> DataFrame:
    """Of each file the object that comes first in the document."""
    rest = [c for c in objects_.columns if c != "file"]
    return objects_.groupBy("file").agg(F.min_by(F.struct(*rest), "obj_pos").alias("o")).select("file", "o.*")


def geometries(objects_: DataFrame) -> DataFrame:
    """One row per geometry: its type, lod, surface types, and parsed boundaries and semantic values by shell."""
    flat = objects_.select("file", "obj_pos", "obj", "type", F.posexplode("geometry").alias("geom", "g"))
    solid = F.col("g.type") == SOLID
    deep = F.when(solid, F.from_json("g.boundaries", _DEEP)).when(F.col("g.type").isin(*SURFACES), F.array(F.from_json("g.boundaries", _FLAT)))
    values = F.when(solid, F.from_json("g.semantics.values", "array<array<int>>")).otherwise(F.array(F.from_json("g.semantics.values", "array<int>")))
    return flat.select(
        "file", "obj_pos", "obj", "type", "geom", F.col("g.type").alias("geom_type"), F.col("g.lod").alias("lod"),
        F.transform("g.semantics.surfaces", lambda s: s["type"]).alias("surfaces"), deep.alias("boundaries"), values.alias("values"),
    )


def rings(geometries_: DataFrame) -> DataFrame:
    """One row per ring with its vertex ids and the semantic index of its face.

    Geometry types other than solids and surfaces, and empty faces, give no
    rows; a face or shell past the end of the semantic values has a null index.
    """
    place = ["file", "obj_pos", "obj", "type", "geom", "geom_type", "surfaces"]
    shells = geometries_.filter(F.col("geom_type").isin(SOLID, *SURFACES)).select(*place, "values", F.posexplode("boundaries").alias("shell", "s"))
    faces = shells.select(*place, "shell", F.get("values", F.col("shell")).alias("v"), F.posexplode("s").alias("face", "f"))
    return faces.select(*place, "shell", "face", F.get("v", F.col("face")).alias("surface"), F.posexplode("f").alias("ring", "vids")).filter(F.col("vids").isNotNull())


def kind(surfaces: Column, surface: Column) -> Column:
    """The surface type that a semantic index names."""
    return F.get(surfaces, surface)


def last_index(surfaces: Column, type_: str) -> Column:
    """The last index of a surface type, or null."""
    return F.array_max(F.filter(F.transform(surfaces, lambda s, i: F.when(s == type_, i)), lambda i: i.isNotNull()))
