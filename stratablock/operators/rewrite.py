"""Whole documents rewritten by the relational operators: conversion to blocks, and merging.

A document is read twice from one text: by the schema of ``sources.cityjson``
for the operators, and as a VARIANT. What the operators make is put in the
places of the VARIANT that it replaces; all other members stay, of whatever
name and depth. A document is one row, its new parts meet it by the file's name.
Members of an object come out in the order of their names. A text that is no
JSON, has a name twice in an object or is larger than a VARIANT may be, is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import documents as doc
from ..sources import cityjson
from . import lod1, mesh

_PLACE = ["file", "obj", "geom"]


def _read(raw: DataFrame) -> DataFrame:
    """``raw`` (file, value) with its VARIANT ``v``, vertices and what is wrong with it as a city document."""
    points = F.try_variant_get("v", "$.vertices", "array<array<double>>")
    rows = raw.withColumn("v", F.try_parse_json("value")).withColumn("points", points)
    flat = F.exists("points", lambda p: p.isNull() | (F.size(p) != 3) | F.exists(p, lambda c: c.isNull()))
    wrong = F.when(F.col("points").isNull(), "no vertices").when(flat, "a vertex has not three coordinates")
    objects = F.try_variant_get("v", "$.CityObjects", "map<string,map<string,variant>>")
    n = F.size("points")

    def outside(g: Column) -> Column:
        """Has a solid with semantics a vertex index that no vertex has?"""
        indices = F.regexp_extract_all(F.to_json(F.try_variant_get(g, "$.boundaries", "variant")), F.lit("(-?[0-9]+)"), F.lit(1))
        solid = (F.try_variant_get(g, "$.type", "string") == mesh.SOLID) & F.try_variant_get(g, "$.semantics.surfaces", "variant").isNotNull()
        return solid & F.exists(indices, lambda i: ~F.coalesce(i.try_cast("int").between(0, n - 1), F.lit(False)))

    astray = F.exists(F.map_values(objects), lambda o: F.exists(F.try_variant_get(o["geometry"], "$", "array<variant>"), outside))
    wrong = wrong.when(F.coalesce(astray, F.lit(False)), "a vertex that is not there")
    return rows.withColumn("wrong", F.coalesce(wrong, F.when(F.try_variant_get("v", "$.CityObjects", "variant").isNotNull() & objects.isNull(), "objects are not objects")))


def _geometry(g: Column, block: Column) -> Column:
    """A geometry's JSON text: its block where there is one, else as it is."""
    surfaces = F.to_json(F.try_variant_get(g, "$.semantics.surfaces", "variant"))
    count = F.size(F.try_variant_get(g, "$.semantics.surfaces", "array<variant>"))
    wall = F.when(block["wall"] >= count, F.array(F.lit('{"type":"WallSurface"}'))).otherwise(F.array().cast("array<string>"))
    text = F.concat(
        F.lit('{"type":"Solid","lod":"1","boundaries":['), block["boundaries"], F.lit('],"semantics":{"surfaces":'), doc.extended(surfaces, wall),
        F.lit(',"values":['), block["values"], F.lit("]}}"),
    )
    return F.coalesce(text, F.to_json(g))


def _number(value: Column, whole: Column) -> Column:
    return F.when(whole & (value == F.floor(value)), F.floor(value).cast("string")).otherwise(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))


def to_blocks(raw: DataFrame) -> DataFrame:
    """file, json, wrong: documents (file, value) with their detailed solids as blocks.

    ``wrong`` says why a document cannot be converted; its ``json`` is null. Whole coordinates of whole documents stay whole.
    """
    read = _read(raw)
    # the operators name their tables many times: documents are parsed once
    sound = session.settled(cityjson.parse(read.filter("wrong is null").select("file", "value")))
    geometries = mesh.geometries(mesh.objects(sound))
    faces, raised, converted = lod1.convert(geometries, mesh.rings(geometries), mesh.vertices(sound))

    each = faces.groupBy(*_PLACE).agg(F.array_sort(F.collect_list(F.struct("face", "surface", "rings"))).alias("f")).join(session.shuffled(converted.select(*_PLACE, "wall")), _PLACE)
    text = F.struct(F.to_json(F.transform("f", lambda f: f["rings"])).alias("boundaries"), F.to_json(F.transform("f", lambda f: f["surface"])).alias("values"), "wall")
    entry = F.struct(F.struct("obj", "geom").alias("key"), text.alias("value"))
    blocks = each.groupBy("file").agg(F.map_from_entries(F.collect_list(entry)).alias("blocks"))
    tops = raised.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("roof_vid", "x", "y", "z"))).alias("raised"))

    rows = read.join(session.shuffled(blocks), "file", "left").join(session.shuffled(tops), "file", "left")
    none = F.array().cast("array<string>")
    whole = F.schema_of_variant(F.try_variant_get("v", "$.vertices", "variant")).isin("ARRAY<ARRAY<BIGINT>>")
    lifted = F.transform("raised", lambda r: F.concat(F.lit("["), *(x for c in "xyz" for x in (_number(r[c], whole), F.lit("," if c < "z" else "]")))))

    def one(name: Column, value: Column) -> Column:
        found = F.transform(F.try_variant_get(value, "$.geometry", "array<variant>"), lambda g, k: _geometry(g, F.element_at("blocks", F.struct(name.alias("obj"), k.alias("geom")))))
        return F.concat(doc.quoted(name), F.lit(":"), doc.object_of(doc.members(doc.as_object(value), "geometry"), F.array(doc.member("geometry", doc.array_of(F.coalesce(found, none))))))

    objects = F.transform(F.map_entries(doc.as_object(F.col("v"), "$.CityObjects")), lambda e: one(e["key"], e["value"]))
    members = [
        doc.members(doc.as_object(F.col("v")), "CityObjects", "vertices", "metadata"),
        F.when(objects.isNotNull(), F.array(doc.member("CityObjects", doc.object_of(objects)))).otherwise(none),
        F.array(
            doc.member("vertices", doc.extended(F.to_json(F.try_variant_get("v", "$.vertices", "variant")), F.coalesce(lifted, none))),
            doc.member("metadata", doc.object_of(F.coalesce(doc.members(doc.as_object(F.col("v"), "$.metadata"), "datasetLod"), none), F.array(F.lit('"datasetLod":"1"')))),
        ),
    ]
    return rows.select("file", F.when(F.col("wrong").isNull(), doc.object_of(*members)).alias("json"), "wrong")


def converted_files(files: DataFrame) -> DataFrame:
    """rel_path, status (converted, copied, error), message, body: what becomes of each of ``files`` (rel_path, content).

    JSON objects of type CityJSON are converted, everything else is copied byte by byte. An error concerns its file only, which has no body.
    """
    named = F.lower("rel_path").endswith(".json")
    text = F.when(named, F.try_validate_utf8(F.col("content").cast("string")))
    rows = files.select("rel_path", "content", named.alias("named"), text.alias("text"))
    parsed = F.try_parse_json("text")
    city = F.coalesce(F.try_variant_get(parsed, "$.type", "string") == "CityJSON", F.lit(False))
    rows = rows.withColumns({"city": city, "unread": F.col("named") & parsed.isNull()})
    done = to_blocks(rows.filter("city").select(F.col("rel_path").alias("file"), F.col("text").alias("value"))).withColumnRenamed("file", "rel_path")
    bad = F.col("unread") | F.col("wrong").isNotNull()
    out = rows.join(session.shuffled(done), "rel_path", "left")
    return out.select(
        "rel_path",
        F.when(bad, "error").when(F.col("city"), "converted").otherwise("copied").alias("status"),
        F.when(F.col("unread"), "no valid JSON").when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("city"), "converted to LOD1").otherwise("copied as it is").alias("message"),
        F.when(~bad, F.coalesce(F.encode("json", "UTF-8"), "content")).alias("body"),
    )


def merged(raw: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, json: the documents (by, order, value) of a group as one, whatever their objects and geometries hold.

    Vertices stand end to end, in ``order``; vertex indices of boundaries are shifted at any nesting; of equal object names the last stays.
    Other members of the documents do not. A text without vertices gives no part; a group of such texts gives no row.
    """
    rows = raw.select(*by, order, F.try_parse_json("value").alias("v"))
    points = F.to_json(F.try_variant_get("v", "$.vertices", "variant"))
    count = F.size(F.try_variant_get("v", "$.vertices", "array<variant>"))
    rows = rows.select(*by, order, doc.as_object(F.col("v"), "$.CityObjects").alias("objects"), points.alias("points"), count.alias("n")).filter("n >= 0")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def geometry(g: Column) -> Column:
        moved = doc.shifted(F.to_json(F.try_variant_get(g, "$.boundaries", "variant")), F.col("offset"))
        return doc.object_of(doc.members(doc.as_object(g), "boundaries"), F.array(doc.member("boundaries", moved)))

    def one(value: Column) -> Column:
        found = F.transform(F.try_variant_get(value, "$.geometry", "array<variant>"), geometry)
        return doc.object_of(doc.members(doc.as_object(value), "geometry"), F.array(doc.member("geometry", doc.array_of(F.coalesce(found, F.array().cast("array<string>"))))))

    # an object is a row while its geometries are rewritten: a hot group is not one task's work
    each = rows.select(*by, order, "offset", F.explode("objects").alias("name", "o")).select(*by, order, "name", one(F.col("o")).alias("text"))
    last = each.groupBy(*by, "name").agg(F.max_by("text", order).alias("text"))
    objects = last.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda o: F.concat(doc.quoted(o["name"]), F.lit(":"), o["text"])).alias("o"))
    inner = F.regexp_replace("points", r"^\[|\]$", "")
    vertices = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, inner.alias("p")))), lambda r: r["p"]).alias("p"))
    parts = F.array(
        F.lit('"type":"CityJSON"'), F.lit('"version":"1.1"'), doc.member("CityObjects", doc.object_of(F.coalesce("o", F.array().cast("array<string>")))),
        doc.member("vertices", doc.array_of(F.filter("p", lambda t: t != ""))), F.lit('"metadata":{"datasetLod":"1"}'),
    )
    return reduce(lambda a, b: a.join(session.shuffled(b), by, "left"), [vertices, objects]).select(*by, doc.object_of(parts).alias("json"))
