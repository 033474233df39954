import json
import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import literals as lit
import plain_blocks

from stratablock.operators import graph, lod1, mesh, rings
from stratablock.sources import cityjson


def tables(spark, **docs):
    raw = spark.createDataFrame([(k, v if isinstance(v, str) else lit.text(v)) for k, v in docs.items()], "file string, value string")
    documents = cityjson.parse(raw)
    geometries = mesh.geometries(mesh.objects(documents))
    return documents, geometries, mesh.rings(geometries), mesh.vertices(documents)


def test_box_graph(spark):
    _, _, faces, points = tables(spark, box=lit.BOX)
    assert rings.signed_area(faces, points).filter("face = 0").first().area == 12
    edges = graph.directed_edges(faces)
    numbered = graph.nodes(edges)
    assert (edges.count(), numbered.count()) == (24, 8)
    c = graph.base_centers(faces, points, numbered).first()
    assert (c.cx, c.cy, c.cz) == (2, 1.5, 0)
    at = graph.positions(numbered, points, graph.base_centers(faces, points, numbered))
    assert {(r.x, r.y, r.z) for r in at.filter("node in (0, 6)").collect()} == {(-2, -1.5, 0), (2, 1.5, 5)}
    assert dict(at.dtypes)["x"] == "float"


def blocks(spark, doc):
    _, geometries, faces, points = tables(spark, d=doc)
    out, raised, converted = lod1.convert(geometries, faces, points)
    return sorted((r.face, r.surface, r.rings) for r in out.collect()), raised.collect(), converted.collect()


def test_box_block(spark):
    faces, raised, converted = blocks(spark, lit.BOX)
    assert [r for _, _, r in faces] == [[[3, 2, 1, 0]], [[8, 9, 10, 11]], [[3, 2, 9, 8]], [[2, 1, 10, 9]], [[1, 0, 11, 10]], [[0, 3, 8, 11]]]
    assert [s for _, s, _ in faces] == [0, 1, 2, 2, 2, 2]
    assert converted[0].height == 5 and {r.z for r in raised} == {5.0} and len(raised) == 4


@pytest.mark.parametrize("make", [lambda: lit.BOX, lit.two_roofs, lit.courtyard, lit.no_semantics])
def test_relational_and_document_conversion_agree(spark, make):
    doc = make()
    faces, raised, converted = blocks(spark, doc)
    out = plain_blocks.block_document(json.loads(lit.text(doc)))
    g = lit.geometry(out)
    if not converted:
        assert g == lit.geometry(doc)
        return
    assert [r for _, _, r in faces] == g["boundaries"][0]
    assert [s for _, s, _ in faces] == g["semantics"]["values"][0]
    assert len(out["vertices"]) == len(doc["vertices"]) + len(raised)
    assert all(out["vertices"][r.roof_vid] == [r.x, r.y, r.z] for r in raised)


def test_only_the_last_roof_counts(spark):
    assert blocks(spark, lit.two_roofs())[2][0].height == 4.5


def test_missing_wall_is_appended(spark):
    doc = lit.variant()
    lit.geometry(doc)["semantics"] = {"surfaces": [{"type": "GroundSurface"}, {"type": "RoofSurface"}], "values": [[0, 1, None, None, None, None]]}
    converted = blocks(spark, doc)[2][0]
    assert converted.surfaces == ["GroundSurface", "RoofSurface", "WallSurface"] and converted.wall == 2
    assert lit.geometry(plain_blocks.block_document(doc))["semantics"]["surfaces"][2] == {"type": "WallSurface"}


def test_courtyard(spark):
    doc = lit.courtyard()
    faces = blocks(spark, doc)[0]
    assert faces[0][2] == [[3, 2, 1, 0], [4, 5, 6, 7]] and len(faces) == 2 + 4 + 4
    _, _, ring_rows, points = tables(spark, d=doc)
    edges = graph.directed_edges(ring_rows)
    assert graph.nodes(edges).filter("vid between 4 and 7").count() == 0  # holes give no edges
    c = graph.base_centers(ring_rows, points, graph.nodes(edges)).first()
    assert (c.cx, c.cy, c.cz) == (2, 2, 0)


def test_base_without_semantics_is_strictly_near_the_lowest(spark):
    _, _, faces, points = tables(spark, d=lit.no_semantics())
    c = graph.base_centers(faces, points, graph.nodes(graph.directed_edges(faces))).first()
    assert (c.cx, c.cy) == (1, 0) and math.isclose(c.cz, 0.025)


def test_quantized_vertices_and_dropped_types(spark):
    _, _, faces, points = tables(spark, d=lit.quantized())
    v = points.first()
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((v.x, v.y, v.z), (11, 22, 33), strict=True)) and v.raw_z == 3000
    assert faces.count() == 1


def test_duplicate_ids_and_empty_objects(spark):
    documents, _, faces, _ = tables(spark, d=lit.DUPLICATE, broken="{", empty="{}")
    found = {r.obj: (r.obj_pos, r.type) for r in mesh.objects(documents).collect()}
    assert found == {"a": (0, "Unknown"), "b": (1, "Unknown")}
    assert [r.obj for r in faces.collect()] == ["a"]
    assert {r.file for r in cityjson.broken(documents).collect()} == {"broken", "empty"}


def test_block_document_keeps_unknown_keys():
    doc = lit.variant(extra={"a": 1}, metadata={"title": "t"})
    doc["CityObjects"]["bare"] = {"type": "Tree", "attributes": {"h": 3}}
    out = plain_blocks.block_document(doc)
    assert out["extra"] == {"a": 1} and out["metadata"] == {"title": "t", "datasetLod": "1"}
    assert out["CityObjects"]["bare"] == {"type": "Tree", "attributes": {"h": 3}, "geometry": []}


def test_orientation_is_idempotent_and_keeps_flat_rings(spark):
    doc = lit.variant()
    lit.geometry(doc)["boundaries"] = [[[[3, 2, 1, 0]], [[0, 1, 2, 3]], [[0, 1, 5, 4]]]]
    _, _, faces, points = tables(spark, d=doc)
    once = rings.oriented(rings.signed_area(faces, points), True)
    assert {r.face: r.vids for r in once.collect()} == {0: [0, 1, 2, 3], 1: [0, 1, 2, 3], 2: [0, 1, 5, 4]}
    again = rings.oriented(rings.signed_area(once.drop("points", "area", "reversed"), points), True)
    assert {r.face: r.vids for r in again.collect()} == {r.face: r.vids for r in once.collect()}


def test_a_ring_of_one_vertex_is_a_loop(spark):
    doc = lit.variant()
    lit.geometry(doc)["boundaries"] = [[[[5]]]]
    _, _, faces, _ = tables(spark, d=doc)
    assert [(r.src, r.dst) for r in graph.directed_edges(faces).collect()] == [(5, 5)]


def test_padding(spark):
    at = spark.createDataFrame([("f", "o", k, 1.0, 2.0, 3.0) for k in range(3)], "file string, obj string, node int, x float, y float, z float")
    rows = graph.padded_nodes(at, 5).orderBy("node").collect()
    assert [r.mask for r in rows] == [1, 1, 1, 0, 0] and [r.category for r in rows] == [0, 0, 0, 1, 1] and rows[4].x == 0
    local = spark.createDataFrame([("f", "o", 0, 2), ("f", "o", 2, 0)], "file string, obj string, src int, dst int")
    dense = {r.node: r.adjacent for r in graph.dense_adjacency(at, local, 5).collect()}
    assert dense[0] == [0, 0, 1, 0, 0] and dense[4] == [0] * 5
    assert graph.check_n_max(8, None) == 8 and graph.check_n_max(8, 9) == 9
    with pytest.raises(ValueError):
        graph.check_n_max(8, 7)


def test_kind_past_the_end_is_null(spark):
    row = spark.range(1).select(mesh.kind(F.array(F.lit("a")), F.lit(3)).alias("k"), mesh.last_index(F.array(*map(F.lit, "aba")), "a").alias("i")).first()
    assert row.k is None and row.i == 2
