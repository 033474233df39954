"""Whole documents through VARIANT: conversion against the plain version, merging at any nesting."""

import copy
import json

import literals as lit
import plain_blocks
import pytest
from pyspark.sql import functions as F

from stratablock.functions import documents as doc
from stratablock.operators import rewrite


def rich():
    """A box with members that no schema knows, at every level."""
    d = lit.variant(version="1.1", extensions={"x": {"deep": [1, 2.5, None, {"é\"\\": True}]}}, metadata={"title": "Town", "datasetLod": "2", "n": [1]}, empty={}, none=None)
    d["CityObjects"]["box"]["attributes"] = {"floors": 3, "height": 4.25, "tags": ["a", "b"]}
    lit.geometry(d)["semantics"]["surfaces"][1]["slope"] = 30
    d["CityObjects"]["tree"] = {"type": "Vegetation", "geometry": [{"type": "MultiPoint", "lod": 1, "boundaries": [0, 1]}, copy.deepcopy(lit.geometry(d))]}
    d["CityObjects"]["bare \"name\""] = {"type": "Thing", "parents": ["box"]}
    return d


def no_wall():
    d = lit.variant()
    lit.geometry(d)["semantics"] = {"surfaces": [{"type": "RoofSurface", "id": 7}, {"type": "GroundSurface"}], "values": [[1, 0, None, None, None, None]]}
    return d


DOCS = {
    "box": lit.BOX, "rich": rich(), "roofs": lit.two_roofs(), "court": lit.courtyard(), "plain": lit.no_semantics(), "quantized": lit.quantized(), "no_wall": no_wall(),
    "objects": lit.variant(CityObjects={}), "half": lit.variant(vertices=[[c + 0.5 for c in v] for v in lit.BOX["vertices"]]),
    "none": {"type": "CityJSON", "vertices": []},
}


def converted(spark, docs):
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else lit.text(v)) for k, v in docs.items()], "file string, value string")
    return {r.file: r for r in rewrite.to_blocks(rows).collect()}


def test_conversion_equals_the_plain_version(spark):
    found = converted(spark, DOCS)
    for name, d in DOCS.items():
        assert found[name].wrong is None
        got = json.loads(found[name].json)
        assert got == plain_blocks.block_document(copy.deepcopy(d)), name
    assert set(found) == set(DOCS)
    whole = json.loads(found["box"].json)["vertices"]
    assert all(isinstance(c, int) for v in whole for c in v)


def test_what_cannot_be_converted_has_a_reason(spark):
    short, outside, flat = lit.variant(vertices=[[0, 0]]), lit.variant(vertices=lit.BOX["vertices"][:7]), lit.variant(vertices=5)
    found = converted(spark, {"short": short, "outside": outside, "flat": flat, "missing": {"type": "CityJSON"}, "list": lit.variant(CityObjects=[1]), "ok": lit.BOX})
    assert {k: r.wrong for k, r in found.items()} == {
        "short": "a vertex has not three coordinates", "outside": "a vertex that is not there", "flat": "no vertices", "missing": "no vertices", "list": "objects are not objects", "ok": None,
    }
    assert all((r.json is None) == (r.wrong is not None) for r in found.values())


def test_files(spark):
    files = {
        "a/box.city.json": lit.text(lit.BOX).encode(), "b.JSON": b'{"type": "Feature", "x": 1.50}', "list.json": b"[1]", "broken.json": b"{", "empty.json": b"", "latin.json": b'"\xff"',
        "twice.json": b'{"type":"CityJSON","type":"CityJSON","vertices":[]}', "notes.txt": b"\x00\xff", "bad.json": b'{"type":"CityJSON"}', "number.json": b'{"type": 5}', "none.txt": b"",
    }
    found = {r.rel_path: r for r in rewrite.converted_files(spark.createDataFrame(list(files.items()), "rel_path string, content binary")).collect()}
    status = {k: r.status for k, r in found.items()}
    assert {k for k, s in status.items() if s == "error"} == {"broken.json", "empty.json", "latin.json", "twice.json", "bad.json"}
    assert {k for k, s in status.items() if s == "converted"} == {"a/box.city.json"}
    for k, r in found.items():
        assert (r.body is None) == (r.status == "error") and r.message
        assert r.status != "copied" or bytes(r.body) == files[k]
    assert rewrite.converted_files(spark.createDataFrame([], "rel_path string, content binary")).collect() == []


@pytest.mark.parametrize("value, want", [([1, [2, [30, [-4]], []]], [11, [12, [40, [6]], []]]), ([], []), ([[[[0, 1]]]], [[[[10, 11]]]])])
def test_indices_are_shifted_at_any_nesting(spark, value, want):
    row = spark.createDataFrame([(json.dumps(value, separators=(",", ":")),)], "t string").select(doc.shifted(F.col("t"), F.lit(10)).alias("t")).first()
    assert json.loads(row.t) == want


def brute_merge(docs):
    out, offset = {"type": "CityJSON", "version": "1.1", "CityObjects": {}, "vertices": [], "metadata": {"datasetLod": "1"}}, 0
    shift = lambda b: b + offset if isinstance(b, int) else [shift(x) for x in b]
    for d in docs:
        for name, o in d.get("CityObjects", {}).items():
            out["CityObjects"][name] = {**o, "geometry": [{**g, "boundaries": shift(g["boundaries"])} for g in o.get("geometry", [])]}
        out["vertices"] += d["vertices"]
        offset += len(d["vertices"])
    return out


def test_merged_documents_of_mixed_geometries(spark):
    groups = {1: ["box", "rich", "quantized", "court"], 2: ["plain"], 3: ["none", "objects"], 4: ["half", "box", "none", "plain"]}
    rows = [(g, k, lit.text(DOCS[n])) for g, names in groups.items() for k, n in enumerate(names)] + [(5, 0, "{")]
    found = {r.g: json.loads(r.json) for r in rewrite.merged(spark.createDataFrame(rows, "g int, place int, value string"), ["g"], "place").collect()}
    assert found == {g: brute_merge([DOCS[n] for n in names]) for g, names in groups.items()}
