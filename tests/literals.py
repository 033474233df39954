"""City documents with hand-computed answers."""

import copy
import json

BOX = {
    "type": "CityJSON",
    "vertices": [[0, 0, 0], [4, 0, 0], [4, 3, 0], [0, 3, 0], [0, 0, 5], [4, 0, 5], [4, 3, 5], [0, 3, 5]],
    "CityObjects": {
        "box": {
            "type": "Building",
            "geometry": [
                {
                    "type": "Solid",
                    "lod": "2",
                    "boundaries": [[[[0, 1, 2, 3]], [[4, 5, 6, 7]], [[0, 1, 5, 4]], [[1, 2, 6, 5]], [[2, 3, 7, 6]], [[3, 0, 4, 7]]]],
                    "semantics": {"surfaces": [{"type": "GroundSurface"}, {"type": "RoofSurface"}, {"type": "WallSurface"}], "values": [[0, 1, 2, 2, 2, 2]]},
                }
            ],
        }
    },
}


def variant(**changes):
    doc = copy.deepcopy(BOX)
    doc.update(changes)
    return doc


def geometry(doc, name="box"):
    return doc["CityObjects"][name]["geometry"][0]


def two_roofs():
    doc = variant(vertices=[*BOX["vertices"], *[[x, y, z] for x, y in ((0, 0), (4, 0)) for z in (3, 3)], [4, 3, 5], [0, 3, 5], [0, 0, 3], [4, 0, 3], [4, 3, 6], [0, 3, 6]])
    g = geometry(doc)
    g["boundaries"] = [[[[0, 1, 2, 3]], [[8, 10, 12, 13]], [[14, 15, 16, 17]]]]
    g["semantics"] = {"surfaces": [{"type": t} for t in ("GroundSurface", "RoofSurface", "RoofSurface", "WallSurface")], "values": [[0, 1, 2]]}
    return doc


def courtyard():
    outer, inner = [[0, 0, 0], [4, 0, 0], [4, 4, 0], [0, 4, 0]], [[1, 1, 0], [3, 1, 0], [3, 3, 0], [1, 3, 0]]
    doc = variant(vertices=[*outer, *inner, *[[x, y, 2] for x, y, _ in outer]])
    g = geometry(doc)
    g["boundaries"] = [[[[0, 1, 2, 3], [4, 5, 6, 7]], [[8, 9, 10, 11]]]]
    g["semantics"]["values"] = [[0, 1]]
    return doc


def no_semantics():
    doc = variant(vertices=[[0, 0, 0], [2, 0, 0.05], [2, 2, 0.1], [0, 2, 2]])
    doc["CityObjects"]["box"]["geometry"] = [{"type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2, 3]], []]}]
    return doc


def quantized():
    doc = variant(vertices=[[1000, 2000, 3000]] * 3, transform={"scale": [0.001] * 3, "translate": [10, 20, 30]})
    doc["CityObjects"]["box"]["geometry"] = [{"type": "MultiSurface", "boundaries": [[[0, 1, 2]]]}, {"type": "MultiPoint", "boundaries": [0]}]
    return doc


def text(doc):
    return json.dumps(doc)


DUPLICATE = '{"type":"CityJSON","vertices":[[0,0,0],[1,0,0],[0,1,0]],"CityObjects":{"a":{"type":"Old"},"b":{},"a":{"geometry":[{"type":"MultiSurface","boundaries":[[[0,1,2]]]}]}}}'
