"""Queries of planes and networks against a plain version over the same buildings, with a library's decompositions."""

import itertools
import json
import os

import duckdb
import numpy as np
import pytest

from stratablock.operators import network
from stratablock.plans import dataset_queries, model_queries, registry, synthetic  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def buildings():
    """id -> (vertices, faces as lists of vertex ids, edge probabilities), from SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    sql = synthetic.sql
    out = {}
    for i, _, x, y, z in con.execute(sql("SELECT id, vid, x, y, z FROM vertices ORDER BY id, vid")).fetchall():
        out.setdefault(i, ([], {}, {}))[0].append((x, y, z))
    for i, face, vid in con.execute(sql("SELECT id, face, vid FROM faces ORDER BY id, face, pos")).fetchall():
        out[i][1].setdefault(face, []).append(vid)
    for i, a, b, p in con.execute(sql("SELECT id, src, dst, prob FROM probs", model_queries.PROBS)).fetchall():
        out[i][2][a, b] = p
    return {i: (np.array(v), [f[k] for k in sorted(f)], p) for i, (v, f, p) in out.items()}


def flattened(points):
    """The corners in the plane of least squares, and the surface types that either sign of its normal gives."""
    middle = points.mean(axis=0)
    normal = np.linalg.svd(points - middle)[2][-1]
    up = abs(normal[2])
    if up > 0.9:
        normal, kinds = np.array([0, 0, 1.0]), {"RoofSurface", "GroundSurface"}
    elif up < 0.1:
        normal = np.array([normal[0], normal[1], 0]) / np.hypot(normal[0], normal[1])
        kinds = {"WallSurface"}
    else:
        kinds = {"RoofSurface", "WallSurface"}
    return points - np.outer((points - middle) @ normal, normal), kinds


def clear(points):
    """Whether the plane is unique: the two smallest spreads differ, and so does the normal from where it is snapped."""
    _, spread, axes = np.linalg.svd(points - points.mean(axis=0))
    spread = np.append(spread, np.zeros(3 - len(spread)))
    return spread[1] - spread[2] > 1e-6 and min(abs(abs(axes[-1][2]) - at) for at in (0.1, 0.9)) > 1e-6


def averaged(vertices, faces):
    sums, n = np.zeros_like(vertices), np.zeros(len(vertices))
    for f in faces:
        sums[f] += flattened(vertices[f])[0]
        n[f] += 1
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], vertices)


def test_straighten_faces(spark, buildings):
    rows = registry.QUERIES["straighten_faces"](spark, SF).collect()
    assert len(rows) == sum(len(f) for _, faces, _ in buildings.values() for f in faces)
    plain = {(i, k): flattened(v[f]) for i, (v, faces, _) in buildings.items() for k, f in enumerate(faces)}
    for r in rows:
        points, kinds = plain[r.id, r.face]
        face = buildings[r.id][1][r.face]
        assert r.node == face[r.pos]
        if clear(buildings[r.id][0][face]):
            assert r.surface_type in kinds and np.allclose(points[r.pos], (r.x, r.y, r.z), atol=2e-6)
    assert sum(clear(v[f]) for v, faces, _ in buildings.values() for f in faces) > 0.9 * len(plain)


def test_regularize(spark, buildings):
    rows = registry.QUERIES["regularize"](spark, SF).collect()
    assert len(rows) == sum(len(v) for v, _, _ in buildings.values())
    plain = {i: averaged(v, faces) for i, (v, faces, _) in buildings.items() if all(clear(v[f]) for f in faces)}
    assert len(plain) > 0.7 * len(buildings)
    assert all(np.allclose(plain[r.id][r.node], (r.x, r.y, r.z), atol=1e-6) for r in rows if r.id in plain)


def chordless(edges, longest=8):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for size in range(3, min(longest, len(near)) + 1):
        for among in itertools.combinations(sorted(near), size):
            # a chordless cycle is all of the edges among its nodes: two a node, and connected
            own = {a: near[a] & set(among) for a in among}
            if any(len(v) != 2 for v in own.values()):
                continue
            path = [among[0], min(own[among[0]])]
            while len(path) < size:
                path.append(next(iter(own[path[-1]] - {path[-2]})))
                if path[-1] == path[0]:
                    break
            if len(set(path)) == size:
                out.append(path)
    return sorted(out)


def test_reconstruct_buildings(spark, buildings):
    rows = {r.id: r for r in registry.QUERIES["reconstruct_buildings"](spark, SF).collect()}
    checked = 0
    for i, (vertices, _, probs) in buildings.items():
        faces = chordless([e for e, p in probs.items() if e[0] < e[1] and p > 0.5])
        assert (i in rows) == bool(faces)
        if not faces:
            continue
        doc = rows[i]
        assert doc.name == f"building_{i}" and [f for (f,) in json.loads(doc.boundaries)] == faces
        sure = [clear(vertices[f]) for f in faces]
        assert all(t in flattened(vertices[f])[1] for t, f, ok in zip(doc.surfaces.split(","), faces, sure, strict=True) if ok)
        if all(sure):
            checked += 1
            assert np.allclose([[int(c) / 1e5 for c in v.split()] for v in doc.vertices.split(",")], averaged(vertices, faces), atol=6e-6)
    assert checked > 10


def test_generate_buildings(spark):
    """Sampled graphs, put together by the plain version, have the faces that the query counts."""
    got = {r.id: (r.n_vertices, r.n_faces) for r in registry.QUERIES["generate_buildings"](spark, SF).collect()}
    options = model_queries.GENERATED
    weights = network.random_weights(**options["weights"])
    want = {}
    for r in network.sample_graphs(spark, weights, options["count"], options["n"], steps=options["steps"], seed=options["seed"]).collect():
        active = [x["node"] for x in r.nodes if x["class"] == 0]
        if len(active) < 3:
            continue
        edges = [(p.src, p.dst) for p in r.probs if p.src < p.dst and p.prob > options["threshold"] and p.src in active and p.dst in active]
        if faces := chordless(edges):
            want[r.id] = (len(active), len(faces))
    assert got == want and got
