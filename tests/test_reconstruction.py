import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratablock.operators import cycles, diffusion, export, network, planes

CUBE = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]


def both(spark, graphs):
    rows = [(k, a, b) for k, edges in graphs.items() for x, y in edges for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(rows, "id long, src int, dst int")


def brute(edges, longest=8):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for size in range(3, longest + 1):
        for path in itertools.permutations(sorted(near), size):
            if path[0] != min(path) or path[1] > path[-1]:
                continue
            if all((path[j] in near[path[i]]) == (abs(i - j) in (1, size - 1)) for i in range(size) for j in range(i)):
                out.append(list(path))
    return sorted(out)


def test_known_graphs(spark):
    graphs = {1: CUBE, 2: [(0, 1), (1, 2), (2, 0), (1, 3), (2, 3)], 3: [(0, 1)]}
    found = {}
    for r in cycles.chordless(both(spark, graphs)).collect():
        found.setdefault(r.id, []).append(list(r.cycle))
    assert sorted(map(len, found[1])) == [4] * 6 + [6] * 4
    assert sorted(found[2]) == [[0, 1, 2], [1, 2, 3]] and 3 not in found


def test_cycles_equal_brute_force(spark):
    rng = random.Random(7)
    graphs = {k: [e for e in itertools.combinations(range(7), 2) if rng.random() < 0.45] for k in range(25)}
    found = {}
    for r in cycles.chordless(both(spark, graphs), 6).collect():
        found.setdefault(r.id, []).append(list(r.cycle))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, e in graphs.items() if (v := brute(e, 6))}


def test_threshold_is_strict_and_mirrored(spark):
    probs = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, 0.6), (1, 2, 1, 0.9)], "id long, src int, dst int, prob double")
    assert {(r.src, r.dst) for r in cycles.threshold_edges(probs).collect()} == {(0, 2), (2, 0)}


def test_few_active_nodes_are_dropped(spark):
    classes = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 1), (2, 1, 0), (2, 2, 0), (2, 3, 0)], "id long, node int, class int")
    probs = spark.createDataFrame([(k, a, b, 0.1 * a + b) for k in (1, 2) for a in range(4) for b in range(4)], "id long, src int, dst int, prob double")
    numbered, among = cycles.active_edges(probs, classes)
    assert {(r.id, r.node, r.new) for r in numbered.collect()} == {(2, 1, 0), (2, 2, 1), (2, 3, 2)}
    assert among.count() == 9 and among.filter("src = 0 and dst = 2").first().prob == pytest.approx(3.1)


def flat(spark, faces):
    """Faces (lists of points) of one building, straightened: (points, surface type) by face."""
    rows = [(1, f, pos, pos, *map(float, p)) for f, points in enumerate(faces) for pos, p in enumerate(points)]
    found = planes.straightened(spark.createDataFrame(rows, "id long, face int, pos int, node int, x double, y double, z double"), ["id", "face"])
    return {r.face: (np.array([[c.x, c.y, c.z] for c in r.p]), r.surface_type) for r in found.collect()}


@pytest.mark.parametrize("points,kind", [([[0, 0, 1], [1, 0, 1.05], [1, 1, 0.95], [0, 1, 1]], "RoofSurface"), ([[0, 0, 0], [2, 0, 0], [2, 0.01, 2], [0, 0, 2]], "WallSurface")])
def test_straightened_corners_lie_in_a_plane(spark, points, kind):
    moved, found = flat(spark, [points])[0]
    spread = moved - moved.mean(axis=0)
    assert np.linalg.eigvalsh(spread.T @ spread)[0] < 1e-12 and found == kind
    if kind == "RoofSurface":
        assert np.ptp(moved[:, 2]) < 1e-12


def test_normals_point_out_of_the_building(spark):
    box = np.array([[x, y, z] for z in (0, 3) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))], float)
    slope = [[0, 0, 5], [4, 0, 9], [4, 2, 9], [0, 2, 5]]
    under = [[0, 0, -2], [4, 0, -4], [4, 2, -4], [0, 2, -2]]
    found = flat(spark, [box[:4], box[4:], box[[0, 1, 5, 4]], slope, under])
    assert [found[k][1] for k in range(5)] == ["GroundSurface", "RoofSurface", "WallSurface", "RoofSurface", "WallSurface"]
    assert np.allclose(found[3][0], slope) and np.allclose(found[4][0], under)


def test_normals_equal_the_solver_of_a_library(spark):
    rng = np.random.default_rng(5)
    faces = [rng.normal(size=(k % 6 + 3, 3)) * rng.choice([1e-3, 1.0, 1e3], 3) for k in range(60)]
    found = flat(spark, faces)
    for k, points in enumerate(faces):
        away = points - points.mean(axis=0)
        spread, axes = np.linalg.eigh(away.T @ away)
        up = abs(axes[2, 0])
        normal = np.array([0, 0, 1.0]) if up > 0.9 else axes[:, 0] * [1, 1, up >= 0.1] / (1 if up >= 0.1 else np.hypot(*axes[:2, 0]))
        assert spread[1] - spread[0] < 1e-3 * spread[1] or np.allclose(found[k][0], points - np.outer(away @ normal, normal), rtol=1e-5, atol=1e-5 * np.abs(points).max())


@pytest.mark.parametrize("points, kind", [([[1, 1, 1]] * 3, "RoofSurface"), ([[0, 0, 0], [1, 0, 0], [2, 0, 0]], "RoofSurface"), ([[0, 0, 0], [0, 0, 1], [0, 0, 5]], "WallSurface"), ([[0, 0, 0], [1, 1, 0], [0, 1, 1], [1, 0, 1]], "RoofSurface")])
def test_most_upright_of_equal_directions(spark, points, kind):
    """One point, corners on a line, on a vertical line, and equal spreads in all directions."""
    moved, found = flat(spark, [points])[0]
    assert found == kind and np.ptp(moved[:, 2]) < 1e-9 if kind == "RoofSurface" else np.allclose(moved, points)


def test_error_function(spark):
    z = [k / 64 for k in range(-500, 501)] + [0.46875, -0.46875, 4.0, 6.0, 1e-300, 30.0, -30.0]
    rows = spark.createDataFrame([(x,) for x in z] + [(None,)], "z double")
    found = {r.z: r.e for r in rows.select("z", diffusion.erf(F.col("z")).alias("e")).collect()}
    assert max(abs(found[x] - math.erf(x)) for x in z) < 1e-15 and found[None] is None


def test_regularize_keeps_free_nodes(spark):
    nodes = spark.createDataFrame([(1, k, float(k % 2), float(k // 2), 0.0) for k in range(5)], "id long, node int, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, [0, 1, 3, 2])], "id long, face int, cycle array<int>")
    moved, kinds = planes.regularize(nodes, faces)
    at = {r.node: (r.x, r.y, r.z) for r in moved.collect()}
    assert at[4] == (0.0, 2.0, 0.0) and np.allclose(at[3], (1, 1, 0)) and kinds.count() == 1


def cube(spark):
    points = [(x, y, z) for z in (0, 3) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))]
    nodes = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(points)], "id long, node int, x double, y double, z double")
    edges = {tuple(sorted(e)) for e in CUBE}
    probs = spark.createDataFrame([(1, a, b, 0.9 if (a, b) in edges else 0.1) for a in range(8) for b in range(8)], "id long, src int, dst int, prob double")
    return nodes, probs


def test_reconstructed_document(spark):
    nodes, probs = cube(spark)
    doc = json.loads(export.document(export.reconstruct(nodes, probs), F.lit('a "b"')).first().json)
    g = doc["CityObjects"]['a "b"']["geometry"][0]
    assert (doc["type"], doc["version"], g["type"], g["lod"], doc["metadata"]) == ("CityJSON", "1.1", "Solid", "1", {"datasetLod": "1"})
    faces = [f[0] for f in g["boundaries"][0]]
    assert faces == sorted(faces) and len(faces) == 10 and len(g["semantics"]["values"][0]) == 10 and len(doc["vertices"]) == 8
    assert [s["type"] for s in g["semantics"]["surfaces"]] == list(export.SURFACE_TYPES)
    # the same as flattening, then averaging
    cyc = spark.createDataFrame([(1, k, f) for k, f in enumerate(faces)], "id long, face int, cycle array<int>")
    moved = {r.node: (r.x, r.y, r.z) for r in planes.regularize(nodes, cyc)[0].collect()}
    assert np.allclose([moved[k] for k in range(8)], doc["vertices"])
    assert export.reconstruct(nodes, probs.withColumn("prob", F.lit(0.5))).count() == 0


def test_merge_shifts_and_names(spark):
    docs = spark.createDataFrame(
        [(0, 1, "a", [[0.0, 0.0, float(k)] for k in range(4)], [[[0, 1, 2, 3]]]), (0, 2, "b", [[1.0, 1.0, float(k)] for k in range(3)], [[[0, 1, 2]]])],
        "g int, id int, name string, vertices array<array<double>>, boundaries array<array<array<int>>>",
    )
    whole = export.merge(docs, ["g"], "id").first()
    assert whole.objects["b"] == [[[4, 5, 6]]] and len(whole.vertices) == 7
    values = spark.createDataFrame([("a", [0]), ("b", [1])], "name string, surface_values array<int>")
    out = export.combined(export.merge(docs, ["g"], "id"), values).first()
    assert out.file_name == "all_buildings.city.json" and set(json.loads(out.json)["CityObjects"]) == {"a", "b"}


def test_schedule(spark):
    a = [r.alpha_bar for r in diffusion.schedule(spark).orderBy("t").collect()]
    assert a[0] == 1 and a[-1] < 1e-6 and all(x > y for x, y in zip(a, a[1:], strict=False))
    assert np.allclose(a, network.alphas(500))


def test_noise_kinds(spark):
    rows = spark.range(4000).select("id", F.lit(1.0).alias("y"))
    for kind, values in (("uniform", {0.0, 1.0}), ("absorbing", {0.5, 1.0}), ("discretized_gaussian", {0.0, 1.0})):
        out = rows.select(diffusion.edge_noise(F.col("y"), F.lit(0.6), kind, 1, F.col("id")).alias("v")).collect()
        assert {r.v for r in out} == values
        if kind == "uniform":
            assert abs(sum(r.v for r in out) / 4000 - 0.8) < 0.03  # kept, or a coin
    with pytest.raises(ValueError):
        diffusion.check_noise("other")
    for kind in diffusion.NOISE:
        x = diffusion.category_noise([F.lit(1.0), F.lit(0.0)], F.lit(0.5), kind, 2, F.col("id"))
        assert all(abs(r.a + r.b - 1) < 1e-9 for r in rows.select(x[0].alias("a"), x[1].alias("b")).collect())
        for t in (1, 5):
            step = diffusion.category_step([F.lit(0.3), F.lit(-0.2)], x, F.lit(0.5), F.lit(0.6), t, kind, 3, F.col("id"))
            assert all(abs(r.a + r.b - 1) < 1e-9 for r in rows.limit(50).select(step[0].alias("a"), step[1].alias("b")).collect())
            edge = diffusion.edge_step(F.lit(0.4), F.lit(1.0), F.lit(0.5), F.lit(0.6), t, kind, 4, F.col("id"))
            assert {r.v for r in rows.limit(50).select(edge.alias("v")).collect()} <= {0.0, 0.5, 1.0}


def test_noise_is_centred_and_replays(spark):
    nodes = spark.createDataFrame([(g, k, 0.0, 0.0, 0.0, 1.0) for g in range(3) for k in range(6)], "id int, node int, x double, y double, z double, mask double")
    run = lambda df: sorted(map(tuple, diffusion.coordinate_noise(df, F.lit(0.3), 5, ["id"]).select("id", "node", "xt", "yt", "zt").collect()))
    one, two = run(nodes), run(nodes.repartition(5))
    assert np.allclose(one, two)
    assert abs(sum(r[2] for r in one if r[0] == 1)) < 1e-5


def test_network_is_equivariant_to_rotation():
    w = network.random_weights(hidden=12, layers=2, seed=3)
    rng = np.random.default_rng(1)
    r = rng.normal(size=(6, 3))
    r -= r.mean(axis=0)
    x, y = np.eye(2)[rng.integers(0, 2, 6)], (rng.random((6, 6, 1)) > 0.5) * 1.0
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    a, ea, ca = network.forward(w, x, r, y)
    b, eb, cb = network.forward(w, x, r @ turn, y)
    assert np.allclose(a @ turn, b) and np.allclose(ea, eb) and np.allclose(ca, cb) and np.allclose(ea, ea.T)
    masked, _, _ = network.forward(w, x, r, y, np.array([1, 1, 1, 1, 0, 0.0]))
    assert np.allclose(masked[4:], 0)


@pytest.mark.parametrize("kind", diffusion.NOISE)
def test_sampling_runs(kind):
    w = network.random_weights(hidden=8, layers=1)
    r, p, c = network.sample(w, 5, 2, 12, kind, np.random.default_rng(0))
    assert r.shape == (5, 3) and ((p >= 0) & (p <= 1)).all() and set(c) <= {0, 1} and np.isfinite(r).all()


def test_generation_and_missing_checkpoint(spark, tmp_path):
    w = network.random_weights(hidden=8, layers=1)
    assert network.sample_graphs(spark, w, 3, 4, steps=5).count() == 3
    assert network.generate(spark, w, 3, 4, steps=5).columns == ["id", "vertices", "boundaries", "surface_values"]
    with pytest.raises(SystemExit):
        network.load_weights(None)
    np.savez(tmp_path / "w.npz", **w)
    assert set(network.load_weights(str(tmp_path / "w.npz"))) == set(w)
