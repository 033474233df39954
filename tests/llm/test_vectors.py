"""Hard negatives and whitening against plain versions on small tables with the awkward cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratablock.llm import negatives, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score string, x string"


def vector_rows(n=700, width=6, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 0.3) for _ in range(width)]
        if i % 3 == 0:
            v = [0.25, -0.5, 0.125, 0.0, 0.5, 0.75]  # a third of all rows have one vector
        rows.append((i, v, rng.randrange(4), "clash", "clash"))
    rows += [rows[5], rows[100], (200, rows[7][1], 1, "", ""), (None, rows[8][1], 2, "", ""), (None, None, None, "", "")]
    rows += [(900, [0.1, 0.2], 1, "", ""), (1000, [], 1, "", ""), (901, None, 1, "", ""), (902, [None] + [0.1] * 5, 1, "", "")]
    rows += [(903, [math.nan] + [0.1] * 5, 1, "", ""), (904, [math.inf] + [0.1] * 5, 1, "", ""), (905, rows[9][1], None, "", "")]
    return rows


def whole(v, scale, shift=0):
    return [math.floor(scale * float(np.float32(c))) + shift for c in v]


def takes_part(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_negatives(rows, positives=5, count=5):
    own = {(i, tuple(whole(v, 256)), label) for i, v, label, *_ in rows if takes_part(v) and label is not None}
    width = max((len(v) for _, v, _ in own), default=0)
    own = sorted(((i, v + (0,) * (width - len(v)), label, k) for k, (i, v, label) in enumerate(sorted(own, key=str))), key=lambda r: (r[0] is None, r[0] or 0))
    last = math.inf
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in own:
        if a[0] is None or a[0] % 100:
            continue
        by = sorted(((-dot(a[1], r[1]), last if r[0] is None else r[0], r[2]) for r in own if r is not a))
        for s, i, _ in [r for r in by if r[2] == a[2]][:positives]:
            fit = [r for r in by if r[2] != a[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:count]
            out += [(a[0], None if i == last else i, k, None if r[1] == last else r[1], -s, -r[0]) for k, r in enumerate(fit, 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("leaf, shards", [(8, 1), (8, 40), (256, 4096)])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf, shards):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "LEAST_ROWS", shards)
    rows = vector_rows()
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0)
    want = brute_negatives(rows)
    assert len(want) > 50
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_sums_beyond_doubles_are_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**28), 2**28, (400, 5))
    x[:200] += 2**29
    ids, labels = np.arange(400), np.zeros(400, int)
    shard = negatives.Shard(ids, labels, x, 6)
    q = x[::50]
    got = shard.search(q, np.zeros(8, int), np.arange(8), np.full(8, -(2**63)), np.full(8, 2**63 - 1), True, 3)
    for k in range(8):
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(q[k], r, strict=True)), i) for i, r in enumerate(x)))[:3]
        assert [(-int(s), int(p)) for a, p, s in zip(*got, strict=True) if a == k] == exact
    with pytest.raises(ValueError, match="fit"):
        negatives.Shard(ids, labels, x * 8, 6).search(q * 8, np.zeros(8, int), np.arange(8), np.full(8, -(2**63)), np.full(8, 2**63 - 1), True, 3)


def test_negatives_of_empty_and_single_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, "", ""), (1, [1.0], 2, "", "")], SCHEMA)
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0).collect() == []


def test_balls_hold_their_points():
    x = np.random.default_rng(3).integers(-300, 300, (3000, 4))
    tree = negatives.Tree(x, np.arange(3000))
    assert sorted(p for *_, leaf, _ in tree.nodes if leaf is not None for p in leaf) == list(range(3000))
    for c, r, leaf, _ in tree.nodes:
        assert leaf is None or np.sqrt(((x[leaf] - c) ** 2).sum(axis=1)).max() <= r + 1e-9


def test_residues_give_exact_whole_numbers():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**40), 2**40, (9000, 3))
    moduli = whitening.primes(2 * 9000 * 2**80)
    exact = x.T.astype(object) @ x.astype(object)
    assert (whitening.reconstructed(whitening.residue_scatter(x, moduli), moduli) == exact).all()


def test_whitening_equals_plain_version(spark):
    rows = vector_rows()
    part = [(r[0], whole(r[1], 64, 1_000_000)) for r in rows if takes_part(r[1])]
    x = np.array([v + [1_000_000] * (6 - len(v)) for _, v in part])
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = centred @ u / np.sqrt(e)
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == n * 6 and {r["n"] for r in found} == {n}
    where = next(k for k, (i, _) in enumerate(part) if i == 1)
    sign = {r["component"]: np.sign(r["whitened"] * want[where, r["component"] - 1]) for r in found if r["vec_id"] == 1}
    got = sorted((key((r["vec_id"], r["deviation"], r["component"])), r["whitened"] * sign[r["component"]], r["explained"]) for r in found)
    plain = sorted((key((i, int(((n * x[k] - total) ** 2).sum()), c + 1)), want[k, c], e[c] / e.sum()) for k, (i, _) in enumerate(part) for c in range(6))
    assert [g[0] for g in got] == [p[0] for p in plain]
    assert np.allclose([g[1:] for g in got], [p[1:] for p in plain], rtol=1e-7, atol=1e-7)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_whitening_of_flat_empty_and_large_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, "", "")], SCHEMA)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 1, "", ""), (2, [0.5, 2.0], 1, "", "")], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None, r["deviation"], r["explained"]) for r in flat) == [(1, 1, False, 64**2, 1.0), (1, 2, True, 64**2, 0.0), (2, 1, False, 64**2, 1.0), (2, 2, True, 64**2, 0.0)]
    assert {r["identity_error"] for r in flat} == {0.0}
    big = whitening.whiten(spark.createDataFrame([(i, [(-1.0) ** i * 2.0**k for k in range(8)], 1, "", "") for i in range(9)], SCHEMA), scale=2**18)
    n = [(2**18 * 2**k * (1 if i % 2 == 0 else -1) + 1_000_000) for i in range(9) for k in range(8)]
    sums = [sum(n[k::8]) for k in range(8)]
    assert {r["vec_id"]: r["deviation"] for r in big.collect()} == {i: sum((9 * n[8 * i + k] - sums[k]) ** 2 for k in range(8)) for i in range(9)}


def test_which_vectors_take_part(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.filter(vectors.finite(F.col("embedding"))).count() == sum(takes_part(r[1]) for r in rows)
    assert {"op11_hard_negatives", "op13_whitening"} <= set(queries.QUERIES)
