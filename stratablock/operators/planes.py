"""Flattening faces to planes, and averaging the corners they share, as columns.

A face's plane is that of least squares: its normal is the direction of the
smallest spread of the corners. The adjugate of the scatter matrix has the same
directions, its largest value at the smallest spread; squaring it again and
again leaves that direction alone, or a projection on all of them where several
are equally small.

Which normal is meant, where geometry leaves it open:

* of equally small directions, the most upright (of these along y, then x);
* it points out of the building: away from the mean of the corners of all faces
  with the same leading keys. Where that is no side of the plane, its first
  entry that is not zero, of z, y, x, is positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays

#: A normal steeper than LEVEL is snapped to the vertical, one flatter than UPRIGHT to the horizontal.
LEVEL, UPRIGHT = 0.9, 0.1
#: Squarings: directions whose spreads differ by a ten-thousandth are told apart.
SQUARINGS = 16
#: Shares of the whole spread under which corners lie on a line, and distances that count as none.
_THIN, _NEAR = 1e-14, 1e-9
_ENTRIES = ("xx", "xy", "xz", "yy", "yz", "zz")


def corners(faces: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """key, face, pos, node, x, y, z. ``faces``: key, face, cycle; ``nodes``: key, node, x, y, z."""
    flat = faces.select(key, "face", F.posexplode("cycle").alias("pos", "node"))
    return flat.join(session.shuffled(nodes), [key, "node"])


def _moments() -> list[Column]:
    """Aggregates: centroid, and the six distinct entries of the unnormalized scatter matrix; both merge, in one pass."""
    n = F.count(F.lit(1))
    return [*(F.avg(c).alias(f"c{c}") for c in "xyz"), *((F.covar_pop(p[0], p[1]) * n).alias(f"s{p}") for p in _ENTRIES)]


def scatter(points: DataFrame, by: list[str]) -> DataFrame:
    """Centroid and the six distinct entries of the unnormalized scatter matrix of each face."""
    return points.groupBy(*by).agg(*_moments())


def _symmetric(value: dict[str, Column], size: Column) -> Column:
    return F.struct(*((value[p] / size).alias(p) for p in _ENTRIES))


def _squared(m: Column) -> Column:
    """The square of a symmetric matrix, of trace 1."""
    at = lambda a, b: m["".join(sorted(a + b))]
    square = F.struct(*(sum((at(p[0], k) * at(k, p[1]) for k in "yz"), at(p[0], "x") * at("x", p[1])).alias(p) for p in _ENTRIES))
    return arrays.let(square, lambda q: _symmetric(q, q["xx"] + q["yy"] + q["zz"]))


def _adjugate(s: dict[str, Column]) -> dict[str, Column]:
    return {
        "xx": s["yy"] * s["zz"] - s["yz"] * s["yz"], "xy": s["xz"] * s["yz"] - s["xy"] * s["zz"], "xz": s["xy"] * s["yz"] - s["xz"] * s["yy"],
        "yy": s["xx"] * s["zz"] - s["xz"] * s["xz"], "yz": s["xy"] * s["xz"] - s["xx"] * s["yz"], "zz": s["xx"] * s["yy"] - s["xy"] * s["xy"],
    }


def with_normal(faces: DataFrame, name: str = "normal") -> DataFrame:
    """``faces`` (sxx ... szz) with a unit normal, a struct of x, y, z: the direction of the smallest spread, of either sign."""
    s = {p: F.col(f"s{p}") for p in _ENTRIES}
    spread = s["xx"] + s["yy"] + s["zz"]
    adjugate = _adjugate(s)
    total = adjugate["xx"] + adjugate["yy"] + adjugate["zz"]
    one = {p: F.lit(float(p[0] == p[1])) for p in _ENTRIES}
    # corners on a line spread alike, not at all, in all directions across it; equal corners in every direction
    across = _symmetric({p: (one[p] - s[p] / spread) for p in _ENTRIES}, F.lit(2.0))
    start = F.when(spread <= 0, _symmetric(one, F.lit(3.0))).when(total <= _THIN * spread * spread, across).otherwise(_symmetric(adjugate, total))
    m = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), start, lambda a, _: _squared(a))
    return faces.withColumn(name, arrays.let(m, lambda m: arrays.let(_direction(m), _unit)))


def _direction(m: Column) -> Column:
    """A column of the matrix: along its only direction, or the most upright of several."""
    column = lambda c: F.struct(*(m["".join(sorted(c + k))].alias(k) for k in "xyz"))
    alone = sum((m[p] * m[p] * (1 if p[0] == p[1] else 2) for p in _ENTRIES[1:]), m["xx"] * m["xx"]) > 0.75
    best = F.when(m["zz"] >= F.greatest(m["xx"], m["yy"]), column("z")).when(m["yy"] >= m["xx"], column("y")).otherwise(column("x"))
    upright = F.when(m["zz"] > _NEAR, column("z")).when(m["yy"] > _NEAR, column("y")).otherwise(column("x"))
    return F.when(alone, best).otherwise(upright)


def _unit(d: Column) -> Column:
    return arrays.let(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]), lambda size: F.struct(*((d[c] / size).alias(c) for c in "xyz")))


def _turned(normal: Column, side: Column) -> Column:
    """The normal towards ``side`` (its product with what leads out of the building)."""
    sign = lambda v: F.when(F.abs(v) > _NEAR, F.signum(v))
    turn = F.coalesce(sign(side), sign(normal["z"]), sign(normal["y"]), F.signum(normal["x"]))
    return arrays.let(turn, lambda t: F.struct(*((normal[c] * t).alias(c) for c in "xyz")))


def _snapped(normal: Column) -> Column:
    up, flat = normal["z"], F.sqrt(normal["x"] ** 2 + normal["y"] ** 2)
    level = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.signum(up).alias("z"))
    upright = F.struct((normal["x"] / flat).alias("x"), (normal["y"] / flat).alias("y"), F.lit(0.0).alias("z"))
    return F.when(F.abs(up) > LEVEL, level).when(F.abs(up) < UPRIGHT, upright).otherwise(normal)


def straightened(points: DataFrame, by: list[str]) -> DataFrame:
    """One row per face: by, surface_type, and its corners ``p`` (pos, node, x, y, z) moved to the face's plane.

    ``points``: by, pos, node, x, y, z. All but the last of ``by`` name the building. A face's corners are one row; rows meet once, by
    building. A face without corners gives no row.
    """
    building, n = by[:-1], F.col("__n")
    rows = points.repartition(*(F.col(c) for c in building)) if building else points
    faces = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "x", "y", "z"))).alias("p"), F.count(F.lit(1)).alias("__n"), *_moments())
    of = Window.partitionBy(*building)
    faces = with_normal(faces.withColumns({f"__{c}": F.sum(F.col(f"c{c}") * n).over(of) / F.sum(n).over(of) for c in "xyz"}))
    out = {c: F.col(f"c{c}") - F.col(f"__{c}") for c in "xyz"}
    normal = arrays.let(F.col("normal"), lambda v: _turned(v, v["x"] * out["x"] + v["y"] * out["y"] + v["z"] * out["z"]))
    up = F.col("normal")["z"]
    kind = F.when(F.abs(up) < UPRIGHT, "WallSurface").when(up > 0, "RoofSurface").when(up < -LEVEL, "GroundSurface").otherwise("WallSurface")

    def onto(p: Column, n: Column) -> Column:
        away = lambda c: (c["x"] - F.col("cx")) * n["x"] + (c["y"] - F.col("cy")) * n["y"] + (c["z"] - F.col("cz")) * n["z"]
        moved = lambda c: arrays.let(away(c), lambda a: F.struct(c["pos"].alias("pos"), c["node"].alias("node"), *((c[k] - a * n[k]).alias(k) for k in "xyz")))
        return F.transform(p, moved)

    return faces.withColumn("normal", normal).select(*by, kind.alias("surface_type"), arrays.let(_snapped(F.col("normal")), lambda n: onto(F.col("p"), n)).alias("p"))


def corners_of(p: Column) -> Column:
    """The corners of ``straightened`` as rows. A face has one at least: an inner generator would test that first, on the plane worked out once for each mention."""
    return F.inline_outer(p)


def straighten_faces(points: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (by, pos, node, x, y, z) moved to their face's plane, with ``surface_type``."""
    return straightened(points, by).select(*by, "surface_type", corners_of(F.col("p")))


def mean_projection(nodes: DataFrame, moved: DataFrame, key: str = "id") -> DataFrame:
    """``nodes`` at the mean of their projections; nodes of no face stay where they are."""
    mean = moved.groupBy(key, "node").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return nodes.join(session.shuffled(mean), [key, "node"], "left").select(key, "node", *(F.coalesce(f"m{c}", F.col(c)).alias(c) for c in "xyz"))


def regularize(nodes: DataFrame, faces: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes after flattening all faces, and key, face, surface_type."""
    flat = straightened(corners(faces, nodes, key), [key, "face"])
    return mean_projection(nodes, flat.select(key, corners_of(F.col("p"))), key), flat.select(key, "face", "surface_type")
