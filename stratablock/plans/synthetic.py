"""A mesh computed from the ``part`` table: one prism per row, in the engine's mesh schema and in SQL.

Every third building is triangular, odd ones have a clockwise footprint, roof
corners stand at different heights, every sixth building from 5 on has no
semantics. The building is its own file; vertex ids are local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

SURFACES = ["GroundSurface", "RoofSurface", "WallSurface"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return session.dealt(table(spark, sf_dir, "part"), "p_partkey").select(
        k.alias("id"), F.when(k % 3 == 0, 3).otherwise(4).alias("n"),
        (1 + F.col("p_size") % 7).cast("double").alias("w"), (1 + k % 5).cast("double").alias("d"), (2 + F.col("p_size") % 11).cast("double").alias("h"),
        (k % 4).cast("double").alias("z0"), (k % 13).cast("double").alias("x0"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, vid, x, y, z, raw_z."""
    i = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    at = buildings(spark, sf_dir).select("*", i).withColumn("c", F.when(F.col("id") % 2 == 1, F.col("n") - 1 - F.col("i")).otherwise(F.col("i")))
    x = F.col("x0") + F.when(F.col("c").isin(1, 2), F.col("w")).otherwise(0.0)
    y = F.when(F.col("c").isin(2, 3), F.col("d")).otherwise(0.0)
    top = F.col("z0") + F.col("h") + (F.col("i") % 2) * (F.col("id") % 3)
    both = F.array(F.struct(F.col("i").alias("vid"), F.col("z0").alias("z")), F.struct((F.col("n") + F.col("i")).alias("vid"), top.alias("z")))
    return at.select(F.col("id").alias("file"), x.alias("x"), y.alias("y"), F.inline(both)).select("file", "vid", "x", "y", "z", F.col("z").alias("raw_z"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per face, with its semantic index; null where the building has no semantics."""
    n = F.col("n")
    steps = F.sequence(F.lit(0), n - 1)
    walls = F.transform(steps, lambda i: F.array(i, (i + 1) % n, n + (i + 1) % n, n + i))
    faces = F.concat(F.array(steps, F.transform(steps, lambda i: n + i)), walls)
    flat = buildings(spark, sf_dir).select("id", F.posexplode(faces).alias("face", "vids"))
    known = F.col("id") % 6 != 5
    return flat.select(
        F.col("id").alias("file"), F.lit(0).alias("obj_pos"), F.col("id").alias("obj"), F.lit(0).alias("geom"), F.lit(0).alias("shell"), "face", F.lit(0).alias("ring"),
        F.when(known, F.array(*map(F.lit, SURFACES))).alias("surfaces"), F.when(known, F.least(F.col("face"), F.lit(2))).alias("surface"), "vids",
    )


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir).select(
        F.col("id").alias("file"), F.lit(0).alias("obj_pos"), F.col("id").alias("obj"), F.lit(0).alias("geom"), F.lit("Solid").alias("geom_type"),
        F.when(F.col("id") % 6 != 5, F.array(*map(F.lit, SURFACES))).alias("surfaces"),
    )


#: The same tables for DuckDB; ``faces`` has a row per face corner, ``kind`` is its semantic index.
SQL = """
b AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END AS n, CAST(1 + p_size % 7 AS DOUBLE) AS w, CAST(1 + p_partkey % 5 AS DOUBLE) AS d,
    CAST(2 + p_size % 11 AS DOUBLE) AS h, CAST(p_partkey % 4 AS DOUBLE) AS z0, CAST(p_partkey % 13 AS DOUBLE) AS x0 FROM part),
corner AS (
  SELECT b.*, i, CASE WHEN id % 2 = 1 THEN n - 1 - i ELSE i END AS c FROM b, (VALUES (0), (1), (2), (3)) r(i) WHERE i < n),
placed AS (
  SELECT *, x0 + CASE WHEN c IN (1, 2) THEN w ELSE 0 END AS x, CASE WHEN c IN (2, 3) THEN d ELSE 0 END AS y FROM corner),
vertices AS (
  SELECT id, CAST(i AS INT) AS vid, x, y, z0 AS z FROM placed
  UNION ALL SELECT id, CAST(n + i AS INT), x, y, z0 + h + (i % 2) * (id % 3) FROM placed),
faces AS (
  SELECT id, 0 AS face, i AS pos, i AS vid, 0 AS kind FROM corner
  UNION ALL SELECT id, 1, i, n + i, 1 FROM corner
  UNION ALL SELECT id, 2 + i, p, CASE p WHEN 0 THEN i WHEN 1 THEN (i + 1) % n WHEN 2 THEN n + (i + 1) % n ELSE n + i END, 2
    FROM corner, (VALUES (0), (1), (2), (3)) q(p)),
ring_edges AS (
  SELECT *, coalesce(lead(vid) OVER (PARTITION BY id, face ORDER BY pos), first_value(vid) OVER (PARTITION BY id, face ORDER BY pos)) AS nxt FROM faces),
directed AS (
  SELECT id, vid AS src, nxt AS dst FROM ring_edges UNION SELECT id, nxt, vid FROM ring_edges),
nodes AS (
  SELECT id, vid, row_number() OVER (PARTITION BY id ORDER BY vid) - 1 AS node FROM (SELECT DISTINCT id, src AS vid FROM directed))
"""


def sql(body: str, *more: str) -> str:
    """A query over the mesh tables, with further common tables."""
    return "WITH " + ",\n".join([SQL.strip(), *(m.strip() for m in more)]) + "\n" + body


#: The corners ``pts`` (id, face, pos, vid, x, y, z) in the planes of their faces: ``flat`` has them with ``surface_type``, ``meant`` the corners' means by node.
#: Eigenvalues are the roots of the characteristic polynomial; what is left of the matrix without the larger ones has the wanted direction in its columns.
PLANES = """
cen AS (SELECT id, face, count(*) AS k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY id, face),
middle AS (SELECT id, sum(cx * k) / sum(k) AS mx, sum(cy * k) / sum(k) AS my, sum(cz * k) / sum(k) AS mz FROM cen GROUP BY id),
spread AS (
  SELECT p.id, p.face, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, sum((x - cx) * (x - cx)) AS xx, sum((x - cx) * (y - cy)) AS xy,
    sum((x - cx) * (z - cz)) AS xz, sum((y - cy) * (y - cy)) AS yy, sum((y - cy) * (z - cz)) AS yz, sum((z - cz) * (z - cz)) AS zz
  FROM pts p JOIN cen c ON c.id = p.id AND c.face = p.face GROUP BY p.id, p.face),
shape AS (SELECT *, (xx + yy + zz) / 3 AS q FROM spread),
size AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM shape),
turn AS (
  SELECT *, CASE WHEN s <= 0.000001 * q THEN 0 ELSE acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * s * s * s)))) / 3 END AS phi
  FROM size),
roots AS (SELECT *, q + 2 * s * cos(phi) AS l3, q + 2 * s * cos(phi + 2 * pi() / 3) AS l1 FROM turn),
three AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM roots),
kinds AS (SELECT *, l2 - l1 <= 0.000001 * l3 AS tie, s <= 0.000001 * q AS ball FROM three),
rest AS (
  SELECT *, CASE WHEN ball THEN 1 WHEN tie THEN l3 - xx ELSE (xx - l2) * (xx - l3) + xy * xy + xz * xz END AS mxx, CASE WHEN ball THEN 0 WHEN tie THEN -xy ELSE (xx - l2) * xy + xy * (yy - l3) + xz * yz END AS mxy,
    CASE WHEN ball THEN 0 WHEN tie THEN -xz ELSE (xx - l2) * xz + xy * yz + xz * (zz - l3) END AS mxz, CASE WHEN ball THEN 1 WHEN tie THEN l3 - yy ELSE xy * xy + (yy - l2) * (yy - l3) + yz * yz END AS myy,
    CASE WHEN ball THEN 0 WHEN tie THEN -yz ELSE xy * xz + (yy - l2) * yz + yz * (zz - l3) END AS myz, CASE WHEN ball THEN 1 WHEN tie THEN l3 - zz ELSE xz * xz + yz * yz + (zz - l2) * (zz - l3) END AS mzz
  FROM kinds),
chosen AS (
  SELECT *, CASE WHEN tie THEN CASE WHEN mzz > 0.000000001 * (mxx + myy + mzz) THEN 'z' WHEN myy > 0.000000001 * (mxx + myy + mzz) THEN 'y' ELSE 'x' END
    WHEN mzz >= greatest(mxx, myy) THEN 'z' WHEN myy >= mxx THEN 'y' ELSE 'x' END AS col FROM rest),
direction AS (
  SELECT *, CASE col WHEN 'z' THEN mxz WHEN 'y' THEN mxy ELSE mxx END AS dx, CASE col WHEN 'z' THEN myz WHEN 'y' THEN myy ELSE mxy END AS dy,
    CASE col WHEN 'z' THEN mzz WHEN 'y' THEN myz ELSE mxz END AS dz FROM chosen),
unit AS (
  SELECT d.id, d.face, cx, cy, cz, dx / sqrt(dx * dx + dy * dy + dz * dz) AS ux, dy / sqrt(dx * dx + dy * dy + dz * dz) AS uy, dz / sqrt(dx * dx + dy * dy + dz * dz) AS uz,
    mx, my, mz FROM direction d JOIN middle m ON m.id = d.id),
sided AS (SELECT *, ux * (cx - mx) + uy * (cy - my) + uz * (cz - mz) AS side FROM unit),
facing AS (
  SELECT *, CASE WHEN abs(side) > 0.000000001 THEN sign(side) WHEN abs(uz) > 0.000000001 THEN sign(uz) WHEN abs(uy) > 0.000000001 THEN sign(uy) ELSE sign(ux) END AS o FROM sided),
outer_ AS (SELECT id, face, cx, cy, cz, ux * o AS ux, uy * o AS uy, uz * o AS uz FROM facing),
snapped AS (
  SELECT id, face, cx, cy, cz, CASE WHEN abs(uz) < 0.1 OR uz <= 0 AND uz >= -0.9 THEN 'WallSurface' WHEN uz > 0 THEN 'RoofSurface' ELSE 'GroundSurface' END AS surface_type,
    CASE WHEN abs(uz) > 0.9 THEN 0 WHEN abs(uz) < 0.1 THEN ux / sqrt(ux * ux + uy * uy) ELSE ux END AS nx,
    CASE WHEN abs(uz) > 0.9 THEN 0 WHEN abs(uz) < 0.1 THEN uy / sqrt(ux * ux + uy * uy) ELSE uy END AS ny,
    CASE WHEN abs(uz) > 0.9 THEN sign(uz) WHEN abs(uz) < 0.1 THEN 0 ELSE uz END AS nz FROM outer_),
away AS (SELECT p.*, surface_type, nx, ny, nz, (x - cx) * nx + (y - cy) * ny + (z - cz) * nz AS a FROM pts p JOIN snapped s ON s.id = p.id AND s.face = p.face),
flat AS (SELECT id, face, pos, vid, surface_type, x - a * nx AS x, y - a * ny AS y, z - a * nz AS z FROM away),
meant AS (SELECT id, vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM flat GROUP BY id, vid)
"""
#: Corners of the prisms' own faces.
CORNERS = "pts AS (SELECT f.id, f.face, f.pos, f.vid, v.x, v.y, v.z FROM faces f JOIN vertices v ON v.id = f.id AND v.vid = f.vid)"
