"""Mesh, graph and block queries over the synthetic buildings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays
from ..operators import dataset, graph, lod1, mesh, rings
from . import synthetic as syn
from .registry import query

AREA = """
areas AS (
  SELECT e.id, e.face, sum(a.x * c.y - c.x * a.y) / 2 AS area
  FROM ring_edges e JOIN vertices a ON a.id = e.id AND a.vid = e.vid JOIN vertices c ON c.id = e.id AND c.vid = e.nxt
  GROUP BY e.id, e.face)
"""


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directed_edges(syn.rings(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_directed(spark, sf_dir))


@query("ring_signed_area", syn.sql("SELECT id, face, area FROM areas", AREA))
def ring_signed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.signed_area(syn.rings(spark, sf_dir), syn.vertices(spark, sf_dir)).select(F.col("obj").alias("id"), "face", "area")


@query(
    "ring_orientation",
    syn.sql(
        """SELECT f.id, f.face, string_agg(f.vid::VARCHAR, ',' ORDER BY CASE WHEN a.area < 0 THEN -f.pos ELSE f.pos END) AS vids
        FROM faces f JOIN areas a ON a.id = f.id AND a.face = f.face GROUP BY f.id, f.face""",
        AREA,
    ),
)
def ring_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = rings.oriented(rings.signed_area(syn.rings(spark, sf_dir), syn.vertices(spark, sf_dir)), True)
    return turned.select(F.col("obj").alias("id"), "face", F.array_join(F.transform("vids", lambda v: v.cast("string")), ",").alias("vids"))


@query("cyclic_ring_edges", syn.sql("SELECT id, face, pos, vid, nxt FROM ring_edges"))
def cyclic_ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.edges(syn.rings(spark, sf_dir)).select(F.col("obj").alias("id"), "face", "pos", "vid", "nxt")


@query("directed_edges", syn.sql("SELECT id, src, dst FROM directed"))
def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directed(spark, sf_dir).select(F.col("obj").alias("id"), "src", "dst")


@query("undirected_edges", syn.sql("SELECT id, src, dst FROM directed WHERE src <= dst"))
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected_edges(_directed(spark, sf_dir)).select(F.col("obj").alias("id"), "src", "dst")


@query("dense_vertex_index", syn.sql("SELECT id, vid, node FROM nodes"))
def dense_vertex_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select(F.col("obj").alias("id"), "vid", "node")


@query(
    "local_edges",
    syn.sql("SELECT d.id, s.node AS src, t.node AS dst FROM directed d JOIN nodes s ON s.id = d.id AND s.vid = d.src JOIN nodes t ON t.id = d.id AND t.vid = d.dst"),
)
def local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _directed(spark, sf_dir)
    return graph.local_edges(edges, graph.nodes(edges)).select(F.col("obj").alias("id"), "src", "dst")


@query("graph_sizes", syn.sql("SELECT id, count(*) AS n_nodes FROM nodes GROUP BY id"))
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(_nodes(spark, sf_dir)).select(F.col("obj").alias("id"), "n_nodes")


@query("n_max", syn.sql("SELECT coalesce(max(n), 0) AS n_max FROM (SELECT count(*) AS n FROM nodes GROUP BY id)"))
def n_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(_nodes(spark, sf_dir)).agg(F.coalesce(F.max("n_nodes"), F.lit(0)).alias("n_max"))


CENTERS = """
ground AS (
  SELECT g.id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz
  FROM (SELECT DISTINCT id, vid FROM faces WHERE kind = 0 AND id % 6 <> 5) g JOIN vertices v ON v.id = g.id AND v.vid = g.vid GROUP BY g.id),
low AS (SELECT id, min(z) AS low FROM nodes JOIN vertices USING (id, vid) GROUP BY id),
near AS (
  SELECT n.id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz
  FROM nodes n JOIN vertices v ON v.id = n.id AND v.vid = n.vid JOIN low ON low.id = n.id WHERE abs(z - low) < 0.1 GROUP BY n.id),
centers AS (
  SELECT n.id, CASE WHEN g.id IS NULL THEN n.cx ELSE g.cx END AS cx, CASE WHEN g.id IS NULL THEN n.cy ELSE g.cy END AS cy,
    CASE WHEN g.id IS NULL THEN n.cz ELSE g.cz END AS cz FROM near n LEFT JOIN ground g ON g.id = n.id)
"""


def _centers(spark: SparkSession, sf_dir: str, with_semantics: bool = True) -> DataFrame:
    faces = syn.rings(spark, sf_dir)
    if not with_semantics:
        faces = faces.withColumn("surfaces", F.lit(None).cast("array<string>"))
    return graph.base_centers(faces, syn.vertices(spark, sf_dir), _nodes(spark, sf_dir))


def _rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("base_center", syn.sql("SELECT id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM centers", CENTERS))
def base_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, sf_dir).select(F.col("obj").alias("id"), *_rounded("cx", "cy", "cz"))


@query("base_center_fallback", syn.sql("SELECT id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM near", CENTERS))
def base_center_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, sf_dir, False).select(F.col("obj").alias("id"), *_rounded("cx", "cy", "cz"))


@query(
    "centered_nodes",
    syn.sql(
        """SELECT n.id, n.node, round(v.x - c.cx, 4) AS x, round(v.y - c.cy, 4) AS y, round(v.z - c.cz, 4) AS z
        FROM nodes n JOIN vertices v ON v.id = n.id AND v.vid = n.vid JOIN centers c ON c.id = n.id""",
        CENTERS,
    ),
)
def centered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = graph.positions(_nodes(spark, sf_dir), syn.vertices(spark, sf_dir), _centers(spark, sf_dir))
    return at.select(F.col("obj").alias("id"), "node", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in "xyz"))


@query(
    "dequantize",
    syn.sql(
        """SELECT id, vid, CASE WHEN id % 2 = 0 THEN x * 0.5 + 10 ELSE x END AS x, CASE WHEN id % 2 = 0 THEN y * 0.5 + 20 ELSE y END AS y,
        CASE WHEN id % 2 = 0 THEN z * 0.25 + 30 ELSE z END AS z FROM vertices"""
    ),
)
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even buildings carry a transform."""
    points = syn.vertices(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("p"))
    scale = F.when(
        F.col("file") % 2 == 0,
        F.struct(F.array(*map(F.lit, (0.5, 0.5, 0.25))).alias("scale"), F.array(*map(F.lit, (10.0, 20.0, 30.0))).alias("translate")),
    )
    docs = points.select("file", scale.alias("transform"), F.transform("p", lambda p: F.array(p["x"], p["y"], p["z"])).alias("vertices"))
    return mesh.vertices(docs).select(F.col("file").alias("id"), "vid", "x", "y", "z")


@query("geometry_dispatch", """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'Solid' WHEN 1 THEN 'MultiSurface' WHEN 2 THEN 'CompositeSurface' END AS geom_type,
  count(*) AS rings, sum(CASE WHEN p_partkey % 4 = 0 THEN 8 ELSE 4 END) AS corners
FROM part, (VALUES (0), (1)) r(face)
WHERE p_partkey % 4 < 3 AND (p_partkey % 4 = 0 OR face = 0)
GROUP BY 1
""".replace("sum(CASE WHEN p_partkey % 4 = 0 THEN 8 ELSE 4 END)", "sum(CASE WHEN p_partkey % 4 = 0 THEN 3 + face ELSE 4 END)"))  # fmt: skip
def geometry_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries as JSON text of three types, and of one that is dropped."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "Solid").when(k % 4 == 1, "MultiSurface").when(k % 4 == 2, "CompositeSurface").otherwise("MultiPoint")
    text = F.when(k % 4 == 0, "[[[[0,1,2]],[[0,1,2,3]]]]").when(k % 4 < 3, "[[[0,1,2,3]]]").otherwise("[0,1]")
    none = F.lit(None).cast("struct<surfaces:array<struct<type:string>>,values:string>")
    geom = F.struct(kind.alias("type"), F.lit("2").alias("lod"), text.alias("boundaries"), none.alias("semantics"))
    objects = syn.table(spark, sf_dir, "part").select(
        k.alias("file"), F.lit(0).alias("obj_pos"), k.cast("string").alias("obj"), F.lit("Building").alias("type"), F.array(geom).alias("geometry")
    )
    found = mesh.rings(mesh.geometries(objects))
    return found.groupBy("geom_type").agg(F.count("*").alias("rings"), F.sum(F.size("vids")).alias("corners"))


@query(
    "last_surface_index",
    """SELECT id, CASE WHEN n > 0 THEN n * 3 - 3 END AS ground, CASE WHEN n > 0 THEN n * 3 - 2 END AS roof,
    CASE WHEN n > 0 AND id % 2 = 0 THEN n * 3 - 1 WHEN n > 0 AND n > 1 THEN n * 3 - 4 ELSE n * 3 - CASE WHEN n > 0 THEN 1 ELSE 0 END END AS wall
    FROM (SELECT p_partkey AS id, p_partkey % 3 AS n FROM part)""",
)
def last_surface_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface lists that repeat; odd buildings lack their last wall entry."""
    k = F.col("p_partkey")
    whole = F.flatten(F.array_repeat(F.array(*map(F.lit, syn.SURFACES)), (k % 3).cast("int")))
    cut = F.when((k % 2 == 1) & (k % 3 > 0), F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole)
    rows = syn.table(spark, sf_dir, "part").select(
        k.alias("file"), F.lit(0).alias("obj_pos"), k.alias("obj"), F.lit(0).alias("geom"), F.lit("Solid").alias("geom_type"), cut.alias("surfaces")
    )
    return lod1.surface_indices(rows).select(F.col("obj").alias("id"), *(F.col(c).cast("long").alias(c) for c in ("ground", "roof", "wall")))


HEIGHTS = """
heights AS (
  SELECT f.id, median(v.z) AS height FROM faces f JOIN vertices v ON v.id = f.id AND v.vid = f.vid WHERE kind = 1 AND f.id % 6 <> 5 GROUP BY f.id)
"""
TURNED = """
turned AS (
  SELECT f.id, CASE WHEN a.area > 0 THEN b.n - 1 - f.pos ELSE f.pos END AS pos, f.vid, b.n
  FROM faces f JOIN areas a ON a.id = f.id AND a.face = f.face JOIN b ON b.id = f.id WHERE f.kind = 0 AND f.id % 6 <> 5),
raised AS (SELECT id, vid, 2 * n + row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS roof_vid, pos, n FROM turned)
"""


def _blocks(spark: SparkSession, sf_dir: str):
    return lod1.convert(syn.geometries(spark, sf_dir), syn.rings(spark, sf_dir), syn.vertices(spark, sf_dir))


@query("lod1_height", syn.sql("SELECT id, height FROM heights", HEIGHTS))
def lod1_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)[2].select(F.col("obj").alias("id"), "height")


@query(
    "lod1_roof_vertices",
    syn.sql("SELECT r.id, r.vid, r.roof_vid, v.x, v.y, h.height AS z FROM raised r JOIN vertices v ON v.id = r.id AND v.vid = r.vid JOIN heights h ON h.id = r.id", AREA, HEIGHTS, TURNED),
)
def lod1_roof_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)[1].select(F.col("obj").alias("id"), "vid", "roof_vid", "x", "y", "z")


BLOCKS = """
sides AS (
  SELECT id, pos, n, vid, roof_vid, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS nxt,
    coalesce(lead(roof_vid) OVER w, first_value(roof_vid) OVER w) AS roof_nxt
  FROM raised WINDOW w AS (PARTITION BY id ORDER BY pos)),
blocks AS (
  SELECT id, 0 AS face, 0 AS surface, string_agg(vid::VARCHAR, ',' ORDER BY pos) AS vids FROM raised GROUP BY id
  UNION ALL SELECT id, 1, 1, string_agg(roof_vid::VARCHAR, ',' ORDER BY pos) FROM raised GROUP BY id
  UNION ALL SELECT id, 2 + pos, 2, vid || ',' || nxt || ',' || roof_nxt || ',' || roof_vid FROM sides)
"""


def _named(faces: DataFrame) -> DataFrame:
    one = F.array_join(F.transform(F.col("rings")[0], lambda v: v.cast("string")), ",")
    return faces.select(F.col("obj").alias("id"), "face", "surface", one.alias("vids"))


@query("lod1_faces", syn.sql("SELECT id, face, surface, vids FROM blocks", AREA, TURNED, BLOCKS))
def lod1_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_blocks(spark, sf_dir)[0])


@query("lod1_walls", syn.sql("SELECT id, face, vids FROM blocks WHERE surface = 2", AREA, TURNED, BLOCKS))
def lod1_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_blocks(spark, sf_dir)[0]).filter("surface = 2").drop("surface")


OUTWARD = """
turned AS (
  SELECT f.id, CASE WHEN a.area < 0 THEN b.n - 1 - f.pos ELSE f.pos END AS pos, f.vid, b.n
  FROM faces f JOIN areas a ON a.id = f.id AND a.face = f.face JOIN b ON b.id = f.id WHERE f.kind = 0 AND f.id % 6 <> 5),
raised AS (SELECT id, vid, 2 * n + row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS roof_vid, pos, n FROM turned)
"""


@query(
    "lod1_faces_outward",
    syn.sql(
        "SELECT id, face, surface, vids FROM blocks",
        AREA,
        OUTWARD,
        BLOCKS.replace("string_agg(roof_vid::VARCHAR, ',' ORDER BY pos)", "string_agg(roof_vid::VARCHAR, ',' ORDER BY -pos)"),
    ),
)
def lod1_faces_outward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other winding: walls and roofs face outward."""
    faces = lod1.convert(syn.geometries(spark, sf_dir), syn.rings(spark, sf_dir), syn.vertices(spark, sf_dir), outer_ccw=True)[0]
    return _named(faces)


@query("lod1_passed", syn.sql("SELECT b.id FROM b WHERE b.id NOT IN (SELECT id FROM heights)", HEIGHTS))
def lod1_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries that are not convertible and pass as they are."""
    converted = _blocks(spark, sf_dir)[2]
    return syn.geometries(spark, sf_dir).join(session.shuffled(converted), lod1.GEOM, "left_anti").select(F.col("obj").alias("id"))


@query(
    "closed_polyline",
    syn.sql("SELECT f.id, f.face, string_agg(f.vid::VARCHAR, ',' ORDER BY f.pos) || ',' || min_by(f.vid, f.pos)::VARCHAR AS trace FROM faces f GROUP BY f.id, f.face"),
)
def closed_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = F.array_join(F.transform(arrays.closed(F.col("vids")), lambda v: v.cast("string")), ",")
    return syn.rings(spark, sf_dir).select(F.col("obj").alias("id"), "face", trace.alias("trace"))


@query(
    "closed_polyline_checked",
    syn.sql("""SELECT f.id, f.face, string_agg(v.x::INT || ' ' || v.y::INT, ',' ORDER BY f.pos) || ',' || min_by(v.x::INT || ' ' || v.y::INT, f.pos) AS trace
      FROM faces f JOIN vertices v ON v.id = f.id AND v.vid = f.vid WHERE f.id % 4 <> 1 OR f.face <> 2 GROUP BY f.id, f.face"""),
)
def closed_polyline_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of coordinates; a ring with an index past the end is skipped, here one in every fourth building."""
    bad = F.when((F.col("obj") % 4 == 1) & (F.col("face") == 2), F.array_append("vids", F.lit(99))).otherwise(F.col("vids"))
    at = rings.located(syn.rings(spark, sf_dir).withColumn("vids", bad), syn.vertices(spark, sf_dir))
    point = lambda p: F.concat_ws(" ", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))
    trace = F.array_join(F.transform(arrays.closed(F.col("points")), point), ",")
    return at.select(F.col("obj").alias("id"), "face", trace.alias("trace"))


@query("uncentered_nodes", syn.sql("SELECT n.id, n.node, v.x, v.y, v.z FROM nodes n JOIN vertices v ON v.id = n.id AND v.vid = n.vid"))
def uncentered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as the document has them."""
    at = graph.positions(_nodes(spark, sf_dir), syn.vertices(spark, sf_dir))
    return at.select(F.col("obj").alias("id"), "node", *(F.col(c).cast("double").alias(c) for c in "xyz"))


@query(
    "transformed_nodes",
    syn.sql("""SELECT id, k AS node, coalesce(x, 0) / 2 AS x, coalesce(y, 0) / 2 AS y, (x IS NULL)::INT AS category FROM (
      SELECT DISTINCT id, unnest(range(0, 10)) AS k FROM nodes) p LEFT JOIN (SELECT n.id AS nid, n.node, v.x, v.y FROM nodes n JOIN vertices v ON v.id = n.id AND v.vid = n.vid) ON nid = id AND node = k"""),
)
def transformed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's transform of padded graphs: half the size."""
    at = graph.positions(_nodes(spark, sf_dir), syn.vertices(spark, sf_dir))
    out = graph.transformed(graph.padded_nodes(at, 10), lambda df: df.withColumns({c: F.col(c) / 2 for c in "xyz"}))
    return out.select(F.col("obj").alias("id"), "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "category")


@query(
    "ring_sequence",
    syn.sql(
        """SELECT id, face, pos, x, y, z, 0.0 AS is_end FROM faces JOIN vertices USING (id, vid)
        UNION ALL SELECT id, face, count(*), 0, 0, 0, 1 FROM faces GROUP BY id, face"""
    ),
)
def ring_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of each ring followed by a separator row."""
    at = rings.located(syn.rings(spark, sf_dir), syn.vertices(spark, sf_dir))
    row = lambda p, end: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), F.lit(end).alias("is_end"))
    stop = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("is_end"))
    tokens = F.concat(F.transform("points", lambda p: row(p, 0.0)), F.array(stop))
    return at.select(F.col("obj").alias("id"), "face", F.posexplode(tokens).alias("pos", "t")).select("id", "face", "pos", "t.*")


@query(
    "object_sequences",
    syn.sql("SELECT id, count(*) + count(DISTINCT face) AS n_tokens, sum(x + y + z) AS total FROM faces JOIN vertices USING (id, vid) GROUP BY id"),
)
def object_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rings of a building as one token sequence."""
    found = graph.sequences(syn.rings(spark, sf_dir), syn.vertices(spark, sf_dir))
    total = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["x"] + t["y"] + t["z"])
    return found.select(F.col("obj").alias("id"), F.size("tokens").cast("long").alias("n_tokens"), total.alias("total"))


@query(
    "pad_nodes",
    syn.sql(
        """SELECT g.id, k.node, coalesce(v.x, 0) AS x, coalesce(v.y, 0) AS y, coalesce(v.z, 0) AS z,
        CASE WHEN v.x IS NULL THEN 1 ELSE 0 END AS category, CASE WHEN v.x IS NULL THEN 0 ELSE 1 END AS mask
        FROM (SELECT DISTINCT id FROM nodes) g, (SELECT unnest(range(0, 10)) AS node) k
        LEFT JOIN nodes n ON n.id = g.id AND n.node = k.node LEFT JOIN vertices v ON v.id = n.id AND v.vid = n.vid"""
    ),
)
def pad_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = graph.positions(_nodes(spark, sf_dir), syn.vertices(spark, sf_dir))
    out = graph.padded_nodes(at, 10)
    return out.select(F.col("obj").alias("id"), "node", *(F.col(c).cast("double").alias(c) for c in "xyz"), "category", "mask")


@query(
    "dense_adjacency",
    syn.sql(
        """SELECT g.id, i.node, string_agg(CASE WHEN d.src IS NULL THEN '0' ELSE '1' END, '' ORDER BY j.node) AS adjacent
        FROM (SELECT DISTINCT id FROM nodes) g, (SELECT unnest(range(0, 10)) AS node) i, (SELECT unnest(range(0, 10)) AS node) j
        LEFT JOIN directed d ON d.id = g.id AND d.src = i.node AND d.dst = j.node GROUP BY g.id, i.node"""
    ),
)
def dense_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.dense_active(_directed(spark, sf_dir), 10)
    return out.select(F.col("obj").alias("id"), "node", F.array_join(F.transform("adjacent", lambda a: a.cast("string")), "").alias("adjacent"))


#: Graphs of one or two levels in batches of 32, padded to ten nodes: what a batch holds, as text.
_BATCHES = """
placed_graph AS (SELECT id, r // 32 AS batch, r % 32 AS place FROM (SELECT id, row_number() OVER (ORDER BY md5('42:0:' || id::VARCHAR), id) - 1 AS r FROM b)),
slots AS (SELECT unnest(range(0, 10)) AS k),
floor_nodes AS (SELECT id, vid, vid AS node FROM nodes WHERE vid < (SELECT n FROM b WHERE b.id = nodes.id)),
floor_edges AS (SELECT id, vid AS src, nxt AS dst FROM ring_edges WHERE face = 0 UNION SELECT id, nxt, vid FROM ring_edges WHERE face = 0)
"""


def _batch_sql(nodes: str, edges: str, name: str, where: str = "TRUE") -> str:
    return f"""
{name}_x AS (SELECT g.id, string_agg(coalesce(v.x::INT || ' ' || v.y::INT || ' ' || v.z::INT, '0 0 0'), ',' ORDER BY k) AS x,
    string_agg(CASE WHEN v.id IS NULL THEN '01' ELSE '10' END, '' ORDER BY k) AS categories, string_agg((v.id IS NOT NULL)::INT::VARCHAR, '' ORDER BY k) AS mask
  FROM placed_graph g CROSS JOIN slots LEFT JOIN {nodes} n ON n.id = g.id AND n.node = k LEFT JOIN vertices v ON v.id = n.id AND v.vid = n.vid WHERE {where} GROUP BY g.id),
{name}_y AS (SELECT g.id, string_agg((e.id IS NOT NULL)::INT::VARCHAR, '' ORDER BY i.k, j.k) AS y
  FROM placed_graph g CROSS JOIN slots i CROSS JOIN slots j LEFT JOIN {edges} e ON e.id = g.id AND e.src = i.k AND e.dst = j.k WHERE {where} GROUP BY g.id),
{name} AS (SELECT batch, string_agg(g.id::VARCHAR, ',' ORDER BY place) AS ids, string_agg(x, ';' ORDER BY place) AS x, string_agg(categories, ';' ORDER BY place) AS categories,
    string_agg(mask, ';' ORDER BY place) AS mask, string_agg(y, ';' ORDER BY place) AS y
  FROM placed_graph g JOIN {name}_x a ON a.id = g.id JOIN {name}_y c ON c.id = g.id GROUP BY batch)
"""


def _shown(b: Callable[[str], Column]) -> dict[str, Column]:
    """A batch's tensors as text: numbers are whole."""
    text = lambda c: c.cast("int").cast("string")
    row = lambda r, sep: F.array_join(F.transform(r, text), sep)
    each = lambda name, one: F.array_join(F.transform(b(name), one), ";")
    return {
        "ids": F.array_join(F.transform(b("ids"), lambda i: i.cast("string")), ","),
        "x": each("x", lambda g: F.array_join(F.transform(g, lambda p: row(p, " ")), ",")),
        "categories": each("node_categories", lambda g: row(F.flatten(g), "")),
        "mask": each("node_mask", lambda g: row(g, "")),
        "y": each("y", lambda g: row(F.flatten(F.flatten(g)), "")),
    }


def _sparse(spark: SparkSession, sf_dir: str, rings_: DataFrame, kind: str) -> DataFrame:
    edges = graph.directed_edges(rings_)
    numbered = graph.nodes(edges)
    at = graph.positions(numbered, syn.vertices(spark, sf_dir))
    return graph.sparse(at, graph.local_edges(edges, numbered)).withColumn("type", F.lit(kind))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.assign_batches(syn.buildings(spark, sf_dir).select(F.col("id").alias("obj")), "obj", 32)


@query("graph_batches", syn.sql("SELECT batch, ids, x, categories, mask, y, 'Building' AS type FROM whole", _BATCHES, _batch_sql("nodes", "directed", "whole")))
def graph_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole graphs in batches."""
    out = graph.collate(_placed(spark, sf_dir), [_sparse(spark, sf_dir, syn.rings(spark, sf_dir), "Building")], 10)
    return out.select("batch", *(c.alias(k) for k, c in _shown(F.col).items()), F.array_join(F.array_distinct("types"), ",").alias("type"))


@query("graph_batches_levels", syn.sql("""
SELECT w.batch, w.ids, w.x, w.categories, w.mask, w.y, f.ids AS ids_1, f.x AS x_1, f.categories AS categories_1, f.mask AS mask_1, f.y AS y_1, 'Building/Floor' AS types
FROM whole w JOIN ground f ON f.batch = w.batch""",
_BATCHES, _batch_sql("nodes", "directed", "whole", "g.id % 7 <> 0"), _batch_sql("floor_nodes", "floor_edges", "ground", "g.id % 7 <> 0")))
def graph_batches_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings and their ground rings as two levels; the second lacks every seventh building."""
    all_rings = syn.rings(spark, sf_dir)
    levels = [_sparse(spark, sf_dir, all_rings, "Building"), _sparse(spark, sf_dir, all_rings.filter("face = 0 and obj % 7 <> 0"), "Floor")]
    out = graph.collate(_placed(spark, sf_dir), levels, 10)
    kinds = F.concat_ws("/", F.array_join(F.array_distinct("lod_0.types"), ","), F.array_join(F.array_distinct("lod_1.types"), ","))
    return out.select(
        "batch", *(c.alias(k) for k, c in _shown(lambda n: F.col("lod_0")[n]).items()), *(c.alias(f"{k}_1") for k, c in _shown(lambda n: F.col("lod_1")[n]).items()), kinds.alias("types")
    )
