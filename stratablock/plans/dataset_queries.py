"""Alignment, split, batch, sampling, file-job and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays, documents, times
from ..operators import dataset, export, graph, mesh, planes, rewrite
from ..sources import cityjson, sinks
from . import synthetic as syn
from .registry import query


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Buildings of the detailed level, and those that have a block too."""
    part = syn.table(spark, sf_dir, "part")
    detailed = part.select(F.col("p_partkey").alias("obj"), F.col("p_size").alias("size"), "p_brand")
    simple = part.filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("obj"), (F.col("p_size") * 2).alias("size"), "p_brand")
    return detailed, simple


@query("lod_intersection", "SELECT p_partkey AS obj FROM part WHERE p_partkey % 10 <> 0")
def lod_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.common_ids(list(_ids(spark, sf_dir)))


@query("lod_pairs", "SELECT p_partkey AS obj, p_size AS size_detailed, p_size * 2 AS size_block FROM part WHERE p_partkey % 10 <> 0")
def lod_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = dataset.aligned(list(_ids(spark, sf_dir)))
    return both.select("obj", F.col("lod_0.size").alias("size_detailed"), F.col("lod_1.size").alias("size_block"))


@query("paired_files_semi", "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def paired_files_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for files, line items for the counterparts' paths."""
    files = syn.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("rel_path"))
    others = syn.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rel_path"))
    return dataset.paired_files(files, others).drop("rel_path")


@query(
    "common_objects_last_pair",
    """SELECT user_id AS obj, max(event_id) AS rel_path FROM events WHERE event_type IN (SELECT event_type FROM events) AND user_id IN (
    SELECT user_id FROM events WHERE event_id % 2 = 0) AND event_id % 2 = 1 GROUP BY user_id""",
)
def common_objects_last_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one folder that another folder has too; the last pair of files wins."""
    events = syn.table(spark, sf_dir, "events").select(F.col("user_id").alias("obj"), F.col("event_id").alias("rel_path"))
    one, two = events.filter("rel_path % 2 = 1"), events.filter("rel_path % 2 = 0")
    return dataset.last_wins(one.join(session.shuffled(two.select("obj")), "obj", "left_semi"), "obj", "rel_path")


#: Two folders of files with ten buildings each: the simple ones lack every fourth file and every third building, and have
#: buildings of the next file; some buildings are in every file.
_FOLDERS = """
WITH one AS (SELECT p_partkey // 10 AS g, 'b' || p_partkey AS obj FROM part UNION SELECT p_partkey // 10, 'shared' || p_partkey % 3 FROM part),
two AS (
  SELECT p_partkey // 10 AS g, 'b' || p_partkey AS obj FROM part WHERE p_partkey % 3 <> 0 AND p_partkey // 10 % 4 <> 3
  UNION SELECT p_partkey // 10, 'b' || (p_partkey + 10) FROM part WHERE p_partkey // 10 % 4 <> 3 UNION SELECT p_partkey // 10, 'shared' || p_partkey % 2 FROM part WHERE p_partkey // 10 % 4 <> 3)
"""


@query("pair_objects", _FOLDERS + "SELECT obj, max(lpad(one.g::VARCHAR, 9, '0') || '.json') AS rel_path FROM one JOIN two USING (g, obj) GROUP BY obj")
def pair_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that both files of a pair have, from documents as text."""
    k = F.col("p_partkey")
    part = syn.table(spark, sf_dir, "part").select(k, F.floor(k / 10).alias("g"))

    def folder(*ids: Column) -> DataFrame:
        names = part.select("g", F.explode(F.array(*ids)).alias("id")).dropna().distinct()
        member = F.concat(F.lit('"'), F.col("id"), F.lit('":{"type":"Building"}'))
        text = F.concat(F.lit('{"vertices":[],"CityObjects":{'), F.concat_ws(",", F.collect_list(member)), F.lit("}}"))
        rows = names.groupBy("g").agg(text.alias("value"))
        return cityjson.parse(rows.select(F.concat(F.lpad(F.col("g").cast("string"), 9, "0"), F.lit(".json")).alias("file"), "value")).withColumnRenamed("file", "rel_path")

    there = F.col("g") % 4 != 3
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    simple = folder(F.when(there & (k % 3 != 0), name("b", k)), F.when(there, name("b", k + 10)), F.when(there, name("shared", k % 2)))
    return dataset.pair_objects(folder(name("b", k), name("shared", k % 3)), simple)


@query("last_wins_dedup", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = syn.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return dataset.last_wins(events, "user_id", F.struct("ts", "event_id")).drop("ts")


def _shuffled(key: str, table: str, seed: str) -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY md5('{seed}:' || {key}::VARCHAR), {key}) - 1 AS r, count(*) OVER () AS n FROM {table}"


@query(
    "exact_split",
    f"""SELECT doc_id, CASE WHEN r < floor(0.8::DOUBLE * n) THEN 'train' WHEN r < floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS part
    FROM ({_shuffled("doc_id", "documents", "42")})""",
)
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.exact_split(syn.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("batch_assign", f"SELECT doc_id, r // 32 AS batch, r % 32 AS place FROM ({_shuffled('doc_id', 'documents', '42:0')})")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.assign_batches(syn.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


@query("epoch_shuffle", f"SELECT p_partkey, r // 64 AS batch, r % 64 AS place FROM ({_shuffled('p_partkey', 'part', '42:7')})")
def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a later epoch."""
    return dataset.assign_batches(syn.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 64, epoch=7)


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 30")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.seeded_sample(syn.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 30)


@query("sampled_keys_by_file", """
SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS keys
FROM (SELECT source, doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 30) GROUP BY source""")  # fmt: skip
def sampled_keys_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = dataset.seeded_sample(syn.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 30)
    grouped = dataset.group_keys(chosen, "source", "doc_id")
    return grouped.select("source", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("sorted_ids", "SELECT c_custkey FROM customer")
def sorted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey")


@query("top_k_checkpoints", """
SELECT event_id, value, 'best' AS kept FROM (SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 3)
UNION ALL SELECT event_id, value, 'last' FROM (SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 1)""")  # fmt: skip
def top_k_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.top_checkpoints(syn.table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")


@query("early_stop", """
WITH m AS (
  SELECT user_id, event_id, value AS v, row_number() OVER w AS n, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, max(CASE WHEN best IS NULL OR v < best THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM m)
SELECT user_id, min(CASE WHEN n - last >= 3 THEN event_id END) AS stopped_at FROM k GROUP BY user_id""")  # fmt: skip
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = syn.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return dataset.early_stop(events, "value", "event_id", ["user_id"], patience=3)


@query("learning_rates", """
SELECT e AS epoch, round(0.000001 + (0.001 - 0.000001) * (1 + cos(pi() * e / 100)) / 2, 9) AS cosine, round(0.001 * pow(0.5, e // 50), 9) AS step
FROM (SELECT unnest(range(0, 101)) AS e)""")  # fmt: skip
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = spark.range(101).withColumnRenamed("id", "epoch")
    cosine = dataset.learning_rate(epochs, "cosine").select("epoch", F.round("lr", 9).alias("cosine"))
    return cosine.join(dataset.learning_rate(epochs, "step").select("epoch", F.round("lr", 9).alias("step")), "epoch")


@query("vertex_offsets", """
SELECT id, n, coalesce(sum(n) OVER (PARTITION BY id // 10 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE 8 END AS n FROM part)""")  # fmt: skip
def vertex_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets of ten buildings at a time."""
    sizes = syn.buildings(spark, sf_dir).select("id", (F.col("n") * 2).alias("n"), F.floor(F.col("id") / 10).alias("g"))
    return export.vertex_offsets(sizes, "id", ["g"]).drop("g")


def _tens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and boundaries of each building, ten buildings to a document."""
    points = syn.vertices(spark, sf_dir).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])).alias("vertices"))
    faces = syn.rings(spark, sf_dir).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("face", "vids"))), lambda f: F.array(f["vids"])).alias("boundaries"))
    return points.join(session.shuffled(faces), "file").select(F.floor(F.col("file") / 10).alias("g"), F.col("file").alias("id"), F.col("file").cast("string").alias("name"), "vertices", "boundaries")


@query("merge_documents", syn.sql("""
SELECT id // 10 AS g, count(*) AS n_vertices, sum(x + y + z) AS total, max(vid + o) AS top, count(DISTINCT id) AS objects
FROM vertices JOIN (
  SELECT id AS k, coalesce(sum(2 * n) OVER (PARTITION BY id // 10 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM b) ON k = id
GROUP BY id // 10"""))  # fmt: skip
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = export.merge(_tens(spark, sf_dir), ["g"], "id")
    total = F.aggregate(F.flatten("vertices"), F.lit(0.0), lambda a, v: a + v)
    ids = F.flatten(F.flatten(F.flatten(F.map_values("objects"))))
    return whole.select("g", F.size("vertices").cast("long").alias("n_vertices"), total.alias("total"), F.array_max(ids).cast("long").alias("top"), F.size("objects").cast("long").alias("objects"))


@query("combined_documents", syn.sql("""
SELECT id // 10 AS g, 'all_buildings.city.json' AS file_name, 'CityJSON' AS type, '1' AS lod, count(*) AS n_vertices, count(DISTINCT id) AS objects,
  sum((SELECT count(DISTINCT face) FROM faces f WHERE f.id = v.id) / (2.0::DOUBLE * (SELECT n FROM b WHERE b.id = v.id)))::BIGINT AS faces
FROM vertices v GROUP BY id // 10"""))  # fmt: skip
def combined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten buildings written to one document, which is read back."""
    parts = session.settled(_tens(spark, sf_dir))  # buildings and documents are each read several times, and made once
    values = parts.select("g", "name", F.transform("boundaries", lambda f, k: F.least(k, F.lit(2))).alias("surface_values"))
    written = session.settled(export.combined(export.merge(parts, ["g"], "id"), values, ["g"]))
    docs = cityjson.parse(written.select("g", "file_name", F.col("json").alias("value"), F.col("g").cast("string").alias("file"))).join(session.shuffled(written.select("g", "file_name", F.col("g").cast("string").alias("file"), F.get_json_object("json", "$.metadata.datasetLod").alias("lod"))), "file")
    flat = mesh.geometries(mesh.objects(docs)).groupBy("file").agg(F.count("*").alias("objects"), F.sum(F.size(F.flatten("boundaries"))).alias("faces"))
    return docs.join(session.shuffled(flat), "file").select("g", "file_name", "type", "lod", F.size("vertices").cast("long").alias("n_vertices"), "objects", "faces")


@query("building_file_names", "SELECT p_partkey AS id, 'building_' || lpad((row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR, 4, '0') || '.city.json' AS file_name FROM part")
def building_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.file_names(syn.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id")


#: Members of made-up documents that no schema names.
_UNKNOWN = '"extra":{"k":[1,2.5,null],"s":"é\\"x"},'


def _city_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prisms as files: rel_path and content. Of ten, one is no JSON, one no city document, one is broken, and one has a vertex too few."""
    points = syn.vertices(spark, sf_dir).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])).alias("points"))
    faces = syn.rings(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("face", "vids", "surface"))).alias("f"))
    k = F.col("file")
    surfaces = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(n).alias("slope")) for n, t in enumerate(syn.SURFACES)))
    semantics = F.when(k % 6 != 5, F.concat(F.lit(',"semantics":{"surfaces":'), F.to_json(surfaces), F.lit(',"values":['), F.to_json(F.transform("f", lambda f: f["surface"])), F.lit("]}"))).otherwise("")
    solid = F.concat(F.lit('{"type":"Solid","lod":"2","boundaries":['), F.to_json(F.transform("f", lambda f: F.array(f["vids"]))), F.lit("]"), semantics, F.lit("}"))
    vertices = F.to_json(F.when(k % 10 == 4, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points")))
    text = F.concat(
        F.lit(f'{{"type":"CityJSON",{_UNKNOWN}"CityObjects":{{"b'), k.cast("string"), F.lit('":{"type":"Building","attributes":{"floors":'), (k % 7).cast("string"), F.lit('},"geometry":['),
        solid, F.lit(',{"type":"MultiPoint","boundaries":[0]}]}},"vertices":'), vertices, F.lit(',"metadata":{"title":"t","datasetLod":"2"}}'),
    )
    body = F.when(k % 10 == 1, F.lit("notes")).when(k % 10 == 2, F.lit('{"type":"Feature"}')).when(k % 10 == 3, F.lit("{")).otherwise(text)
    name = F.concat(F.lit("part/"), k.cast("string"), F.when(k % 10 == 1, ".txt").otherwise(".City.JSON"))
    rows = points.join(session.shuffled(faces), "file").select(k.alias("id"), name.alias("rel_path"), F.encode(body, "UTF-8").alias("content"))
    return rows.groupBy("id", "rel_path").agg(F.first("content").alias("content"))  # a row each: texts are made once, not wherever they are read


_STATUS = """
status AS (
  SELECT id, n, h, z0, CASE WHEN id % 10 IN (1, 2) THEN 'copied' WHEN id % 10 = 3 OR id % 10 = 4 AND id % 6 <> 5 THEN 'error' ELSE 'converted' END AS status FROM b)
"""


@query("file_job_status", syn.sql("SELECT status, count(*) AS files FROM status GROUP BY status", _STATUS))
def file_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of files, from the job's own rows."""
    return sinks.summary(rewrite.converted_files(_city_files(spark, sf_dir).select("rel_path", "content")))


@query("converted_documents", syn.sql("""
SELECT s.id, status, CASE WHEN status = 'converted' THEN CASE WHEN id % 6 = 5 THEN '2' ELSE '1' END END AS lod,
  CASE WHEN status = 'converted' THEN CASE WHEN id % 6 = 5 THEN 2 * n - (id % 10 = 4)::INT ELSE 3 * n END END AS n_vertices,
  CASE WHEN status = 'converted' THEN 2 + n END AS n_faces,
  CASE WHEN status = 'converted' AND id % 6 <> 5 THEN (SELECT median(z) FROM vertices v WHERE v.id = s.id AND v.vid >= s.n) END AS top,
  CASE WHEN status = 'converted' THEN (id % 7)::VARCHAR END AS floors, CASE WHEN status = 'converted' THEN '[1,2.5,null]' END AS unknown, CASE WHEN status = 'converted' THEN 'é"x' END AS words,
  CASE WHEN status = 'converted' AND id % 6 <> 5 THEN '0,1,2' END AS slopes, CASE WHEN status = 'converted' THEN 't1' END AS metadata, CASE WHEN status = 'converted' THEN '{"boundaries":[0],"type":"MultiPoint"}' END AS other
FROM status s""", _STATUS))  # fmt: skip
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files converted to blocks and read again: what was made, and what must have survived."""
    done = rewrite.converted_files(_city_files(spark, sf_dir).select("rel_path", "content"))
    done = done.withColumn("id", F.regexp_extract("rel_path", r"^part/(\d+)\.", 1).cast("long"))
    v = F.when(F.col("status") == "converted", F.parse_json(F.decode("body", "UTF-8")))
    building = F.concat(F.lit("$.CityObjects.b"), F.col("id").cast("string"))
    at = lambda path, kind="string": F.try_variant_get("v", F.concat(building, F.lit(path)), kind)
    faces = F.flatten(at(".geometry[0].boundaries", "array<array<variant>>"))
    points = F.try_variant_get("v", "$.vertices", "array<array<double>>")
    block = at(".geometry[0].lod") == "1"
    return done.withColumn("v", v).select(
        "id", "status", at(".geometry[0].lod").alias("lod"), F.size(points).alias("n_vertices"), F.size(faces).alias("n_faces"), F.when(block, F.element_at(points, -1)[2]).alias("top"),
        at(".attributes.floors").alias("floors"), F.to_json(F.try_variant_get("v", "$.extra.k", "variant")).alias("unknown"), F.try_variant_get("v", "$.extra.s", "string").alias("words"),
        F.when(block, F.array_join(at(".geometry[0].semantics.surfaces", "array<struct<slope:string>>")["slope"], ",")).alias("slopes"),
        F.concat(F.try_variant_get("v", "$.metadata.title", "string"), F.try_variant_get("v", "$.metadata.datasetLod", "string")).alias("metadata"),
        F.to_json(at(".geometry[1]", "variant")).alias("other"),
    )


@query("merged_nestings", syn.sql("""
SELECT g, string_agg(objects, ';' ORDER BY id) AS objects, sum(n)::BIGINT AS n_vertices FROM (
  SELECT id, id // 10 AS g, 2 * n AS n,
    id || '=' || CASE id % 4 WHEN 0 THEN o::VARCHAR WHEN 1 THEN '[' || o || ',' || (o + 1) || ']' WHEN 2 THEN '[[[' || o || ',[' || (o + 2) || ']]],[]]' ELSE '[[[[' || o || ',' || (o + 1) || ',' || (o + 2) || ']]]]' END AS objects
  FROM (SELECT id, n, coalesce(sum(2 * n) OVER (PARTITION BY id // 10 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM b)) GROUP BY g"""))  # fmt: skip
def merged_nestings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents to one, whose boundaries differ in depth: a number, a list, uneven lists, a solid's."""
    points = syn.vertices(spark, sf_dir).groupBy("file").agg(F.collect_list(F.array("x", "y", "z")).alias("p"))
    k = F.col("file")
    nested = F.when(k % 4 == 0, "0").when(k % 4 == 1, "[0,1]").when(k % 4 == 2, "[[[0,[2]]],[]]").otherwise("[[[[0,1,2]]]]")
    name = F.lpad(k.cast("string"), 12, "0")
    text = F.concat(F.lit('{"CityObjects":{"'), name, F.lit('":{"type":"T","geometry":[{"type":"X","boundaries":'), nested, F.lit('}]}},"vertices":'), F.to_json("p"), F.lit("}"))
    whole = rewrite.merged(points.select(F.floor(k / 10).alias("g"), k.alias("id"), text.alias("value")), ["g"], "id").withColumn("v", F.parse_json("json"))
    objects = F.map_entries(documents.as_object(F.col("v"), "$.CityObjects"))
    shown = lambda e: F.concat(e["key"].cast("long").cast("string"), F.lit("="), F.to_json(F.try_variant_get(e["value"], "$.geometry[0].boundaries", "variant")))
    return whole.select("g", F.array_join(F.transform(objects, shown), ";").alias("objects"), F.size(F.try_variant_get("v", "$.vertices", "array<variant>")).cast("long").alias("n_vertices"))


@query("path_names", r"""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '^(.*)/', 1), '[/\\ ]', '_', 'g') AS safe_parent,
  lower(url) LIKE '%.html' AS is_html FROM pages""")  # fmt: skip
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last part, parent with safe characters, and a suffix test whatever its case."""
    url = F.col("url")
    parent = arrays.safe_name(F.regexp_extract(url, "^(.*)/", 1))
    return syn.table(spark, sf_dir, "pages").select(
        "page_id", F.substring_index(url, "/", -1).alias("name"), parent.alias("safe_parent"), F.lower(url).endswith(".html").alias("is_html")
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.dealt(syn.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file")), "file")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON text; an id that comes twice keeps its last value."""
    k = F.col("file")
    geom = '[{"type":"Solid","lod":"2","boundaries":[[[[0,1,2]]]],"semantics":{"surfaces":[{"type":"GroundSurface"}],"values":[[0]]}}]'
    text = F.concat(
        F.lit('{"type":"CityJSON","vertices":[[0,0,0],[1,0,0],[1,1,0]],"CityObjects":{"b'), k, F.lit('":{"type":"Old"},"x'), k,
        F.lit(f'":{{"geometry":{geom}}},"b'), k, F.lit(f'":{{"type":"Building","geometry":{geom}}}}}}}'),
    )
    return cityjson.parse(_files(spark, sf_dir).select("file", text.alias("value")))


@query("document_objects", """
SELECT p_partkey::VARCHAR AS file, pos AS obj_pos, prefix || p_partkey AS obj, kind AS type, 0 AS surface, 3 AS n
FROM part, (VALUES (0, 'b', 'Building'), (1, 'x', 'Unknown')) v(pos, prefix, kind)""")
def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back to mesh rows."""
    rows = mesh.rings(mesh.geometries(mesh.objects(_documents(spark, sf_dir))))
    return rows.select("file", "obj_pos", "obj", "type", "surface", F.size("vids").alias("n"))


@query("first_objects", "SELECT p_partkey::VARCHAR AS file, 'b' || p_partkey AS obj, 'Building' AS type FROM part")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.first_object(mesh.objects(_documents(spark, sf_dir))).select("file", "obj", "type")


def _sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an object of no geometry, one of empty surfaces only, a point, and two shells of three faces with too few semantic values."""
    k = F.col("file")
    solid = '{"type":"Solid","boundaries":[[[[0,1,2]],[[1,2,0]],[]],[[[2,1,0]]]],"semantics":{"surfaces":[{"type":"GroundSurface"},{"type":"RoofSurface"}],"values":[[1]]}}'
    text = F.concat(
        F.lit('{"type":"CityJSON","vertices":[[0,0,0],[1,0,0],[1,1,0]],"CityObjects":{"none'), k, F.lit('":{"type":"A"},"empty'), k,
        F.lit('":{"geometry":[{"type":"MultiSurface","boundaries":[[],[]]}]},"point'), k, F.lit('":{"geometry":[{"type":"MultiPoint","boundaries":[0]}]},"solid'), k,
        F.lit(f'":{{"geometry":[{solid}]}}}}}}'),
    )
    return cityjson.parse(_files(spark, sf_dir).select("file", text.alias("value")))


@query("dropped_objects", "SELECT p_partkey::VARCHAR AS file, 'solid' || p_partkey AS obj, 3 AS nodes, 6 AS edges FROM part")
def dropped_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without an active vertex give no graph; empty surfaces no edge."""
    directed = graph.directed_edges(mesh.rings(mesh.geometries(mesh.objects(_sparse_documents(spark, sf_dir)))))
    counts = directed.groupBy("file", "obj").agg(F.count("*").cast("int").alias("edges"))
    return graph.sizes(graph.nodes(directed)).join(session.shuffled(counts), ["file", "obj"]).select("file", "obj", F.col("n_nodes").cast("int").alias("nodes"), "edges")


@query("guarded_semantics", """
SELECT p_partkey::VARCHAR AS file, shell, face, kind FROM part, (VALUES (0, 0, 'RoofSurface'), (0, 1, NULL), (1, 0, NULL)) v(shell, face, kind)""")  # fmt: skip
def guarded_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces and shells past the end of the semantic values have no surface type."""
    rows = mesh.rings(mesh.geometries(mesh.objects(_sparse_documents(spark, sf_dir))))
    return rows.select("file", "shell", "face", mesh.kind(F.col("surfaces"), F.col("surface")).alias("kind"))


@query("run_stamps", """
SELECT user_id, strftime(min(ts), '%Y%m%d_%H%M%S') AS started, round(epoch(max(ts) - min(ts)), 3) AS seconds, printf('%.2f seconds', epoch(max(ts) - min(ts))) AS taken FROM events GROUP BY user_id""")
def run_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events stand for a run: its name, and how long it took."""
    runs = syn.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = times.elapsed(F.col("a"), F.col("b"))
    return runs.select("user_id", times.stamp(F.col("a")).alias("started"), times.rounded(seconds, 3).alias("seconds"), times.elapsed_text(seconds).alias("taken"))


@query("face_scatter_matrix", syn.sql("""
SELECT p.id, p.face, round(cx, 6) + 0 AS cx, round(cy, 6) + 0 AS cy, round(cz, 6) + 0 AS cz, round(sum((x - cx) * (x - cx)), 4) AS sxx, round(sum((x - cx) * (y - cy)), 4) AS sxy, round(sum((x - cx) * (z - cz)), 4) AS sxz,
  round(sum((y - cy) * (y - cy)), 4) AS syy, round(sum((y - cy) * (z - cz)), 4) AS syz, round(sum((z - cz) * (z - cz)), 4) AS szz
FROM faces p JOIN vertices v ON v.id = p.id AND v.vid = p.vid JOIN (
  SELECT f.id, f.face, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM faces f JOIN vertices v ON v.id = f.id AND v.vid = f.vid
  GROUP BY f.id, f.face) c ON c.id = p.id AND c.face = p.face
GROUP BY p.id, p.face, cx, cy, cz"""))  # fmt: skip
def face_scatter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planes.scatter(_corners(spark, sf_dir), ["id", "face"])
    # + 0.0 turns a negative zero to zero
    return out.select("id", "face", *((F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cy", "cz")), *((F.round(c, 4) + 0.0).alias(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")))


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = syn.vertices(spark, sf_dir).select(F.col("file").alias("id"), F.col("vid").alias("node"), "x", "y", "z")
    faces = syn.rings(spark, sf_dir).select(F.col("obj").alias("id"), "face", F.col("vids").alias("cycle"))
    return planes.corners(faces, nodes)


@query("mean_projection", syn.sql("""
SELECT v.id, v.vid AS node, round(avg(CASE WHEN f.face = 0 OR f.face = 1 THEN v.x ELSE v.x + f.face END), 6) AS x, round(avg(v.y), 6) AS y, round(avg(v.z - f.pos), 6) AS z
FROM vertices v JOIN faces f ON f.id = v.id AND f.vid = v.vid GROUP BY v.id, v.vid"""))  # fmt: skip
def mean_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners moved by a rule in place of a plane."""
    moved = _corners(spark, sf_dir).withColumn("x", F.when(F.col("face") < 2, F.col("x")).otherwise(F.col("x") + F.col("face"))).withColumn("z", F.col("z") - F.col("pos"))
    nodes = syn.vertices(spark, sf_dir).select(F.col("file").alias("id"), F.col("vid").alias("node"), "x", "y", "z")
    return planes.mean_projection(nodes, moved).select("id", "node", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("straighten_faces", syn.sql("""
SELECT id, face, surface_type, pos, vid AS node, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z FROM flat""", syn.CORNERS, syn.PLANES))  # fmt: skip
def straighten_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planes.straighten_faces(_corners(spark, sf_dir), ["id", "face"])
    return out.select("id", "face", "surface_type", "pos", "node", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


@query("regularize", syn.sql("""
SELECT v.id, v.vid AS node, round(coalesce(m.x, v.x), 6) + 0 AS x, round(coalesce(m.y, v.y), 6) + 0 AS y, round(coalesce(m.z, v.z), 6) + 0 AS z
FROM vertices v LEFT JOIN meant m ON m.id = v.id AND m.vid = v.vid""", syn.CORNERS, syn.PLANES))  # fmt: skip
def regularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = syn.vertices(spark, sf_dir).select(F.col("file").alias("id"), F.col("vid").alias("node"), "x", "y", "z")
    faces = syn.rings(spark, sf_dir).select(F.col("obj").alias("id"), "face", F.col("vids").alias("cycle"))
    return planes.regularize(nodes, faces)[0].select("id", "node", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))
