"""Reconstruction, noise, posterior, loss and network queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays, random
from ..operators import cycles, dataset, diffusion, export, graph, mesh, network
from ..sources import cityjson
from . import synthetic as syn
from .registry import query

T, S = 500, 0.008
SCHEDULE = f"""
schedule AS (
  SELECT t, pow(cos((t / {float(T)} + {S}) / {1 + S} * pi() / 2), 2) / pow(cos({S} / {1 + S} * pi() / 2), 2) AS ab FROM (SELECT unnest(range(0, {T + 1})) AS t))
"""


def _u(seed: str, *keys: str) -> str:
    """The SQL of ``functions.random.uniform``."""
    text = " || ':' || ".join([f"'{seed}'", *(f"{k}::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _n(seed: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_u(seed + 'a', *keys)}, {1 / (1 << 52)!r}))) * cos(2 * pi() * {_u(seed + 'b', *keys)}))"


#: All pairs of a building's vertices, whether they are joined, and a made-up logit.
PAIRS = """
pairs AS (
  SELECT a.id, a.vid AS i, c.vid AS j, CASE WHEN d.src IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y,
    ((a.id + 3 * a.vid + 5 * c.vid) % 9 - 4) / 2.0::DOUBLE AS logit, (a.id % 499 + 1)::INT AS t
  FROM nodes a JOIN nodes c ON c.id = a.id LEFT JOIN directed d ON d.id = a.id AND d.src = a.vid AND d.dst = c.vid)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = graph.pairs(graph.directed_edges(syn.rings(spark, sf_dir)))
    pairs = every.select(F.col("obj").alias("id"), "i", "j", F.col("joined").cast("double").alias("y"))
    logit = ((F.col("id") + 3 * F.col("i") + 5 * F.col("j")) % 9 - 4) / 2.0
    return pairs.withColumns({"logit": logit, "t": (F.col("id") % 499 + 1).cast("int")})


def _scheduled(rows: DataFrame) -> DataFrame:
    """Rows with their step's alpha_bar and the one before."""
    ratios = diffusion.step_ratios(diffusion.schedule(rows.sparkSession, T, S))
    return rows.join(F.broadcast(ratios), "t")  # T + 1 rows


PROBS = """
probs AS (
  SELECT i.id, i.vid AS src, j.vid AS dst, CASE WHEN d.src IS NULL THEN 0.25 ELSE 0.5 + ((i.vid + j.vid + i.id) % 5) / 8.0 END AS prob
  FROM nodes i JOIN nodes j ON j.id = i.id AND j.vid <> i.vid LEFT JOIN directed d ON d.id = i.id AND d.src = i.vid AND d.dst = j.vid)
"""


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = graph.pairs(graph.directed_edges(syn.rings(spark, sf_dir))).select(F.col("obj").alias("id"), "src", "dst", "joined").filter("src <> dst")
    return every.select("id", "src", "dst", F.when(F.col("joined"), 0.5 + ((F.col("src") + F.col("dst") + F.col("id")) % 5) / 8.0).otherwise(0.25).alias("prob"))


@query("edge_threshold", syn.sql("""
SELECT id, src, dst FROM probs WHERE src < dst AND prob > 0.5 UNION ALL SELECT id, dst, src FROM probs WHERE src < dst AND prob > 0.5""", PROBS))  # fmt: skip
def edge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.threshold_edges(_probs(spark, sf_dir))


#: All simple paths from the smallest node, closed; those with a chord are rejected afterwards.
CYCLES = """
WITH RECURSIVE {mesh},
p AS (
  SELECT id, [src::INT, dst::INT] AS path FROM directed WHERE src < dst
  UNION ALL
  SELECT p.id, list_append(p.path, d.dst::INT) FROM p JOIN directed d ON d.id = p.id AND d.src = p.path[-1]
  WHERE d.dst > p.path[1] AND NOT list_contains(p.path, d.dst::INT) AND len(p.path) < 8),
closed AS (
  SELECT p.id, p.path FROM p JOIN directed d ON d.id = p.id AND d.src = p.path[-1] AND d.dst = p.path[1]
  WHERE len(p.path) >= 3 AND p.path[2] < p.path[-1])
SELECT id, array_to_string(path, ',') AS cycle FROM closed c WHERE NOT EXISTS (
  SELECT 1 FROM directed d WHERE d.id = c.id AND list_contains(c.path, d.src::INT) AND list_contains(c.path, d.dst::INT)
    AND abs(list_position(c.path, d.src::INT) - list_position(c.path, d.dst::INT)) NOT IN (1, len(c.path) - 1))
"""


@query("chordless_cycles", CYCLES.format(mesh=syn.SQL.strip()))
def chordless_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.directed_edges(syn.rings(spark, sf_dir)).select(F.col("obj").alias("id"), "src", "dst")
    return cycles.chordless(edges).select("id", F.array_join(F.transform("cycle", lambda v: v.cast("string")), ",").alias("cycle"))


@query("active_submatrix", syn.sql("""
SELECT p.id, s.new AS src, d.new AS dst, p.prob FROM probs p JOIN active s ON s.id = p.id AND s.vid = p.src JOIN active d ON d.id = p.id AND d.vid = p.dst""",
PROBS, "active AS (SELECT id, vid, row_number() OVER (PARTITION BY id ORDER BY vid) - 1 AS new FROM nodes WHERE (vid + id) % 3 <> 0 AND id % 7 <> 0)"))
def active_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of class 1 go, and graphs with fewer than three others."""
    nodes = graph.nodes(graph.directed_edges(syn.rings(spark, sf_dir)))
    wrong = ((F.col("vid") + F.col("obj")) % 3 == 0) | ((F.col("obj") % 7 == 0) & (F.col("vid") > 1))
    return cycles.active_edges(_probs(spark, sf_dir), nodes.select(F.col("obj").alias("id"), F.col("vid").alias("node"), wrong.cast("int").alias("class")))[1]


@query("cosine_schedule", "WITH " + SCHEDULE + "SELECT t::INT AS t, round(ab, 8) AS alpha_bar FROM schedule")
def cosine_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffusion.schedule(spark, T, S).select("t", F.round("alpha_bar", 8).alias("alpha_bar"))


@query("reverse_coefficients", "WITH " + SCHEDULE + """, s AS (SELECT t, ab, lag(ab) OVER (ORDER BY t) AS p FROM schedule)
SELECT t::INT AS t, round(sqrt(p) * (1 - ab / p) / (1 - ab), 6) AS coef_pred, round(sqrt(ab / p) * (1 - p) / (1 - ab), 6) AS coef_t,
  round(sqrt((1 - p) / (1 - ab) * (1 - ab / p)), 6) AS sigma FROM s WHERE t > 0""")  # fmt: skip
def reverse_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diffusion.reverse_coefficients(diffusion.step_ratios(diffusion.schedule(spark, T, S)))
    return out.select("t", *(F.round(c, 6).alias(c) for c in ("coef_pred", "coef_t", "sigma")))


@query("gaussian_noise_replay", syn.sql(f"""
SELECT id, node, {", ".join(f"round(ab * {c} + sqrt(1 - ab) * (e{c} - m{c}), 5) AS {c}t" for c in "xyz")} FROM (
  SELECT *, {", ".join(f"sum(e{c}) OVER (PARTITION BY id) / (count(*) OVER (PARTITION BY id) + 0.000001) AS m{c}" for c in "xyz")} FROM (
    SELECT n.id, n.node, v.x, v.y, v.z, s.ab, {", ".join(f"{_n('5' + c, 'n.id', 'n.node')} AS e{c}" for c in "xyz")}
    FROM nodes n JOIN vertices v ON v.id = n.id AND v.vid = n.vid JOIN schedule s ON s.t = n.id % 499 + 1))""", SCHEDULE))  # fmt: skip
def gaussian_noise_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes(graph.directed_edges(syn.rings(spark, sf_dir))).join(session.shuffled(syn.vertices(spark, sf_dir)), ["file", "vid"])
    rows = nodes.select(F.col("obj").alias("id"), "node", "x", "y", "z", F.lit(1.0).alias("mask"), (F.col("obj") % 499 + 1).cast("int").alias("t"))
    out = diffusion.coordinate_noise(_scheduled(rows), F.col("alpha_bar"), 5, ["id"])
    return out.select("id", "node", *(F.round(f"{c}t", 5).alias(f"{c}t") for c in "xyz"))


def _edge_noise(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    noisy = diffusion.edge_noise(F.col("y"), F.col("alpha_bar"), kind, 9, F.col("id"), F.col("i"), F.col("j"))
    return _scheduled(_pairs(spark, sf_dir)).select("id", "i", "j", noisy.alias("yt"))


KEYS = ("p.id", "p.i", "p.j")


@query("edge_noise_uniform", syn.sql(f"""
SELECT id, i, j, CASE WHEN {_u("9", *KEYS)} > ab THEN CASE WHEN {_u("9v", *KEYS)} > 0.5 THEN 1.0 ELSE 0.0 END ELSE y END AS yt
FROM pairs p JOIN schedule USING (t)""", SCHEDULE, PAIRS))  # fmt: skip
def edge_noise_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_noise(spark, sf_dir, "uniform")


@query("edge_noise_absorbing", syn.sql(f"SELECT id, i, j, CASE WHEN {_u('9', *KEYS)} > ab THEN 0.5 ELSE y END AS yt FROM pairs p JOIN schedule USING (t)", SCHEDULE, PAIRS))
def edge_noise_absorbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_noise(spark, sf_dir, "absorbing")


@query("edge_noise_gaussian", syn.sql(f"""
SELECT id, i, j, CASE WHEN sqrt(ab) * (2 * y - 1) + sqrt(1 - ab) * {_n("9", *KEYS)} > 0 THEN 1.0 ELSE 0.0 END AS yt FROM pairs p JOIN schedule USING (t)""", SCHEDULE, PAIRS))  # fmt: skip
def edge_noise_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_noise(spark, sf_dir, "discretized_gaussian")


STEP = "s AS (SELECT t, ab, lag(ab) OVER (ORDER BY t) AS prev FROM schedule)"


@query("edge_posterior_uniform", syn.sql("""
SELECT id, i, j, round(o * p1 / (o * p1 + z * (1 - p1) + 0.00000001), 6) AS prob FROM (
  SELECT id, i, j, ab / prev * y + (1 - ab / prev) * 0.5 AS o, ab / prev * (1 - y) + (1 - ab / prev) * 0.5 AS z, 1 / (1 + exp(-logit)) AS p1
  FROM pairs JOIN s USING (t))""", SCHEDULE, PAIRS, STEP))  # fmt: skip
def edge_posterior_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    prob = diffusion.edge_posterior(F.col("logit"), F.col("y"), F.col("alpha_bar"), F.col("alpha_prev"), "uniform")
    return _scheduled(_pairs(spark, sf_dir)).select("id", "i", "j", F.round(prob, 6).alias("prob"))


@query("edge_step_absorbing", syn.sql(f"""
SELECT id, i, j, CASE WHEN yt = 0.5 THEN CASE WHEN {_u("4", *KEYS)} < prev THEN CASE WHEN {_u("4v", *KEYS)} < 1 / (1 + exp(-logit)) THEN 1.0 ELSE 0.0 END ELSE 0.5 END ELSE yt END AS y_prev
FROM (SELECT *, CASE WHEN (i + j) % 2 = 0 THEN 0.5 ELSE y END AS yt FROM pairs) p JOIN s USING (t)""", SCHEDULE, PAIRS, STEP))  # fmt: skip
def edge_step_absorbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    yt = F.when((F.col("i") + F.col("j")) % 2 == 0, 0.5).otherwise(F.col("y"))
    prev = diffusion.edge_step(F.col("logit"), yt, F.col("alpha_bar"), F.col("alpha_prev"), 2, "absorbing", 4, F.col("id"), F.col("i"), F.col("j"))
    return _scheduled(_pairs(spark, sf_dir)).select("id", "i", "j", prev.alias("y_prev"))


#: The error function of z as a series of positive terms; the SQL engine has none.
ERF = """CASE WHEN abs(z) > 6 THEN sign(z) WHEN z = 0 THEN 0 ELSE sign(z) * 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 160),
  lambda n: exp(2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(abs(z)) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"""


def _edge_step(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    prev = diffusion.edge_step(F.col("logit"), F.col("y"), F.col("alpha_bar"), F.col("alpha_prev"), 2, kind, 4, F.col("id"), F.col("i"), F.col("j"))
    return _scheduled(_pairs(spark, sf_dir)).select("id", "i", "j", prev.alias("y_prev"))


@query("edge_step_uniform", syn.sql(f"""
SELECT id, i, j, CASE WHEN {_u("4", *KEYS)} < o * p1 / (o * p1 + z * (1 - p1) + 0.00000001) THEN 1.0 ELSE 0.0 END AS y_prev FROM (
  SELECT id, i, j, ab / prev * y + (1 - ab / prev) * 0.5 AS o, ab / prev * (1 - y) + (1 - ab / prev) * 0.5 AS z, 1 / (1 + exp(-logit)) AS p1
  FROM pairs JOIN s USING (t)) p""", SCHEDULE, PAIRS, STEP))  # fmt: skip
def edge_step_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_step(spark, sf_dir, "uniform")


@query("edge_step_gaussian", syn.sql(f"""
SELECT id, i, j, CASE WHEN {_u("4", *KEYS)} < 0.5 * (1 + {ERF}) THEN 1.0 ELSE 0.0 END AS y_prev FROM (
  SELECT id, i, j, sqrt(prev) * (2 / (1 + exp(-logit)) - 1) / (sqrt(greatest(1 - prev, 0)) + 0.00000001) / sqrt(2) AS z FROM pairs JOIN s USING (t)) p""", SCHEDULE, PAIRS, STEP))  # fmt: skip
def edge_step_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_step(spark, sf_dir, "discretized_gaussian")


@query("edge_posterior_gaussian", syn.sql(f"""
SELECT id, i, j, round(0.5 * (1 + {ERF}), 6) AS prob FROM (
  SELECT id, i, j, sqrt(prev) * (2 / (1 + exp(-logit)) - 1) / (sqrt(greatest(1 - prev, 0)) + 0.00000001) / sqrt(2) AS z FROM pairs JOIN s USING (t))""", SCHEDULE, PAIRS, STEP))  # fmt: skip
def edge_posterior_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    prob = diffusion.edge_posterior(F.col("logit"), F.col("y"), F.col("alpha_bar"), F.col("alpha_prev"), "discretized_gaussian")
    return _scheduled(_pairs(spark, sf_dir)).select("id", "i", "j", F.round(prob, 6).alias("prob"))


#: Scores of each building for two classes, from its size and position.
CLASSES = """
classes AS (
  SELECT p_partkey AS id, (p_partkey % 499 + 1)::INT AS t, (p_size % 7 - 3) / 2.0::DOUBLE AS a, (p_partkey % 5 - 2) / 2.0::DOUBLE AS c, (p_partkey % 2)::INT AS target FROM part)
"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return syn.table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 499 + 1).cast("int").alias("t"), ((F.col("p_size") % 7 - 3) / 2.0).alias("a"), ((k % 5 - 2) / 2.0).alias("c"), (k % 2).cast("int").alias("target")
    )


@query("category_noise_uniform", "WITH " + SCHEDULE + ", " + CLASSES + f"""
SELECT id, CASE WHEN {_u("3", "id")} < ab THEN (target = 0)::INT::DOUBLE ELSE (floor({_u("3v", "id")} * 2) = 0)::INT::DOUBLE END AS x0,
  CASE WHEN {_u("3", "id")} < ab THEN (target = 1)::INT::DOUBLE ELSE (floor({_u("3v", "id")} * 2) = 1)::INT::DOUBLE END AS x1
FROM classes JOIN schedule USING (t)""")  # fmt: skip
def category_noise_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [(F.col("target") == k).cast("double") for k in (0, 1)]
    noisy = diffusion.category_noise(x, F.col("alpha_bar"), "uniform", 3, F.col("id"))
    return _scheduled(_classes(spark, sf_dir)).select("id", noisy[0].alias("x0"), noisy[1].alias("x1"))


@query("category_noise_absorbing", "WITH " + SCHEDULE + ", " + CLASSES + f"""
SELECT id, CASE WHEN {_u("3", "id")} > ab THEN 0.5 ELSE (target = 0)::INT END AS x0, CASE WHEN {_u("3", "id")} > ab THEN 0.5 ELSE (target = 1)::INT END AS x1
FROM classes JOIN schedule USING (t)""")  # fmt: skip
def category_noise_absorbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [(F.col("target") == k).cast("double") for k in (0, 1)]
    noisy = diffusion.category_noise(x, F.col("alpha_bar"), "absorbing", 3, F.col("id"))
    return _scheduled(_classes(spark, sf_dir)).select("id", noisy[0].alias("x0"), noisy[1].alias("x1"))


@query("category_noise_gaussian", "WITH " + SCHEDULE + ", " + CLASSES + f"""
SELECT id, (z0 >= z1)::INT::DOUBLE AS x0, (z1 > z0)::INT::DOUBLE AS x1 FROM (
  SELECT id, sqrt(ab) * (target = 0)::INT + sqrt(1 - ab) * {_n("30", "id")} AS z0, sqrt(ab) * (target = 1)::INT + sqrt(1 - ab) * {_n("31", "id")} AS z1 FROM classes JOIN schedule USING (t))""")  # fmt: skip
def category_noise_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [(F.col("target") == k).cast("double") for k in (0, 1)]
    noisy = diffusion.category_noise(x, F.col("alpha_bar"), "discretized_gaussian", 3, F.col("id"))
    return _scheduled(_classes(spark, sf_dir)).select("id", noisy[0].alias("x0"), noisy[1].alias("x1"))


def _category_posterior(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    x = [(F.col("target") == k).cast("double") for k in (0, 1)]
    p = diffusion.category_posterior([F.col("a"), F.col("c")], x, F.col("alpha_bar"), F.col("alpha_prev"), kind)
    return _scheduled(_classes(spark, sf_dir)).select("id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


#: Under the other kinds of noise the posterior is the prediction.
PREDICTED = "WITH " + CLASSES + "SELECT id, round(exp(a) / (exp(a) + exp(c)), 6) AS p0, round(exp(c) / (exp(a) + exp(c)), 6) AS p1 FROM classes"


@query("category_posterior_absorbing", PREDICTED)
def category_posterior_absorbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category_posterior(spark, sf_dir, "absorbing")


@query("category_posterior_gaussian", PREDICTED)
def category_posterior_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category_posterior(spark, sf_dir, "discretized_gaussian")


@query("category_posterior_uniform", "WITH " + SCHEDULE + ", " + CLASSES + ", " + STEP + """
SELECT id, round(q0 / (q0 + q1 + 0.00000001), 6) AS p0, round(q1 / (q0 + q1 + 0.00000001), 6) AS p1 FROM (
  SELECT id, (ab / prev * (1 - target) + (1 - ab / prev) / 2) * exp(a) / (exp(a) + exp(c)) AS q0,
    (ab / prev * target + (1 - ab / prev) / 2) * exp(c) / (exp(a) + exp(c)) AS q1 FROM classes JOIN s USING (t))""")  # fmt: skip
def category_posterior_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category_posterior(spark, sf_dir, "uniform")


@query("category_step_uniform", "WITH " + SCHEDULE + ", " + CLASSES + ", " + STEP + f"""
SELECT id, (u * (q0 + q1) < q0)::INT::DOUBLE AS x0, (u * (q0 + q1) >= q0)::INT::DOUBLE AS x1 FROM (
  SELECT id, {_u("8", "id")} AS u, (ab / prev * (1 - target) + (1 - ab / prev) / 2) * exp(a) / (exp(a) + exp(c)) AS q0,
    (ab / prev * target + (1 - ab / prev) / 2) * exp(c) / (exp(a) + exp(c)) AS q1 FROM classes JOIN s USING (t))""")  # fmt: skip
def category_step_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [(F.col("target") == k).cast("double") for k in (0, 1)]
    new = diffusion.category_step([F.col("a"), F.col("c")], x, F.col("alpha_bar"), F.col("alpha_prev"), 2, "uniform", 8, F.col("id"))
    return _scheduled(_classes(spark, sf_dir)).select("id", new[0].alias("x0"), new[1].alias("x1"))


@query("category_step_last", "WITH " + CLASSES + "SELECT id, (a >= c)::INT::DOUBLE AS x0, (a < c)::INT::DOUBLE AS x1 FROM classes")
def category_step_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the last step under Gaussian noise the likeliest class is taken."""
    x = [(F.col("target") == k).cast("double") for k in (0, 1)]
    new = diffusion.category_step([F.col("a"), F.col("c")], x, F.col("alpha_bar"), F.col("alpha_prev"), 1, "discretized_gaussian", 8, F.col("id"))
    return _scheduled(_classes(spark, sf_dir)).select("id", new[0].alias("x0"), new[1].alias("x1"))


@query("masked_mse", syn.sql("""
SELECT round(sum(CASE WHEN n.node < 6 THEN pow((n.id % 3) * 0.5, 2) + pow(n.node * 0.25, 2) + 1 ELSE 0 END) / (3 * sum(CASE WHEN n.node < 6 THEN 1 ELSE 0 END) + 0.000001), 6) AS loss FROM nodes n"""))  # fmt: skip
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes(graph.directed_edges(syn.rings(spark, sf_dir)))
    square = F.pow((F.col("obj") % 3) * 0.5, 2.0) + F.pow(F.col("node") * 0.25, 2.0) + 1
    return nodes.agg(F.round(diffusion.coordinate_loss(square, (F.col("node") < 6).cast("double")), 6).alias("loss"))


#: The pairs of graphs padded to the largest: virtual nodes have no edges.
PADDED = """
size AS (SELECT max(node) + 1 AS n_max FROM nodes),
place AS (SELECT id, unnest(range(0, n_max)) AS k FROM (SELECT DISTINCT id FROM nodes), size),
padded AS (
  SELECT a.id, a.k AS i, c.k AS j, CASE WHEN d.src IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y, ((a.id + 3 * a.k + 5 * c.k) % 9 - 4) / 2.0::DOUBLE AS logit
  FROM place a JOIN place c ON c.id = a.id LEFT JOIN directed d ON d.id = a.id AND d.src = a.k AND d.dst = c.k)
"""


def _padded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.directed_edges(syn.rings(spark, sf_dir))
    n_max = graph.check_n_max(graph.sizes(graph.nodes(edges)).agg(F.max("n_nodes")).first()[0], None)
    near = graph.dense_active(edges, n_max)
    flat = near.select(F.col("obj").alias("id"), F.col("node").alias("i"), F.posexplode_outer("adjacent").alias("j", "e"))  # outer: see graph.pairs
    return flat.select("id", "i", "j", F.col("e").cast("double").alias("y"), (((F.col("id") + 3 * F.col("i") + 5 * F.col("j")) % 9 - 4) / 2.0).alias("logit"))


@query("edge_bce", syn.sql("SELECT round(avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))), 6) AS loss FROM padded", PADDED))
def edge_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all pairs of padded graphs, virtual nodes included."""
    return _padded_pairs(spark, sf_dir).agg(F.round(diffusion.edge_loss(F.col("logit"), F.col("y")), 6).alias("loss"))


#: Graphs padded to ten nodes, in batches of 32, each at a step of its own or (``fixed``) all at one: nodes and pairs under noise.
def _noisy_sql(step: str) -> str:
    return f"""
slots AS (SELECT unnest(range(0, 10)) AS k),
batched AS (SELECT id, r // 32 AS batch FROM (SELECT id, row_number() OVER (ORDER BY md5('42:0:' || id::VARCHAR), id) - 1 AS r FROM b)),
clean AS (
  SELECT g.id, g.batch, k AS node, coalesce(v.x, 0) AS x, coalesce(v.y, 0) AS y, coalesce(v.z, 0) AS z, (v.id IS NOT NULL)::INT::DOUBLE AS mask, (v.id IS NULL)::INT AS target, s.ab
  FROM batched g CROSS JOIN slots LEFT JOIN nodes n ON n.id = g.id AND n.node = k LEFT JOIN vertices v ON v.id = n.id AND v.vid = n.vid JOIN schedule s ON s.t = {step}),
drawn AS (SELECT *, {", ".join(f"{_n('7' + c, 'id', 'node')} * mask AS e{c}" for c in "xyz")}, {_u("8", "id", "node")} AS u, floor({_u("8v", "id", "node")} * 2)::INT AS other FROM clean),
moved AS (SELECT *, {", ".join(f"ab * {c} + sqrt(1 - ab) * (e{c} - sum(e{c}) OVER (PARTITION BY id) / (sum(mask) OVER (PARTITION BY id) + 0.000001)) AS {c}t" for c in "xyz")},
  CASE WHEN u < ab THEN target ELSE other END AS state FROM drawn),
guess AS (SELECT *, {", ".join(f"ab * {c}t / (ab * ab + 1 - ab) AS {c}p" for c in "xyz")}, ln(ab * (state = 0)::INT + (1 - ab) / 2) AS l0, ln(ab * (state = 1)::INT + (1 - ab) / 2) AS l1 FROM moved),
node_part AS (
  SELECT batch, sum(mask * (pow(xp - x, 2) + pow(yp - y, 2) + pow(zp - z, 2))) / (3 * sum(mask) + 0.000001) AS coord_mse,
    avg(ln(exp(l0) + exp(l1)) - CASE target WHEN 0 THEN l0 ELSE l1 END) AS node_ce, avg(((l1 > l0)::INT = target)::INT) AS node_acc FROM guess GROUP BY batch),
cells AS (
  SELECT g.id, g.batch, i.k AS i, j.k AS j, (d.id IS NOT NULL)::INT::DOUBLE AS y, s.ab FROM batched g CROSS JOIN slots i CROSS JOIN slots j
  LEFT JOIN directed d ON d.id = g.id AND d.src = i.k AND d.dst = j.k JOIN schedule s ON s.t = {step}),
hidden AS (SELECT *, CASE WHEN {_u("9", "id", "i", "j")} > ab THEN ({_u("9v", "id", "i", "j")} > 0.5)::INT::DOUBLE ELSE y END AS yt FROM cells),
told AS (SELECT *, ln(0.25 / 0.75) + ln((ab * yt + (1 - ab) / 2) / (ab * (1 - yt) + (1 - ab) / 2)) AS logit FROM hidden),
pair_part AS (SELECT batch, avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))) AS edge_bce FROM told GROUP BY batch)
"""


def _noisy_losses(spark: SparkSession, sf_dir: str, step: Column) -> DataFrame:
    """Losses of the baseline prediction on noisy batches."""
    directed = graph.directed_edges(syn.rings(spark, sf_dir))
    at = graph.positions(graph.nodes(directed), syn.vertices(spark, sf_dir))
    placed = dataset.assign_batches(syn.buildings(spark, sf_dir).select("id"), "id", 32).select("id", "batch")
    clean = graph.padded_nodes(at, 10).select(F.col("obj").alias("id"), "node", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.col("category").alias("target"), F.col("mask").cast("double").alias("mask"))
    noisy = diffusion.coordinate_noise(_scheduled(clean.withColumn("t", step)), F.col("alpha_bar"), 7, ["id"])
    state = diffusion.category_noise([(F.col("target") == k).cast("double") for k in (0, 1)], F.col("alpha_bar"), "uniform", 8, F.col("id"), F.col("node"))
    scores = dict(zip(("l0", "l1"), diffusion.baseline_classes(state, F.col("alpha_bar")), strict=True))
    guess = noisy.withColumns({f"{c}p": diffusion.baseline_coordinate(F.col(f"{c}t"), F.col("alpha_bar")) for c in "xyz"} | scores)
    cells = graph.dense_active(directed, 10).select(F.col("obj").alias("id"), F.col("node").alias("i"), "adjacent")
    flat = cells.join(session.shuffled(placed), "id").select("id", "batch", "i", F.posexplode_outer("adjacent").alias("j", "e"))  # batched before they unfold
    pairs = flat.select("id", "batch", "i", "j", F.col("e").cast("double").alias("y"))
    hidden = diffusion.edge_noise(F.col("y"), F.col("alpha_bar"), "uniform", 9, F.col("id"), F.col("i"), F.col("j"))
    told = _scheduled(pairs.withColumn("t", step)).withColumn("logit", diffusion.baseline_edge(hidden, F.col("alpha_bar")))
    return diffusion.batch_losses(guess.join(session.shuffled(placed), "id"), told, ["l0", "l1"])


@query("training_step", syn.sql("""
SELECT batch, round(coord_mse, 6) AS coord_mse, round(edge_bce, 6) AS edge_bce, round(node_ce, 6) AS node_ce, round(3 * coord_mse + 2 * edge_bce + node_ce, 5) AS loss
FROM node_part JOIN pair_part USING (batch)""", SCHEDULE, _noisy_sql("g.id % 499 + 1")))  # fmt: skip
def training_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each graph at a step of its own."""
    out = _noisy_losses(spark, sf_dir, (F.col("id") % 499 + 1).cast("int"))
    return out.select("batch", *(F.round(c, 6).alias(c) for c in ("coord_mse", "edge_bce", "node_ce")), F.round("loss", 5).alias("loss"))


@query("validation_step", syn.sql("SELECT batch, round(coord_mse, 6) AS val_coord_mse, round(node_acc, 6) AS val_node_acc FROM node_part", SCHEDULE, _noisy_sql(str(T // 2))))
def validation_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise at half the steps."""
    out = _noisy_losses(spark, sf_dir, F.lit(diffusion.validation_time(T)))
    return out.select("batch", F.round("coord_mse", 6).alias("val_coord_mse"), F.round("node_acc", 6).alias("val_node_acc"))


@query("category_step_absorbing", "WITH " + SCHEDULE + ", " + CLASSES + ", " + STEP + f"""
SELECT id, CASE WHEN id % 3 > 0 THEN (target = 0)::INT WHEN r >= prev THEN 0.5 ELSE (u * (exp(a) + exp(c)) < exp(a))::INT END::DOUBLE AS x0,
  CASE WHEN id % 3 > 0 THEN (target = 1)::INT WHEN r >= prev THEN 0.5 ELSE (u * (exp(a) + exp(c)) >= exp(a))::INT END::DOUBLE AS x1
FROM (SELECT *, {_u("8", "id")} AS u, {_u("8r", "id")} AS r FROM classes JOIN s USING (t))""")  # fmt: skip
def category_step_absorbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third class is masked: it is revealed by what is predicted, or stays masked."""
    hidden = F.col("id") % 3 == 0
    x = [F.when(hidden, 0.5).otherwise((F.col("target") == k).cast("double")) for k in (0, 1)]
    new = diffusion.category_step([F.col("a"), F.col("c")], x, F.col("alpha_bar"), F.col("alpha_prev"), 2, "absorbing", 8, F.col("id"))
    return _scheduled(_classes(spark, sf_dir)).select("id", new[0].alias("x0"), new[1].alias("x1"))


@query("node_cross_entropy", "WITH " + CLASSES + """
SELECT round(avg(ln(exp(a) + exp(c)) - CASE target WHEN 0 THEN a ELSE c END), 6) AS loss, round(avg(((CASE WHEN c > a THEN 1 ELSE 0 END) = target)::INT), 6) AS accuracy FROM classes""")  # fmt: skip
def node_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.col("a"), F.col("c")]
    return _classes(spark, sf_dir).agg(
        F.round(diffusion.node_loss(scores, F.col("target")), 6).alias("loss"), F.round(diffusion.accuracy(scores, F.col("target")), 6).alias("accuracy")
    )


@query("weighted_loss", "WITH " + CLASSES + """
SELECT round(3 * sum(a * a) / (count(*) * 3 + 0.000001) + 2 * avg(greatest(c, 0) - c * target + ln(1 + exp(-abs(c)))) + avg(ln(exp(a) + exp(c)) - CASE target WHEN 0 THEN a ELSE c END), 6) AS loss FROM classes""")  # fmt: skip
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c, y = F.col("a"), F.col("c"), F.col("target")
    total = diffusion.total_loss(diffusion.coordinate_loss(a * a, F.lit(1.0)), diffusion.edge_loss(c, y), diffusion.node_loss([a, c], y))
    return _classes(spark, sf_dir).agg(F.round(total, 6).alias("loss"))


@query("pair_features", syn.sql("""
SELECT a.id, a.vid AS i, c.vid AS j, round(sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2)), 6) AS dist, round(sqrt(a.x * a.x + a.y * a.y + a.z * a.z), 6) AS norm_i,
  round(sqrt(c.x * c.x + c.y * c.y + c.z * c.z), 6) AS norm_j,
  round((a.x * c.x + a.y * c.y + a.z * c.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(c.x * c.x + c.y * c.y + c.z * c.z) + 0.000001), 6) AS cos
FROM vertices a JOIN vertices c ON c.id = a.id"""))  # fmt: skip
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = syn.vertices(spark, sf_dir).select(F.col("file").alias("id"), F.col("vid").alias("node"), "x", "y", "z")
    return diffusion.pair_features(nodes, ["id"]).select("id", "i", "j", *(F.round(c, 6).alias(c) for c in ("dist", "norm_i", "norm_j", "cos")))


@query("message_sum", syn.sql("SELECT id, i, sum(y * (1 + j)) AS total FROM pairs GROUP BY id, i", PAIRS))
def message_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffusion.message_sums(_pairs(spark, sf_dir).withColumn("msg", F.col("y") * (1 + F.col("j"))), ["id"])


@query("center_of_mass", syn.sql("""
SELECT id, vid, round(x - avg(x) OVER (PARTITION BY id), 6) + 0 AS x, round(y - avg(y) OVER (PARTITION BY id), 6) + 0 AS y, round(z - avg(z) OVER (PARTITION BY id), 6) + 0 AS z FROM vertices"""))  # fmt: skip
def center_of_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = syn.vertices(spark, sf_dir).select(F.col("file").alias("id"), "vid", "x", "y", "z")
    return diffusion.centered(nodes, ["id"], ["x", "y", "z"]).select("id", "vid", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


@query("embedding_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def embedding_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.table(spark, sf_dir, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("best"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 4) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.norm(F.col("embedding")), 4).alias("norm"))


@query("hash_uniforms", f"SELECT doc_id, round({_u('1', 'doc_id')}, 9) AS u, round({_n('1', 'doc_id')}, 6) AS z FROM documents")
def hash_uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = syn.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(random.uniform(1, F.col("doc_id")), 9).alias("u"), F.round(random.normal(1, F.col("doc_id")), 6).alias("z"))


#: The cycles of the edges over the threshold are faces; their corners go through the planes.
RECONSTRUCTED = CYCLES.replace("directed", "linked").format(mesh=syn.SQL.strip() + ",\nlinked AS (SELECT * FROM directed WHERE (src + dst + id) % 5 <> 0)").replace(
    "SELECT id, array_to_string(path, ',') AS cycle FROM closed c", ", cycle AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY path) - 1 AS face FROM closed c"
) + "), " + """
corner_of AS (SELECT id, face, generate_subscripts(path, 1) - 1 AS pos, unnest(path) AS vid FROM cycle),
pts AS (SELECT c.id, c.face, c.pos, c.vid, v.x, v.y, v.z FROM corner_of c JOIN vertices v ON v.id = c.id AND v.vid = c.vid),
""" + syn.PLANES.strip() + """,
closed_faces AS (
  SELECT c.id, '[' || string_agg('[[' || array_to_string(path, ',') || ']]', ',' ORDER BY c.face) || ']' AS boundaries,
    string_agg(s.surface_type, ',' ORDER BY c.face) AS surfaces FROM cycle c JOIN snapped s ON s.id = c.id AND s.face = c.face GROUP BY c.id)
SELECT f.id, 'building_' || f.id AS name, boundaries, surfaces,
  string_agg(round(coalesce(m.x, v.x) * 100000)::BIGINT || ' ' || round(coalesce(m.y, v.y) * 100000)::BIGINT || ' ' || round(coalesce(m.z, v.z) * 100000)::BIGINT, ',' ORDER BY v.vid) AS vertices
FROM closed_faces f JOIN vertices v ON v.id = f.id LEFT JOIN meant m ON m.id = v.id AND m.vid = v.vid GROUP BY f.id, boundaries, surfaces
"""  # fmt: skip


@query("reconstruct_buildings", RECONSTRUCTED)
def reconstruct_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge probabilities to documents: faces, planes, JSON text; and the text read back."""
    nodes = syn.vertices(spark, sf_dir).select(F.col("file").alias("id"), F.col("vid").alias("node"), "x", "y", "z")
    found = export.reconstruct(nodes, _probs(spark, sf_dir))
    docs = export.document(found, F.concat(F.lit("building_"), F.col("id").cast("string"))).select(F.col("id").alias("file"), F.col("json").alias("value"))
    parsed = cityjson.parse(session.settled(docs))  # read twice below, made once
    units = F.transform("vertices", lambda v: F.array_join(F.transform(v, lambda c: F.round(c * 100000).cast("long").cast("string")), " "))
    flat = mesh.geometries(mesh.objects(parsed)).select(
        "file", F.col("obj").alias("name"), F.to_json(F.col("boundaries")[0]).alias("boundaries"),
        F.array_join(F.transform(F.col("values")[0], lambda k: mesh.kind(F.col("surfaces"), k)), ",").alias("surfaces"),
    )
    return flat.join(session.shuffled(parsed.select("file", F.array_join(units, ",").alias("vertices"))), "file").withColumnRenamed("file", "id")


#: Weights of a small untrained network under which some nodes are active and some pairs pass the threshold.
GENERATED = {"weights": {"hidden": 16, "layers": 2, "seed": 5}, "count": 10, "n": 8, "threshold": 0.2, "steps": 20, "seed": 0}


@query("generate_buildings")
def generate_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten graphs sampled with untrained weights, and what closes a face."""
    weights = network.random_weights(**GENERATED["weights"])
    found = network.generate(spark, weights, GENERATED["count"], GENERATED["n"], GENERATED["threshold"], steps=GENERATED["steps"], seed=GENERATED["seed"])
    return found.select("id", F.size("vertices").alias("n_vertices"), F.size("boundaries").alias("n_faces"))
