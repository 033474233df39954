import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratablock.functions import arrays, random
from stratablock.operators import dataset, graph


def test_exact_split_sizes(spark):
    got = dataset.exact_split(spark.range(35).withColumnRenamed("id", "k"), "k").groupBy("part").count()
    assert {r.part: r["count"] for r in got.collect()} == {"train": 28, "val": 3, "test": 4}
    with pytest.raises(ValueError):
        dataset.exact_split(spark.range(0), "id")
    with pytest.raises(ValueError):
        dataset.check_ratios((0.8, 0.1, 0.2))


def test_batches(spark):
    rows = dataset.assign_batches(spark.range(35), "id", 32).groupBy("batch").count()
    assert {r.batch: r["count"] for r in rows.collect()} == {0: 32, 1: 3}
    order = lambda e: [r.id for r in dataset.assign_batches(spark.range(35), "id", 32, epoch=e).orderBy("batch", "place").collect()]
    assert order(1) == order(1) != order(2)


def test_last_wins_takes_whole_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "y")], "k string, o int, p string, q string")
    assert dataset.last_wins(rows, "k", "o").select("p", "q").first() == (None, "y")


def test_sampling(spark):
    take = lambda k, s: {r.id for r in dataset.seeded_sample(spark.range(50), "id", k, s).collect()}
    assert len(take(30, 42)) == 30 and take(30, 42) == take(30, 42) != take(30, 43) and len(take(99, 1)) == 50


def test_bookkeeping(spark):
    m = spark.createDataFrame([(e, v) for e, v in enumerate([5.0, 3.0, 4.0, 3.0, 3.5, 2.0])], "epoch int, v double")
    kept = {(r.epoch, r.kept) for r in dataset.top_checkpoints(m, "v", "epoch").collect()}
    assert kept == {(5, "best"), (1, "best"), (3, "best"), (5, "last")}
    runs = m.withColumn("run", F.lit(1))
    assert dataset.early_stop(runs, "v", "epoch", ["run"], 3).first().stopped_at == 4
    assert dataset.early_stop(runs, "v", "epoch", ["run"], 5).first().stopped_at is None
    lr = dataset.learning_rate(spark.range(3).withColumnRenamed("id", "epoch"), "cosine", max_epochs=2)
    assert [round(r.lr, 9) for r in lr.orderBy("epoch").collect()] == [0.001, 0.0005005, 1e-06]
    with pytest.raises(ValueError):
        dataset.learning_rate(m, "other")


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "obj int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "obj int, v string")
    assert [r.obj for r in dataset.common_ids([a, b]).collect()] == [2]
    row = dataset.aligned([a, b]).first()
    assert (row.obj, row.lod_0.v, row.lod_1.v) == (2, "y", "z")


def test_functions(spark):
    row = spark.range(1).select(
        arrays.argmax(F.array(*map(F.lit, (1.0, 3.0, 3.0)))).alias("m"), arrays.closed(F.array(F.lit(1), F.lit(2))).alias("c"),
        arrays.rotated(F.array().cast("array<int>")).alias("e"), arrays.softmax([F.lit(0.0), F.lit(0.0)])[0].alias("s"),
        arrays.safe_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), arrays.safe_name(F.lit("a b/c\\d")).alias("n"), arrays.silu(F.lit(0.0)).alias("u"),
    ).first()
    assert (row.m, row.c, row.e, row.s, row.z, row.n, row.u) == (1, [1, 2, 1], [], 0.5, 0.0, "a_b_c_d", 0.0)
    got = spark.range(3000).select(random.uniform(1, F.col("id")).alias("u"), random.normal(2, F.col("id")).alias("z"), random.integer(3, 4, F.col("id")).alias("i")).toPandas()
    assert abs(got.u.mean() - 0.5) < 0.03 and abs(got.z.mean()) < 0.08 and abs(got.z.std() - 1) < 0.06 and set(got.i) == {0, 1, 2}


def test_running_numbers_over_a_whole_table(spark):
    from stratablock.operators import export

    rows = [(f"k{k:04d}", k % 7) for k in range(1000)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    got = {r.k: r.place for r in dataset.sorted_ranks(df, "k", "place").collect()}
    assert got == {k: i for i, (k, _) in enumerate(rows)}
    got, at = {r.k: r.offset for r in export.vertex_offsets(df, "k").collect()}, 0
    for k, n in rows:
        assert got[k] == at
        at += n
    assert dataset.sorted_ranks(df.limit(0), "k", "place").count() == 0


def test_objects_of_file_pairs(spark):
    schema = "rel_path string, CityObjects map<string,string>"
    one = spark.createDataFrame([("a", {"x": "", "y": "", "z": ""}), ("b", {"x": "", "q": ""}), ("c", {"w": ""}), ("d", None)], schema)
    two = spark.createDataFrame([("a", {"x": "", "q": "", "y": ""}), ("b", {"x": "", "z": ""}), ("d", {"x": ""}), ("e", {"w": ""})], schema)
    assert {(r.obj, r.rel_path) for r in dataset.pair_objects(one, two).collect()} == {("x", "b"), ("y", "a")}


def test_collated_batches(spark):
    nodes = [("f", o, k, float(k), float(n), 0.5) for o, n in (("a", 3), ("b", 2), ("c", 1)) for k in range(n)]
    edges = [("f", "a", 0, 1), ("f", "a", 1, 0), ("f", "a", 2, 0), ("f", "b", 0, 1), ("f", "b", 0, 1)]
    at = spark.createDataFrame(nodes, "file string, obj string, node int, x double, y double, z double").select("file", "obj", "node", *(F.col(c).cast("float").alias(c) for c in "xyz"))
    level = graph.sparse(at, spark.createDataFrame(edges, "file string, obj string, src int, dst int")).withColumn("type", F.concat(F.lit("T"), "obj"))
    places = spark.createDataFrame([("b", 0, 0), ("a", 0, 1), ("c", 1, 0), ("gone", 1, 1)], "obj string, batch int, place int")
    rows = {r.batch: r for r in graph.collate(places, [level], 3).collect()}
    assert rows[0].ids == ["b", "a"] and rows[0].types == ["Tb", "Ta"] and rows[1].ids == ["c"]
    assert rows[0].x == [[[0, 2, 0.5], [1, 2, 0.5], [0, 0, 0]], [[0, 3, 0.5], [1, 3, 0.5], [2, 3, 0.5]]]
    assert rows[0].node_mask == [[1, 1, 0], [1, 1, 1]] and rows[0].node_categories[0] == [[1, 0], [1, 0], [0, 1]]
    assert rows[0].y == [[[[0], [1], [0]], [[0], [0], [0]], [[0], [0], [0]]], [[[0], [1], [0]], [[1], [0], [0]], [[1], [0], [0]]]]
    two = graph.collate(places, [level, level.filter("obj <> 'a'")], 4).collect()
    assert {r.batch: (r.lod_0.ids, r.lod_1.ids, len(r.lod_1.y[0][3])) for r in two} == {0: (["b"], ["b"], 4), 1: (["c"], ["c"], 4)}
    with pytest.raises(Exception, match="more than n_max"):
        graph.collate(places, [level], 2).collect()


@pytest.mark.parametrize("rows_a_range", [2_000_000, 7])
def test_ranks_equal_a_global_window(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(dataset, "ROWS_A_RANGE", rows_a_range)
    rows = spark.range(300).select(F.when(F.col("id") != 17, F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("k"), (F.col("id") % 5).alias("v")).distinct()
    whole = Window.orderBy("k")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    want = {r.k: (r.a, r.b) for r in rows.select("k", (F.row_number().over(whole) - 1).alias("a"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("b")).collect()}
    assert {r.k: r.n for r in dataset.sorted_ranks(rows, "k", "n").collect()} == {k: a for k, (a, _) in want.items()}
    assert {r.k: r.n for r in dataset.sorted_ranks(rows, "k", "n", value=F.col("v")).collect()} == {k: b for k, (_, b) in want.items()}
    assert dataset.sorted_ranks(rows.filter("false"), "k", "n").collect() == []
