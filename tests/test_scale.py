"""Plans and partitions that hold when a small file unfolds to many rows, and texts of times at ties."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stratablock import session
from stratablock.functions import times
from stratablock.operators import cycles, export, graph
from stratablock.plans import dataset_queries, mesh_queries, model_queries, registry
from stratablock.plans import synthetic as syn

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLANS = (mesh_queries, dataset_queries, model_queries)
#: Broadcasts of proven size: the noise schedule, and the shifts of ranges.
BROADCASTS = {
    **dict.fromkeys(("lod1_faces_outward", "message_sum", "reconstruct_buildings", "active_submatrix", "base_center", "centered_nodes", "closed_polyline_checked"), 0),
    **dict.fromkeys(("converted_documents", "combined_documents", "base_center_fallback", "dense_adjacency", "edge_bce", "edge_threshold", "face_scatter_matrix"), 0),
    **dict.fromkeys(("edge_posterior_gaussian", "edge_posterior_uniform", "edge_step_absorbing", "edge_step_gaussian", "edge_step_uniform", "gaussian_noise_replay"), 1),
    **dict.fromkeys(("edge_noise_absorbing", "edge_noise_gaussian", "edge_noise_uniform"), 1), "training_step": 4,
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(BROADCASTS))
def test_only_small_tables_are_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == BROADCASTS[name]
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = 2 * session.ROWS_A_TASK + 1
    spark.range(rows).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def _largest(rows) -> int:
    """Files of the partition that has most."""
    return rows.select("file", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().agg(F.max("count")).first()[0]


def test_a_small_file_is_dealt_before_it_unfolds(spark, parts):
    for rows in (syn.rings(spark, parts), graph.directed_edges(syn.rings(spark, parts)), dataset_queries._documents(spark, parts), dataset_queries._sparse_documents(spark, parts)):
        assert _largest(rows) <= 1.2 * session.ROWS_A_TASK


def test_times_at_ties(spark):
    start, micros = dt.datetime(2024, 1, 1), [0, 1_775_000, 2_125_000, 5_000, 1_711_910_365_000, 986_565_171_500, 191_188_795_000, -1_775_000]
    rows = spark.createDataFrame([(m, start, start + dt.timedelta(microseconds=m)) for m in micros], "m long, a timestamp_ntz, b timestamp_ntz")
    seconds = times.elapsed(F.col("a"), F.col("b"))
    for r in rows.select("m", seconds.alias("s"), times.elapsed_text(seconds).alias("text"), times.rounded(seconds, 3).alias("r")).collect():
        assert r["s"] == pytest.approx(r["m"] / 1e6, abs=1e-9)
        assert r["text"] == f"{r['s']:.2f} seconds"
        assert abs(r["r"] - r["s"]) <= 0.000500001
    assert rows.filter("m = 986565171500").select(times.rounded(seconds, 3)).first()[0] == 986565.171


def test_file_names_are_all_different_past_four_digits(spark):
    named = export.file_names(spark.range(10_002), "id")
    assert named.select("file_name").distinct().count() == 10_002
    assert named.filter("id = 10001").first()["file_name"] == "building_10001.city.json"


def _optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["combined_documents", "reconstruct_buildings"])
def test_documents_read_twice_are_made_once(spark, name):
    """What is read back comes from documents that were kept, not from the tables again."""
    assert "parquet" not in _optimized(registry.QUERIES[name](spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["straighten_faces", "regularize"])
def test_planes_are_not_worked_out_in_a_filter(spark, name):
    plan = _optimized(registry.QUERIES[name](spark, SF))
    assert not any("aggregate(" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))


@pytest.mark.parametrize("name", ["edge_posterior_gaussian", "edge_step_absorbing", "message_sum", "edge_noise_uniform", "edge_threshold"])
def test_pairs_are_never_joined_or_shuffled(spark, parts, name):
    """All pairs of a building unfold where its edges are: only the table's rows are dealt."""
    plan = registry.QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(p_partkey") > 0


def test_pairs_equal_plain_loops(spark):
    edges = [(1, 7, 5), (1, 5, 7), (1, 7, 9), (1, 9, 7), (2, 3, 3)]
    directed = spark.createDataFrame([(f, f, a, b) for f, a, b in edges], "file long, obj long, src int, dst int")
    want = set()
    for f in (1, 2):
        vids = sorted({a for g, a, _ in edges if g == f})
        want |= {(f, f, i, j, a, b, (f, a, b) in edges) for i, a in enumerate(vids) for j, b in enumerate(vids)}
    assert {tuple(r) for r in graph.pairs(directed).collect()} == want


def _exchanges(spark, parts, name) -> tuple[int, int]:
    """Shuffles by key, and those of the table's rows among them."""
    plan = registry.QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning("), plan.count("Exchange hashpartitioning(p_partkey")


def test_active_pairs_are_never_shuffled(spark, parts):
    """A building's active nodes meet its pairs where they unfold: only the table's rows are dealt."""
    every, dealt = _exchanges(spark, parts, "active_submatrix")
    assert every == dealt > 0


def test_active_pairs_equal_plain_loops(spark):
    classes = [(g, v, (g + v) % 3 // 2) for g in range(6) for v in range(2, 2 + g)]
    pairs = [(g, a, b, float(100 * g + 10 * a + b)) for g in range(6) for a in range(9) for b in range(9)]
    numbered, among = cycles.active_edges(spark.createDataFrame(pairs, "id long, src int, dst int, prob double"), spark.createDataFrame(classes, "id long, node int, class int"))
    want_nodes, want = set(), set()
    for g in range(6):
        active = [v for k, v, c in classes if k == g and c == 0]
        if len(active) >= 3:
            want_nodes |= {(g, v, k) for k, v in enumerate(active)}
            want |= {(g, active.index(a), active.index(b), p) for k, a, b, p in pairs if k == g and a in active and b in active}
    assert want and {tuple(r) for r in numbered.collect()} == want_nodes
    assert {tuple(r) for r in among.collect()} == want


def test_dense_rows_are_never_shuffled(spark, parts):
    every, dealt = _exchanges(spark, parts, "dense_adjacency")
    assert every == dealt > 0


def test_dense_rows_of_active_vertices_equal_those_joined_to_numbers(spark):
    edges = [(1, 7, 5), (1, 5, 7), (1, 7, 9), (1, 9, 7), (2, 3, 3), (3, 4, 8), (3, 8, 4)]
    directed = spark.createDataFrame([(f, f, a, b) for f, a, b in edges], "file long, obj long, src int, dst int")
    numbered = graph.nodes(directed)
    want, found = graph.dense_adjacency(numbered, graph.local_edges(directed, numbered), 4), graph.dense_active(directed, 4)
    assert found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_a_graph_without_edges_has_empty_dense_rows(spark):
    at = spark.createDataFrame([("f", "a", 0), ("f", "a", 1), ("f", "b", 0)], "file string, obj string, node int")
    local = spark.createDataFrame([("f", "a", 0, 1), ("f", "a", 1, 0)], "file string, obj string, src int, dst int")
    dense = {(r.obj, r.node): r.adjacent for r in graph.dense_adjacency(at, local, 2).collect()}
    assert dense == {("a", 0): [0, 1], ("a", 1): [1, 0], ("b", 0): [0, 0], ("b", 1): [0, 0]}


def test_padded_pairs_are_never_shuffled(spark, parts):
    every, dealt = _exchanges(spark, parts, "edge_bce")
    assert every == dealt > 0


def test_pairs_unfold_after_their_batch_is_known(spark, parts):
    """From where a batch's pairs unfold to where they are summed, only the noise schedule is joined."""
    lines = _optimized(registry.QUERIES["training_step"](spark, parts)).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(k for k, line in enumerate(lines) if "Generate posexplode(adjacent" in line)
    joins, here = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            if line.lstrip(" :+-").startswith("Aggregate"):
                break
            joins += [line] if "Join" in line else []
    assert len(joins) == 1 and "strategy=broadcast" in joins[0]


def test_padded_nodes_are_never_joined(spark, parts):
    at = graph.nodes(graph.directed_edges(syn.rings(spark, parts))).select("file", "obj", "node", *(F.lit(1.0).cast("float").alias(c) for c in "xyz"))
    plan = graph.padded_nodes(at, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["edge_noise_absorbing", "edge_noise_gaussian", "edge_step_gaussian", "edge_step_uniform", "edge_posterior_uniform"])
def test_pairs_of_every_kind_are_never_joined_or_shuffled(spark, parts, name):
    every, dealt = _exchanges(spark, parts, name)
    assert every == dealt > 0
