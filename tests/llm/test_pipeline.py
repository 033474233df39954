"""The pipeline against a plain version of every stage."""

import re

import numpy as np
import pytest
from helpers import words
from test_dedup import brute_classes, repeats
from test_scans import brute_hits

import corpus_pipeline
from stratablock.llm import packing, quality


def documents():
    rng = np.random.default_rng(0)
    passage, leak = " ".join(words(50, 60)), " ".join(words(51, 14))
    rows = []
    for k in range(60):
        body = words(1000 + k, int(rng.integers(80, 160)))
        if k % 6 == 0:
            body[30:30] = passage.split()
        if k % 9 == 0:
            body[10:10] = leak.split()
        if k % 10 == 3:
            body = [w + "%%%" for w in body]
        rows.append((k, " ".join(body), "en", f"s{k % 3}", 0))
    rows += [(70 + k, rows[k][1] + (" tail" * k), "en", "s", 0) for k in range(4)]  # copies and near copies
    rows += [(80, passage, "en", "s", 0), (81, None, None, None, None), (82, "too short", "en", "s", 9)]
    labels = [(k, 0 if k % 10 == 3 else 1, 0) for k in range(60)]
    return rows, labels, [(1, leak), (2, " ".join(words(52, 30)))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def plain(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_plain_versions(spark, folder):
    rows, labels, items = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)

    kept = by_name["quality rules"](spark, docs, folder)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    first = plain(kept)
    model = quality.fit_on_labels(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert set(first) == {r[0] for r in rows if not quality.base_failed(*(quality.surface(r[1])[i] for i in (0, 4))) and scored[r[0]].quality_score >= quality.KEEP_FROM}
    assert not any(k % 10 == 3 for k in first if k < 60) and {1, 2, 4, 5} <= set(first)

    second = plain(by_name["n-gram jaccard join"](spark, kept, folder))
    order = sorted(first)
    classes = brute_classes([(k, first[k]) for k in order])
    assert second == {k: first[k] for k, (_, c, _) in zip(order, classes, strict=True) if c == k}

    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in second.items()], docs.schema)
    third = by_name["substring dedup"](spark, docs, folder)
    order = sorted(second)
    seqs = [second[k].split() for k in order]
    want = {}
    for k, s, gone in zip(order, seqs, repeats(seqs, 35), strict=True):
        if not gone.all():
            want[k] = second[k] if not gone.any() else " ".join(w for w, g in zip(s, gone, strict=True) if not g)
    assert plain(third) == want
    assert all(r.n_chars == len(r.text) for r in third.collect())

    fourth = plain(by_name["benchmark decontamination"](spark, third, folder))
    order = sorted(want)
    hits = list(brute_hits([(k, want[k]) for k in order], items, 10))
    for k, (n, hit, _) in zip(order, hits, strict=True):
        assert (k in fourth) == (not hit.all() or n == 0)
        if k in fourth:
            left = [w for w, h in zip(re.findall(r"[0-9A-Za-z]+", want[k]), hit, strict=True) if not h]
            assert re.findall(r"[0-9A-Za-z]+", fourth[k]) == left

    last = by_name["best-fit packing"](spark, spark.createDataFrame([(k, t) for k, t in fourth.items()], "doc_id long, text string"), folder).collect()
    assert {(r.doc_id, r.length) for r in last} == {(k, len(packing.token_ids(t)) + 1) for k, t in fourth.items()}


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 30


def test_jaccard_stage_tells_rows_apart_by_text(spark, folder):
    """Different texts of one id stay, equal rows and copies without an id go."""
    one, two, three = (" ".join(words(900 + k, 60)) for k in range(3))
    near = one + " tail"
    rows = [(1, one), (1, two), (1, two), (2, one), (None, near), (None, three), (None, three), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["n-gram jaccard join"](spark, docs, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, one), (1, two), (None, three), (3, None), (4, "")], key=repr)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name
