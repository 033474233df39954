"""Bounded samples of labelled rows, and classifiers fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: A fitted classifier sees at most so many rows and bytes of text.
MAX_ROWS, MAX_BYTES = 2000, 12_000_000


def labels_of(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, label of the rows of ``docs`` whose id is among the first ``max_rows`` labelled ids in the order of a hash.

    Of several labels of an id the smallest holds, for all rows of that id; ids may be of any type.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    first = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")


def labelled_sample(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """place, text, label of a sample of ``rows`` (doc_id, text, label), the same on every run: each text has its own row's label.

    Different rows are taken in the order of a hash of id, text and label, up to
    ``max_rows``, and up to the first whose text would pass ``max_bytes`` in
    all. A text longer than that by itself is left out; so are nulls. Only
    hashes and lengths travel until the sample is chosen; equal rows count once.
    """
    rows = rows.select("doc_id", "text", "label").dropna()
    key = F.xxhash64("doc_id", "text", "label", F.lit(17))
    sized = rows.select(key.alias("key"), F.octet_length("text").alias("size")).filter(F.col("size") <= max_bytes)
    first = sized.groupBy("key").agg(F.min("size").alias("size")).orderBy("key").limit(max_rows).collect()
    chosen, total = [], 0
    for k, size in first:
        if total + size > max_bytes:
            break
        chosen.append((k, len(chosen)))
        total += size
    spark = rows.sparkSession
    pick = spark.createDataFrame(chosen, "key long, place int")
    return rows.withColumn("key", key).join(F.broadcast(pick), "key").groupBy("place").agg(F.min_by(F.struct("text", "label"), "key").alias("row")).select("place", "row.text", "row.label")


def fitted(sample: DataFrame, fit: Callable[[list], object]) -> object:
    """What ``fit`` makes of the (text, label) of a bounded sample, in one task: the texts never reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows), 5)], pa.binary())], names=["model"])

    store.bound_batches(sample.sparkSession)
    made = sample.repartition(1).sortWithinPartitions("place").select("text", "label").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([])
