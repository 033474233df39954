"""A corpus from raw documents: each stage calls one operator and works on all that its predecessor kept.

Every stage but the last returns the columns of documents; the last returns
the packed pieces. ``n_chars`` follows the text wherever a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratablock.llm import automaton, fmindex, jaccard, packing, quality, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text."""
    new = docs.drop("text").withColumnRenamed(text, "text")
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_on_labels(docs, labels)
    return quality.score(docs.select(*COLUMNS), model).filter("kept").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: of the smallest id, an id before none, on ties the one of the smallest hash.

    Rows are told apart by all of their columns, so different texts of one id are
    judged each by itself, and copies without an id go like all others.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*COLUMNS).alias("hash"))
    rows = docs.select(*COLUMNS).withColumn("__row", row)
    found = jaccard.classes(rows.select(F.col("__row").alias("doc_id"), "text"))
    first = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__row")).distinct()
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages go; a document of which nothing is left goes too."""
    found = automaton.remove_repeats(docs.select(*COLUMNS))
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(found.filter("n_removed < n_words or n_words = 0").withColumn("__new", changed), "__new")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages go; a document of which nothing is left goes too."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = fmindex.decontaminate(docs.select(*COLUMNS), benchmark)
    return _with_text(found.filter("n_hit < n_words or n_words = 0"), "clean_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: A trained model, hashes and token ids take part: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stage's output written as a table and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = store.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            store.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
