"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, fmindex, jaccard, langid, licenses, lpf, negatives, oracles, packing, pieces, pitman_yor, quality, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return automaton.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows outside the held-out fifth; a null id is never held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(langid.fold(n=5) == 0, F.lit(False))
    model = langid.fit_on_labels(docs.filter(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its document's label: the number in the path is the doc_id; bad is low quality or toxic."""
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").dropna()
    number = F.regexp_extract(urls.path(F.col("url")), r"/([0-9]{1,18})", 1).try_cast("long")
    outcomes = pages.withColumn("doc_id", number).join(labels, "doc_id")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return urls.judge(pages, outcomes.select("url", bad.alias("bad"))).drop("bad_mean", "bad_lower")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "detections")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(langid.fold(n=7) == 2, F.lit(False))
    scored, tokens = pitman_yor.score(docs.select("doc_id", held.alias("held_out"), (~held).alias("learn"), "text"), stable=True)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return lpf.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = fmindex.decontaminate(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"), with_text=False)
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit_on_labels(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model).drop("text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; ids divisible by 7 carry the next label."""
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRINGS,
    "op3_url_filters": oracles.URLS,
    "op5_jaccard_join": oracles.JACCARD,
    "op9_decontamination": oracles.BENCHMARK,
}
