"""Session settings that the engine's plans are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Rows that one task makes documents or meshes of.
ROWS_A_TASK = 10_000


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in as many partitions as their number calls for, before each becomes many: a small file is one task, whatever is made of its rows."""
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), *by)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that grows with the data, and is never sent whole to the driver and all executors.

    Spark takes what arrays, texts and pairs unfold to for hardly larger than the file it came from, and would broadcast it.
    """
    return rows.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the checkpoint folder that all executors share; a private one only on a local master without any."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratablock-"))
    return df.checkpoint()
