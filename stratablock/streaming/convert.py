"""Blocks from documents as they arrive: a stream over a folder.

A document becomes a block on its own, so the stream keeps no state. Each
micro-batch goes through the same relational conversion as a batch of files.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lod1, mesh
from ..sources import cityjson


def arriving(spark: SparkSession, folder: str | Path, per_trigger: int = 1000) -> DataFrame:
    """file and value of JSON files as they appear below a folder."""
    raw = (
        spark.readStream.option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", cityjson.JSON_FILES).option("maxFilesPerTrigger", per_trigger).text(str(folder))
    )
    return raw.select(cityjson.relative(folder, F.col("_metadata.file_path")).alias("file"), "value")


def blocks(documents: DataFrame) -> DataFrame:
    """The block faces of a table of documents."""
    geometries = mesh.geometries(mesh.objects(documents))
    return lod1.convert(geometries, mesh.rings(geometries), mesh.vertices(documents))[0]


def start(spark: SparkSession, folder: str | Path, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add the block faces of new documents to a Parquet table, one partition ``batch`` each time: a repeated batch replaces itself."""

    def batch(raw: DataFrame, number: int) -> None:
        blocks(cityjson.parse(raw)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
