"""Where operators cut lineage, and how they size what they keep in memory.

Intermediate tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``: every executor can read them, so a lost executor
costs only its running tasks. A private folder is made only where the setting
is absent and the master is local (single-machine tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one made for this process where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="stratablock-")
    return "file://" + _own["dir"]


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove a table that ``cut`` has written, once nothing reads it any more."""
    if files := table.inputFiles():
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Keep Arrow batches small, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns of the names that an operator adds: its own columns replace them."""
    taken = {n.lower() for n in names}
    return docs.drop(*(c for c in docs.columns if c.lower() in taken))
