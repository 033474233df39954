"""Writing documents under exact names, and the convert-or-copy job.

What happened to each file comes back as rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rewrite
from . import exact


def save_documents(rows: DataFrame, folder: str | Path, name: str = "file_name", body: str = "json") -> None:
    """Write each row's text under its name: all files, or none if a task fails for good."""
    exact.write(rows.select(F.col(name).alias("name"), F.col(body).alias("body")), str(folder))


def convert_or_copy(files: DataFrame, folder: str | Path) -> DataFrame:
    """rel_path, status, message, body of every file of ``files`` (rel_path, content), of which those without an error are in ``folder`` now.

    The rows stay on the executors' disks, so that the work that was written is the work that is counted; the caller unpersists them.
    """
    done = rewrite.converted_files(files).persist(StorageLevel.DISK_ONLY)
    exact.write(done.select(F.col("rel_path").alias("name"), "body"), str(folder))
    return done


def summary(statuses: DataFrame) -> DataFrame:
    """status, files."""
    return statuses.groupBy("status").agg(F.count("*").alias("files"))


def exit_code(statuses: DataFrame) -> int:
    return int(not statuses.filter("status = 'error'").isEmpty())
