"""A sink that writes each row to a file of its own name: a Spark data source with a commit.

Tasks write to a folder of the write's own below the target. Only when every
task has succeeded are the files moved to their names; a write that fails
leaves the target as it was. What a killed task has left in the write's folder
goes with that folder. Messages to the driver hold counts, not names: the
commit lists a task's folder and moves file by file.

The target is a folder that every executor mounts, or the URI of any store that
Arrow can write to. Rows whose body is null write no file. Of rows with one
name that of the later task stays; inside a task, the later row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

STAGING = ".writing-"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it that a folder's name or URI means."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return store, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    size: int


class ExactWriter(DataSourceWriter):
    def __init__(self, folder: str, name: int, body: int):
        self.target, self.name, self.body = folder, name, body
        self.staging = STAGING + uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        store, root = store_of(self.target)
        context = TaskContext.get()
        own = f"{self.staging}/{context.partitionId():06d}-{context.taskAttemptId()}"
        files = size = 0
        for row in rows:
            body = row[self.body]
            if body is None:
                continue
            data = body.encode() if isinstance(body, str) else bytes(body)
            path = f"{root}/{own}/{row[self.name]}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(data)
            files, size = files + 1, size + len(data)
        return Written(own, files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.target)
        store.create_dir(root, recursive=True)
        for m in sorted((m for m in messages if isinstance(m, Written) and m.files), key=lambda m: m.folder):
            own = f"{root}/{m.folder}"
            for found in store.get_file_info(fs.FileSelector(own, recursive=True)):
                if found.type == fs.FileType.File:
                    path = root + found.path[len(own) :]
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    store.move(found.path, path)
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*store_of(self.target))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class ExactFiles(DataSource):
    """``df.write.format("exact_files").option("path", folder)``: columns ``name`` (a relative path) and ``body`` (string or binary)."""

    @classmethod
    def name(cls) -> str:
        return "exact_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ExactWriter(self.options["path"], schema.names.index("name"), schema.names.index("body"))


def check_folder(spark: SparkSession, folder: str) -> None:
    """Off a local master a path without a scheme would be each executor's own disk."""
    if "://" not in folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"give {folder} as a URI: executors share no local folder")


def write(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (name, body) below ``folder``, all files or none."""
    spark = rows.sparkSession
    check_folder(spark, folder)
    spark.dataSource.register(ExactFiles)
    rows.select("name", "body").write.format("exact_files").option("path", folder).mode("append").save()
