"""Metrics of runs, as tables for the loggers that a configuration names.

Trackers are services or viewers outside this library; their common input is a
table of metric rows, kept as Parquet in a folder for each logger and run.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Checkpoint, Logging
from ..operators import dataset

LOGGERS = ("tensorboard", "wandb", "mlflow")


def folders(settings: Logging) -> dict[str, str]:
    """Where each configured logger's rows go; a name that is not known is an error."""
    out = {}
    for name in settings.loggers:
        if name not in LOGGERS:
            raise ValueError(f"unknown logger: {name}")
        group = settings.project_name if name == "tensorboard" else settings.experiment_name or settings.project_name
        out[name] = "/".join([settings.save_dir.rstrip("/"), name, group, settings.run_name or "default"])
    return out


def log(metrics: DataFrame, settings: Logging) -> None:
    """Append rows of step, name and value to every configured logger's folder."""
    rows = metrics.select(F.col("step").cast("long").alias("step"), "name", F.col("value").cast("double").alias("value"))
    for path in folders(settings).values():
        rows.write.mode("append").parquet(path)


def keep_checkpoints(saved: DataFrame, settings: Checkpoint) -> list[str]:
    """Delete the files of checkpoints that are neither among the best nor the last; the paths that stay.

    ``saved``: step, value of the monitored metric, and path (or URI) of every checkpoint of a run, a few rows.
    """
    rows = dataset.top_checkpoints(saved, "value", "step", settings.save_top_k, settings.mode).collect() if settings.enabled else []
    kept = {r["path"] for r in rows}
    for r in saved.collect():
        if r["path"] not in kept:
            store, path = fs.FileSystem.from_uri(r["path"]) if "://" in r["path"] else (fs.LocalFileSystem(), r["path"])
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)
    return sorted(kept)
