import json
import os
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import literals as lit

from stratablock import config
from stratablock.__main__ import main
from stratablock.sources import cityjson, exact, metrics, sinks
from stratablock.streaming import convert


@pytest.fixture
def city(tmp_path):
    folder = tmp_path / "data" / "The Town" / "LOD2" / "sub dir"
    folder.mkdir(parents=True)
    (folder / "a+b.city.json").write_text(lit.text(lit.BOX))
    (folder / "other.JSON").write_text('{"type": "Feature"}')
    (folder / "broken.json").write_text("{")
    (folder / "description.txt").write_bytes(b"\x00\xffnotes")
    return folder.parent


def test_folders(city):
    town = city.parent
    assert cityjson.lod_folder(town, 2) == city and cityjson.simple_folder(city).name == "LOD1"
    assert cityjson.find_dataset("the town", [town.parent]) == town
    for missing in (lambda: cityjson.lod_folder(town, 3), lambda: cityjson.find_dataset("x", [town.parent]), lambda: cityjson.find_dataset("x", [town / "none"])):
        with pytest.raises(FileNotFoundError):
            missing()


def test_convert_or_copy(spark, city):
    target = cityjson.simple_folder(city)
    done = sinks.convert_or_copy(cityjson.scan_files(spark, city), target)
    assert {r.rel_path: r.status for r in done.collect()} == {
        "sub dir/a+b.city.json": "converted", "sub dir/other.JSON": "copied", "sub dir/broken.json": "error", "sub dir/description.txt": "copied",
    }
    assert (target / "sub dir/description.txt").read_bytes() == b"\x00\xffnotes"
    out = json.loads((target / "sub dir/a+b.city.json").read_text())
    assert lit.geometry(out)["lod"] == "1" and len(out["vertices"]) == 12
    assert sinks.exit_code(done) == 1 and {(r.status, r.files) for r in sinks.summary(done).collect()} == {("converted", 1), ("copied", 2), ("error", 1)}
    assert {r.rel_path for r in cityjson.file_pairs(spark, city, target).collect()} == {"sub dir/a+b.city.json", "sub dir/other.JSON"}
    docs = cityjson.read_documents(spark, city)
    assert {r.file for r in docs.collect()} == {"sub dir/a+b.city.json", "sub dir/other.JSON", "sub dir/broken.json"}


def files_below(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_save_documents(spark, tmp_path):
    rows = spark.createDataFrame([("x/building_0000.city.json", '{"a":"é"}'), ("no.json", None), ("y z/+.json", "")], "file_name string, json string")
    sinks.save_documents(rows, tmp_path)
    assert files_below(tmp_path) == {"x/building_0000.city.json": '{"a":"é"}'.encode(), "y z/+.json": b""}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x", "y z"]


def test_rows_written_are_rows_read(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("d%d/%03d.bin", F.col("id") % 7, "id").alias("name"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("body")).repartition(5)
    exact.write(rows, f"file://{tmp_path}")
    back = cityjson.scan_files(spark, tmp_path).select("rel_path", "content").collect()
    assert {r.rel_path: bytes(r.content) for r in back} == {r.name: bytes(r.body) for r in rows.collect()} and len(back) == 500
    exact.write(rows.filter("name = 'd0/000.bin'").withColumn("body", F.lit(b"new")), str(tmp_path))
    assert (tmp_path / "d0/000.bin").read_bytes() == b"new" and len(files_below(tmp_path)) == 500


@pytest.mark.parametrize("how", ["raise", "kill"])
def test_failed_task_leaves_no_file(spark, tmp_path, how):
    """One task dies in the middle; others have written their files by then."""
    (tmp_path / "old").write_bytes(b"stays")

    def fail(frames):
        for f in frames:
            if (f["id"] == 399).any():
                time.sleep(2)
                if how == "raise":
                    raise ValueError("lost")
                os.kill(os.getpid(), 9)
            yield f

    rows = spark.range(400, numPartitions=4).mapInPandas(fail, "id long").select(F.col("id").cast("string").alias("name"), F.lit("x").alias("body"))
    with pytest.raises(Exception, match="lost|crash|exit|abort|fail"):
        exact.write(rows, str(tmp_path))
    assert files_below(tmp_path) == {"old": b"stays"} and len(list(tmp_path.iterdir())) == 1


def test_uncommitted_files_are_cleared(tmp_path):
    writer = exact.ExactWriter(str(tmp_path), 0, 1)
    own = tmp_path / writer.staging / "000000-0"
    own.mkdir(parents=True)
    (own / "half").write_bytes(b"ha")
    writer.abort([None])
    assert list(tmp_path.iterdir()) == []


def test_no_local_folder_on_a_cluster():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:1"

    with pytest.raises(ValueError, match="URI"):
        exact.check_folder(Session, "/data")
    exact.check_folder(Session, "s3://bucket/data")


def test_command_line(spark, city, capsys):
    data = str(city.parent.parent)
    assert main(["convert", "the town", "--data", data]) == 1  # one file is broken
    said = capsys.readouterr().out
    assert "converted 1" in said and "4 files in " in said
    (city / "sub dir/broken.json").unlink()
    assert main(["convert", "the town", "--data", data]) == 0
    capsys.readouterr()
    assert main(["sample", "the town", "--data", data, "--num-objects", "5"]) == 0
    assert "a+b.city.json box" in capsys.readouterr().out
    assert main(["convert", "nowhere", "--data", data]) == 1


def test_streamed_blocks(spark, city, tmp_path):
    query = convert.start(spark, city, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_metrics(spark, tmp_path):
    settings = config.Logging(loggers=["tensorboard", "mlflow"], save_dir=str(tmp_path))
    rows = spark.createDataFrame([(1, "val_coord_mse", 0.5)], "step int, name string, value double")
    metrics.log(rows, settings)
    metrics.log(rows, settings)
    assert spark.read.parquet(metrics.folders(settings)["mlflow"]).count() == 2
    with pytest.raises(ValueError):
        metrics.folders(config.Logging(loggers=["other"]))


def test_best_and_last_checkpoints_stay(spark, tmp_path):
    values = [0.5, 0.2, 0.9, 0.1, 0.3, 0.8]
    rows = []
    for step, value in enumerate(values):
        (tmp_path / f"{step}.npz").write_bytes(b"x")
        rows.append((step, value, str(tmp_path / f"{step}.npz") if step else f"file://{tmp_path}/0.npz"))
    saved = spark.createDataFrame(rows, "step long, value double, path string")
    kept = metrics.keep_checkpoints(saved, config.Checkpoint(save_top_k=2))
    assert kept == [str(tmp_path / f"{k}.npz") for k in (1, 3, 5)] and sorted(p.name for p in tmp_path.iterdir()) == ["1.npz", "3.npz", "5.npz"]


def test_unused_settings_are_accepted(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("trainer:\n  devices: 2\nresume_from: x\nlogging:\n  log_model: true\n  run_name: a\n")
    assert config.load(file).logging.run_name == "a"


def test_config(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("training:\n  max_epochs: 5\ndata:\n  lods: [2]\n  n_max: null\n")
    cfg = config.load(file, ["training.lr=0.5", "model.T=10", "logging.loggers=[wandb, mlflow]"])
    assert (cfg.training.max_epochs, cfg.training.lr, cfg.model.T, cfg.data.lods, cfg.logging.loggers) == (5, 0.5, 10, [2], ["wandb", "mlflow"])
    assert cfg.training.early_stopping.patience == 10 and cfg.data.n_max is None
    for wrong in ("training.max_epochs=many", "data.normalize_coords=3"):
        with pytest.raises(TypeError):
            config.load(file, [wrong])
    with pytest.raises(KeyError):
        config.load(file, ["training.nothing=1"])
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")
