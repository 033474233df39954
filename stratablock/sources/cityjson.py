"""Reading city documents and their folders.

Documents are read whole, with an explicit schema: inference would make a
column of every building id. Boundaries and semantic values stay JSON text,
because their depth depends on the geometry type (``operators.mesh``).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

_GEOMETRY = (
    "struct<type:string,lod:string,boundaries:string,"
    "semantics:struct<surfaces:array<struct<type:string>>,values:string>>"
)
SCHEMA = (
    "type string, vertices array<array<double>>, transform struct<scale:array<double>,translate:array<double>>, "
    f"CityObjects map<string,struct<type:string,geometry:array<{_GEOMETRY}>>>"
)
JSON_FILES = "*.[jJ][sS][oO][nN]"


def lod_folder(dataset: str | Path, lod: int) -> Path:
    """The dataset's folder ``lod<n>``, whatever its case; the first by name."""
    wanted = f"lod{lod}"
    for d in sorted(Path(dataset).iterdir()):
        if d.is_dir() and d.name.lower() == wanted:
            return d
    raise FileNotFoundError(f"no folder for LOD {lod} under {Path(dataset).name}")


def data_folder(roots: list[Path] | None = None) -> Path:
    """The first data folder that exists: beside the package, below the working folder, or beside it."""
    for root in roots or [Path(__file__).resolve().parents[2] / "data", Path.cwd() / "data", Path.cwd().parent / "data"]:
        if root.is_dir():
            return root
    raise FileNotFoundError("no data folder")


def datasets(root: Path) -> list[str]:
    """Names of the datasets in a data folder."""
    return sorted(d.name for d in root.iterdir() if d.is_dir())


def find_dataset(name: str, roots: list[Path] | None = None) -> Path:
    """The dataset's folder under the first data folder that exists, whatever its case."""
    root = data_folder(roots)
    for have in datasets(root):
        if have.lower() == name.lower():
            return root / have
    raise FileNotFoundError(f"no dataset {name!r} in {root}; there are: {', '.join(datasets(root)) or 'none'}")


def simple_folder(detailed: Path) -> Path:
    """Where blocks of a detailed folder go: LOD1 beside an upper-case name, else lod1."""
    return detailed.parent / ("LOD1" if detailed.name.isupper() else "lod1")


def relative(root: str | Path, path: Column) -> Column:
    """The part of a file's path below a folder."""
    base = str(root).removeprefix("file:").rstrip("/") + "/"
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring(decoded, F.instr(decoded, base) + len(base), F.length(decoded))


def read_documents(spark: SparkSession, folder: str | Path) -> DataFrame:
    """file (relative path) and the parsed columns of every JSON file below a folder."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", JSON_FILES).text(str(folder))
    return parse(raw.select(relative(folder, F.col("_metadata.file_path")).alias("file"), "value"))


def parse(raw: DataFrame) -> DataFrame:
    """``raw``: file, value (JSON text). A file that does not parse, or has no vertices, stays with null columns."""
    return raw.select("file", F.from_json("value", SCHEMA).alias("d")).select("file", "d.*")


def broken(documents: DataFrame) -> DataFrame:
    """Files that lack what a document must have, with the reason."""
    reason = F.when(F.col("vertices").isNull(), "no vertices").when(
        F.col("transform").isNotNull() & (F.col("transform.scale").isNull() | F.col("transform.translate").isNull()), "transform without scale or translate"
    )
    return documents.select("file", reason.alias("reason")).filter("reason is not null")


def scan_files(spark: SparkSession, folder: str | Path) -> DataFrame:
    """rel_path, length, content of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder))
    return files.select(relative(folder, F.col("path")).alias("rel_path"), "length", "content")


def file_pairs(spark: SparkSession, detailed: str | Path, simple: str | Path) -> DataFrame:
    """rel_path of JSON files that both folders have."""
    only = lambda d: scan_files(spark, d).select("rel_path").filter(F.lower("rel_path").endswith(".json"))
    return only(detailed).join(session.shuffled(only(simple)), "rel_path", "left_semi")
