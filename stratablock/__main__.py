"""Command line: convert a dataset's detailed folder to blocks, or generate buildings from a checkpoint.

    python -m stratablock convert "<dataset>" [--data DIR] [--workers N | --sequential]
    python -m stratablock sample "<dataset>" [--num-objects 30] [--seed 42]
    python -m stratablock generate --config FILE [section.key=value ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from . import config, session
from .operators import dataset, export, network
from .sources import cityjson, sinks


def _convert(args: argparse.Namespace) -> int:
    root = cityjson.find_dataset(args.dataset, [args.data] if args.data else None)
    detailed = cityjson.lod_folder(root, 2)
    spark = session.local_session(1 if args.sequential else args.workers or "*")
    began = time.monotonic()
    done = sinks.convert_or_copy(cityjson.scan_files(spark, detailed), cityjson.simple_folder(detailed))
    counts = sinks.summary(done).orderBy("status").collect()
    done.unpersist()
    for r in counts:
        print(r["status"], r["files"])
    print(f"{sum(r['files'] for r in counts)} files in {time.monotonic() - began:.2f} seconds")
    return int(any(r["status"] == "error" for r in counts))


def _sample(args: argparse.Namespace) -> int:
    """Ids of buildings that both levels have, a seeded sample of them, by file."""
    root = cityjson.find_dataset(args.dataset, [args.data] if args.data else None)
    detailed = cityjson.lod_folder(root, 2)
    spark = session.local_session()
    levels = [cityjson.read_documents(spark, d).withColumnRenamed("file", "rel_path") for d in (detailed, cityjson.simple_folder(detailed))]
    chosen = dataset.seeded_sample(dataset.pair_objects(*levels), "obj", args.num_objects, args.seed)
    for r in dataset.group_keys(chosen, "rel_path", "obj").orderBy("rel_path").collect():
        print(r["rel_path"], *r["keys"])
    return 0


def _generate(args: argparse.Namespace) -> int:
    cfg = config.load(args.config, args.overrides)
    weights = network.load_weights(cfg.inference.checkpoint_path)
    spark = session.local_session()
    found = network.generate(
        spark, weights, cfg.inference.batch_size, cfg.data.n_max or int(weights["n_max"]), cfg.inference.edge_threshold,
        steps=cfg.model.T, kind=cfg.model.discrete_noise_type, classes=cfg.model.num_node_classes, seed=cfg.seed,
    ).cache()
    name = F.concat(F.lit("generated_building_"), F.col("id").cast("string"))
    docs = export.file_names(export.document(found, name), "id")
    sinks.save_documents(docs, cfg.inference.output_dir)
    print(found.count(), "buildings")
    if found.count() > 1:
        whole = export.merge(found.withColumn("name", name).withColumn("all", F.lit(0)), ["all"], "id")
        sinks.save_documents(export.combined(whole, found.withColumn("name", name)), cfg.inference.output_dir)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratablock", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("convert")
    one.add_argument("dataset")
    one.add_argument("--data", type=Path)
    one.add_argument("--sequential", action="store_true")
    one.add_argument("--workers", type=int)
    one.set_defaults(run=_convert)
    two = commands.add_parser("sample")
    two.add_argument("dataset")
    two.add_argument("--data", type=Path)
    two.add_argument("--num-objects", type=int, default=30)
    two.add_argument("--seed", type=int, default=42)
    two.set_defaults(run=_sample)
    three = commands.add_parser("generate")
    three.add_argument("--config", "-c", type=Path, required=True)
    three.add_argument("overrides", nargs="*")
    three.set_defaults(run=_generate)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
