"""Aligning levels of detail, exact splits, batches, samples, and training bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import random

#: Rows of a range that are numbered by one task.
ROWS_A_RANGE = 2_000_000


def last_wins(rows: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """Of rows with equal keys the last in ``order``; whole rows, so columns never mix."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    by = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")


def common_ids(levels: list[DataFrame], key: str = "obj") -> DataFrame:
    """Ids that every level has."""
    return reduce(DataFrame.intersect, [x.select(key) for x in levels])


def aligned(levels: list[DataFrame], key: str = "obj") -> DataFrame:
    """One row per common id, with a struct of each level's columns: ``lod_0``, ``lod_1``, ..."""
    parts = [x.select(key, F.struct(*(c for c in x.columns if c != key)).alias(f"lod_{k}")) for k, x in enumerate(levels)]
    return reduce(lambda a, b: a.join(session.shuffled(b), key), parts)


def paired_files(detailed: DataFrame, simple: DataFrame) -> DataFrame:
    """Files with a counterpart at the same relative path."""
    return detailed.join(session.shuffled(simple.select("rel_path")), "rel_path", "left_semi")


def pair_objects(detailed: DataFrame, simple: DataFrame) -> DataFrame:
    """obj, rel_path: objects that both files of a pair have. Files (rel_path, CityObjects: a map) pair up by path; of several pairs with an object the last by path stays.

    Ids meet inside the pair's row. A file that did not parse has no objects.
    """
    other = simple.select("rel_path", F.map_keys("CityObjects").alias("__ids"))
    both = detailed.select("rel_path", F.map_keys("CityObjects").alias("ids")).join(session.shuffled(other), "rel_path")
    return last_wins(both.select("rel_path", F.explode(F.array_intersect("ids", "__ids")).alias("obj")), "obj", "rel_path")


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-5:
        raise ValueError("split ratios must sum to 1.0")


def ranked(rows: DataFrame, order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """``rows`` with their rank from 0 in ``order`` as ``name``, or the sum of ``value`` over the rows before; nulls first, without sorting the table in one task.

    Rows are dealt by ranges of the order, sorted and numbered where they are, and kept so (``session.settled``), for ranges are drawn
    from samples; each range is then shifted by those before it, of which there is a row each. There are as many ranges as partitions,
    and more where one would hold over ``ROWS_A_RANGE`` rows. Rows that are equal in ``order`` are of one range.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_RANGE))
    placed = rows.withColumn("__value", F.lit(1) if value is None else value).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = session.settled(placed.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.sum("__value").alias("__n"))
    shifts = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier(Window.orderBy("__range"))), F.lit(0)).alias("__shift"))  # a row a range
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) if value is None else F.coalesce(F.sum("__value").over(earlier(Window.partitionBy("__range").orderBy("__at"))), F.lit(0))
    return placed.withColumn("__in", inside).join(F.broadcast(shifts), "__range").withColumn(name, F.col("__in") + F.col("__shift")).drop("__range", "__at", "__in", "__shift", "__value")


def _ranks(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """``rows`` with ``__rank`` in the order of a hash, then of the key."""
    return ranked(rows.withColumn("__order", order), ["__order", key], "__rank").drop("__order")


def sorted_ranks(rows: DataFrame, order: str, name: str, value: Column | None = None) -> DataFrame:
    """``rows`` with their rank from 0 by the column ``order`` in ``name``, or the sum of ``value`` before them."""
    return ranked(rows, [order], name, value)


def exact_split(rows: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``rows`` with ``part``: train, val or test, of exactly int(r n), int(r n) and the remaining rows."""
    check_ratios(ratios)
    total = rows.count()
    if not total:
        raise ValueError("cannot split an empty dataset")
    train, val = int(ratios[0] * total), int(ratios[1] * total)
    rank = F.col("__rank")
    part = F.when(rank < train, "train").when(rank < train + val, "val").otherwise("test")
    return _ranks(rows, key, random.order(seed, F.col(key))).withColumn("part", part).drop("__rank")


def assign_batches(rows: DataFrame, key: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``rows`` shuffled by seed and epoch, with ``batch`` and ``place`` in it; the last batch may be short."""
    ranked = _ranks(rows, key, random.order(f"{seed}:{epoch}", F.col(key)))
    rank = F.col("__rank")
    return ranked.withColumns({"batch": F.floor(rank / size).cast("long"), "place": (rank % size).cast("long")}).drop("__rank")


def seeded_sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``min(k, n)`` rows without replacement, the same for a seed."""
    return rows.orderBy(random.order(seed, F.col(key)), key).limit(k)


def group_keys(rows: DataFrame, by: str, key: str) -> DataFrame:
    """The keys that each file pair needs, so that a file is read once."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def top_checkpoints(metrics: DataFrame, metric: str, step: str, k: int = 3, mode: str = "min") -> DataFrame:
    """The best ``k`` rows by a metric, earlier steps first on ties, and the last row; ``kept`` tells why."""
    best = metrics.orderBy(F.col(metric).asc() if mode == "min" else F.col(metric).desc(), step).limit(k).withColumn("kept", F.lit("best"))
    last = metrics.orderBy(F.desc(step)).limit(1).withColumn("kept", F.lit("last"))
    return best.unionByName(last)


def early_stop(metrics: DataFrame, metric: str, step: str, by: list[str], patience: int = 10, mode: str = "min") -> DataFrame:
    """Of each run, the step at which ``patience`` validations in a row brought no improvement; null if none did."""
    value = F.col(metric) if mode == "min" else -F.col(metric)
    order = Window.partitionBy(*by).orderBy(step)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = metrics.select(*by, step, value.alias("v"), F.row_number().over(order).alias("n"))
    rows = rows.withColumn("best", F.min("v").over(before))
    rows = rows.withColumn("improved", F.when(F.col("best").isNull() | (F.col("v") < F.col("best")), F.col("n")))
    rows = rows.withColumn("last", F.max("improved").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("n") - F.col("last") >= patience, F.col(step))).alias("stopped_at"))


def learning_rate(epochs: DataFrame, scheduler: str, lr: float = 1e-3, max_epochs: int = 100, decay_steps: int = 50, decay_rate: float = 0.5) -> DataFrame:
    """``epochs`` (epoch) with ``lr``: constant, half a cosine down to 1e-6, or steps."""
    e = F.col("epoch")
    if scheduler == "none":
        value = F.lit(lr)
    elif scheduler == "cosine":
        value = F.lit(1e-6) + (F.lit(lr) - 1e-6) * (1 + F.cos(F.lit(3.141592653589793) * e / max_epochs)) / 2
    elif scheduler == "step":
        value = F.lit(lr) * F.pow(F.lit(decay_rate), F.floor(e / decay_steps))
    else:
        raise ValueError(f"unknown lr scheduler: {scheduler}")
    return epochs.withColumn("lr", value)
