"""Column functions over rings, vectors and class scores. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotated(ring: Column) -> Column:
    """The ring from its second member on, then its first: each member's successor."""
    return F.when(F.size(ring) > 0, F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))).otherwise(ring)


def ring_edges(ring: Column) -> Column:
    """Array of (pos, vid, nxt) in ring order; the last member is followed by the first."""
    pairs = F.arrays_zip(ring.alias("vid"), rotated(ring).alias("nxt"))
    return F.transform(pairs, lambda e, i: F.struct(i.alias("pos"), e["vid"].alias("vid"), e["nxt"].alias("nxt")))


def closed(ring: Column) -> Column:
    """The ring with its first member repeated at the end; an empty ring stays empty."""
    return F.concat(ring, F.slice(ring, 1, 1))


def shoelace(points: Column) -> Column:
    """Signed area of an array of (x, y): positive when counterclockwise; summed in ring order."""
    nxt = rotated(points)
    cross = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(index: Column, size: int) -> Column:
    return F.array(*(F.when(index == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(size)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def silu(z: Column) -> Column:
    return z * sigmoid(z)


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = [F.exp(s - top) for s in scores]
    return [x / reduce(add, e) for x in e]


def log_sum_exp(scores: list[Column]) -> Column:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return top + F.ln(reduce(add, [F.exp(s - top) for s in scores]))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def safe_cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-6)


def safe_name(path: Column) -> Column:
    """Path separators and blanks become underscores."""
    return F.regexp_replace(path, r"[/\\ ]", "_")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it; the optimizer does not write it out again."""
    return F.get(F.transform(F.array(value), f), 0)
