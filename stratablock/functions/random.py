"""Draws that depend only on a seed and keys, so that a plan replays the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 52)


def uniform(seed: int | str, *keys: Column) -> Column:
    """In [0, 1): the first 52 bits of an md5 of the seed and the keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(_SPAN)


def normal(seed: int | str, *keys: Column) -> Column:
    """Box-Muller over two uniforms; the first is kept from 0."""
    u = F.greatest(uniform(f"{seed}a", *keys), F.lit(1 / _SPAN))
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * uniform(f"{seed}b", *keys))


def integer(below: int, seed: int | str, *keys: Column) -> Column:
    return F.floor(uniform(seed, *keys) * below).cast("int")


def order(seed: int | str, *keys: Column) -> Column:
    """A sort key that shuffles rows the same way each time."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
