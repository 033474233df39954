"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Entries become whole numbers. Every partition multiplies its rows with
themselves modulo several primes: products of residues below 2**20 are summed
in blocks of 8192 rows, so that a double-precision matrix product is exact.
The residues are added up by Spark, entry by entry; what comes back is a matrix
per prime, whose size depends on the dimension only. Chinese remaindering makes
the exact scatter of them; minus the product of the sums it is the covariance
as a fraction of whole numbers, each entry rounded once to a double, for a
symmetric eigenvalue solver. A row of ones beside the entries gives their sums.

The number of primes follows from the largest entry and the number of rows, so
that the product of the primes is over twice the largest sum there can be.

A second pass over the rows projects them; a third sums the products of what
was projected, to say how far its covariance is from the identity.

Defined cases: vectors that are null or have null or non-finite entries take
no part; shorter vectors end in zeros; repeated rows count each; columns of the
rows are carried by none but ``vec_id``, of any type, null too; a component
whose eigenvalue is not over the rounding of the largest has null ``whitened``
values and no part in ``identity_error`` (0.0 if none has); an empty table, or
one of empty vectors, gives no rows. Entries are at most ``vectors.LARGEST`` in
size, and a ``deviation`` must fit a long; both are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, vectors

COMPONENTS = 32
#: Entries are floor(SCALE * value) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Residues are below 2**20: so many of their products add up to less than 2**53.
PRIME_BITS, BLOCK = 20, 8192
#: The driver holds a matrix per prime, and each task a few: a documented bound of the dimension.
WIDEST = 4096


def primes(product: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS whose product is over ``product``."""
    out, have, p = [], 1, 1 << PRIME_BITS
    while have <= product:
        p -= 1
        if p % 2 and all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            have *= p
    return out


def reconstructed(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Whole numbers (Python's) from their residues, by Chinese remaindering; those over half of the product are negative."""
    product = int(np.prod(np.array(moduli, object)))
    out = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        out += r.astype(object) * (rest * pow(rest, -1, p))
    out %= product
    return np.where(out > product // 2, out - product, out)


def residue_scatter(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Sums of products of the columns of ``x`` modulo each prime: (prime, column, column)."""
    out = np.zeros((len(moduli), x.shape[1], x.shape[1]), np.int64)
    for k, p in enumerate(moduli):
        for at in range(0, len(x), BLOCK):
            part = (x[at : at + BLOCK] % p).astype(np.float64)
            out[k] = (out[k] + (part.T @ part).astype(np.int64)) % p
    return out


@dataclass
class Fit:
    """n rows with sums S, eigenvalues by fall and unit eigenvectors as columns, and their trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), nan where e is not over the rounding of the largest."""
        least = self.values.max(initial=0.0) * len(self.sums) * np.finfo(float).eps
        return np.array([e**-0.5 if e > least else np.nan for e in self.values])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: x - S/n, from the exact n*x - S, on the components."""
        return self.centred(x).astype(np.float64) / self.n @ (self.directions * self.scales)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: in longs where they surely fit, else in Python's whole numbers."""
        largest = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)])
        kind = np.int64 if largest < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, x: np.ndarray) -> list[int]:
        c = self.centred(x)
        if c.dtype != object and x.shape[1] * (int(np.abs(c).max(initial=0)) + 1) ** 2 >= 2**63:
            c = c.astype(object)
        out = (c * c).sum(axis=1).tolist()
        if max(out, default=0) >= 2**63:
            raise ValueError("deviations do not fit a long")
        return out


def entries(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x: the rows that take part, with whole entries."""
    return rows.filter(vectors.finite(F.col(vector))).select("vec_id", vectors.whole(F.col(vector), scale, shift).alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> Fit | None:
    """Exact sums and scatter of the rows of ``entries``, and the eigenvectors of their covariance; None without any entry."""
    top = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    n, width, largest = top[0], top[1] or 0, max(top[2] or 0, abs(shift), 1)
    if not n or not width:
        return None
    if largest > vectors.LARGEST or width > WIDEST:
        raise ValueError(f"entries up to {largest} in {width} dimensions: at most {vectors.LARGEST} in {WIDEST} are offered")
    moduli = primes(2 * n * largest**2)
    store.bound_batches(rows.sparkSession, rows=BLOCK)
    columns = [f"r{k}" for k in range(len(moduli))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), width + 1, width + 1), np.int64)
        for batch in batches:
            x = vectors.matrix(batch.column(0), width, shift)
            total = (total + residue_scatter(np.hstack([x, np.ones((len(x), 1), x.dtype)]), moduli)) % np.array(moduli)[:, None, None]
        if total.any():
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)], names=["i", "j", *columns])

    parts = rows.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in columns))
    sums = parts.groupBy("i", "j").agg(*((F.sum(c) % p).alias(c) for c, p in zip(columns, moduli, strict=True)))
    found = np.zeros((len(moduli), width + 1, width + 1), np.int64)
    for r in sums.toLocalIterator():  # (width + 1)(width + 2) / 2 rows, whatever the table's size
        found[:, r["i"], r["j"]] = found[:, r["j"], r["i"]] = r[2:]
    exact = reconstructed(found, moduli)
    scatter, sums_ = exact[:-1, :-1], exact[:-1, -1]
    whole = n * scatter - np.outer(sums_, sums_)
    square = n * n
    cov = np.array([[v / square for v in row] for row in whole.tolist()])
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    return Fit(n, sums_.tolist(), np.maximum(values[order], 0.0), directions[:, order], int(np.trace(whole)) / square)


def projected(rows: DataFrame, model: Fit, shift: int = SHIFT) -> DataFrame:
    """vec_id, deviation, whitened (an array by component) of each row of ``entries``."""
    width = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), width, shift)
            w = model.project(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.float64(), mask=np.isnan(flat)))],
                names=["vec_id", "deviation", "whitened"],
            )

    store.bound_batches(rows.sparkSession, rows=BLOCK)
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of ``whitened``, over all rows, minus the identity."""
    live = np.flatnonzero(~np.isnan(model.scales))
    if not len(live):
        return 0.0
    width = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            w = np.nan_to_num(vectors.matrix(batch.column(0), width))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        if total.any():
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    found = np.zeros((width + 1, width + 1))
    for r in white.select("whitened").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        found[r["i"], r["j"]] = found[r["j"], r["i"]] = r["s"]
    found /= model.n
    mean = found[:-1, -1]  # the rows are centred already: what is left is their rounding
    cov = (found[:-1, :-1] - np.outer(mean, mean))[np.ix_(live, live)]
    return float(np.abs(cov - np.eye(len(live))).max())


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row that takes part and component."""
    rows = entries(table, vector, scale, shift)
    model = fit(rows, components, shift)
    kind = table.schema["vec_id"].dataType.simpleString()
    if model is None:
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = projected(rows, model, shift)
    error = identity_error(white, model)
    share = F.array(*(F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values))
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
