"""Quality rules: fixed surface rules, then a calibrated classifier of hashed n-grams.

The classifier is a logistic regression over hashed word and character
n-grams. It is fitted on a bounded sample of labelled rows (``sampling``) in
one task, its probability calibrated on a part of that sample that the fit did not see,
and it scores every text in Arrow batches against a fixed threshold.

Defined cases: a null text has no words and fails the base rules; without
labels of both kinds the classifier keeps everything (probability 1). A
probability equal to the threshold is kept. Texts of any length are read whole,
repeated rows are scored each; an empty table gives no rows. Extra columns are
carried or dropped by name, never matched by position; columns of the names
that ``score`` adds are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sampling, store, text

BITS = 17
#: A text is rejected when its calibrated probability of good quality is below this.
KEEP_FROM = 0.3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CHAR_ORDERS = (2, 3, 4)


def surface(body: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not body:
        return 0, 0, 0, 0, 0
    words = body.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(body) - sum(map(body.count, SPACES))
    symbols = sum(map(body.count, SYMBOLS))
    dup_lines = 0
    if "\n" in body:
        lines = [x for x in body.split("\n") if x.strip(SPACES)]
        dup_lines = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, dup_lines, repeats


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed n-grams of the documents of a slice: for each family, buckets and the documents' bounds."""
    mask = np.uint64((1 << BITS) - 1)
    out, bounds = [], []
    values = text.byte_values(buf)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    roll = text.Rolling(values)
    for k in CHAR_ORDERS:
        h = roll.windows(k)
        ok = np.arange(len(h)) + k <= doc_end[: len(h)]
        out.append((h[ok] & mask).astype(np.int64))
        keep = np.concatenate([[0], np.cumsum(ok)])
        bounds.append(keep[np.minimum(offsets, len(h))])
    words = text.Words(buf, offsets)
    h = words.hashes()
    out.append((text.mix(h + np.uint64(11)) & mask).astype(np.int64))
    bounds.append(words.bounds)
    pair = text.mix(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else h[:0]
    docs = words.docs()
    same = docs[:-1] == docs[1:] if len(h) > 1 else np.zeros(0, bool)
    keep = np.concatenate([[0], np.cumsum(same)])
    out.append((pair[same] & mask).astype(np.int64))
    bounds.append(keep[np.minimum(words.bounds, len(pair))])
    return out, bounds


FAMILIES = len(CHAR_ORDERS) + 2


@dataclass
class Model:
    """Weights by family and bucket, a bias, and the calibration's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        for f, (idx, b) in enumerate(zip(*features(buf, offsets), strict=True)):
            z += text.group_sum(self.weights[f][idx], b) / np.maximum(np.diff(b), 1)
        return z

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        out = np.zeros(len(column))
        for i, j, buf, off in text.slices(*text.buffers(column)):
            out[i:j] = sigmoid(self.slope * self.margins(buf, off) + self.shift)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[str, int]], epochs: int = 60, rate: float = 0.5, l2: float = 1e-6) -> Model:
    """Adagrad on the mean log loss; every fourth row is set aside to calibrate.

    ``rows`` are (text, 0 or 1), 1 for good. Shares of n-grams are kept slice by
    slice, 8 bytes for each bucket of a text, and the gradient is summed over slices.
    """
    y = np.array([int(v) for _, v in rows], float)
    if len(set(y)) < 2:
        return Model(np.zeros((FAMILIES, 1), np.float32), 0.0, constant=1.0)
    size = 1 << BITS
    blocks = []  # first row, end, buckets, shares, bounds of rows
    for i, j, buf, offsets in text.slices(*text.buffers(pa.array([t for t, _ in rows], pa.string()))):
        for f, (idx, bounds) in enumerate(zip(*features(buf, offsets), strict=True)):
            n = np.diff(bounds)
            key, count = np.unique(np.repeat(np.arange(j - i), n) * size + idx, return_counts=True)
            own = key // size
            share = (count / np.maximum(n, 1)[own]).astype(np.float32)
            blocks.append((i, j, (key % size + f * size).astype(np.int32), share, np.searchsorted(own, np.arange(j - i + 1))))
    aside = np.arange(len(rows)) % 4 == 3
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    w, bias = np.zeros(FAMILIES * size, np.float32), 0.0
    seen, seen_b = np.full(w.shape, 1e-8, np.float32), 1e-8
    n = max(1, int((~aside).sum()))
    scale = 30.0  # n-gram shares are small numbers

    def margins() -> np.ndarray:
        z = np.full(len(rows), bias)
        for i, j, c, v, bounds in blocks:
            z[i:j] += text.group_sum(w[c] * v, bounds) * scale
        return z

    for _ in range(epochs):
        err = np.where(aside, 0.0, sigmoid(margins()) - y) / n
        g = l2 * w.astype(float)
        for i, j, c, v, bounds in blocks:
            g += np.bincount(c, weights=np.repeat(err[i:j] * scale, np.diff(bounds)) * v, minlength=len(w))
        seen += (g * g).astype(np.float32)
        w -= (rate * g / np.sqrt(seen)).astype(np.float32)
        gb = err.sum()
        seen_b += gb * gb
        bias -= rate * gb / np.sqrt(seen_b)
    z = margins()
    model = Model((w * np.float32(scale)).reshape(FAMILIES, size), bias)
    if aside.any():
        model.slope, model.shift = platt(z[aside], y[aside])
    return model


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic calibration, by damped Newton steps on smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ a)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, x.T @ (p - t)), -2, 2)
    return float(max(a[0], 1e-3)), float(a[1])


def fit_on_labels(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return sampling.fitted(sampling.labelled_sample(sampling.labels_of(docs, labels, label)), fit)


def score(docs: DataFrame, model: Model, threshold: float = KEEP_FROM) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score, kept.

    All columns of ``docs`` stay, but for those of the new names.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = store.without(docs, *names, "base_failed", "quality_score", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            base = [surface(x) for x in column.to_pylist()]
            failed = [base_failed(b[0], b[4]) for b in base]
            p = shared.value.scores(column)
            cols = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
            kept = ~np.array(failed, bool) & (p >= threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *cols, pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())],
                names=[*batch.schema.names, *names, "base_failed", "quality_score", "kept"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, quality_score double, kept boolean")
