"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of all subwords (byte n-grams of each
word with its boundaries, and the word itself) of all its words; a linear
softmax reads the language from it. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of
labelled rows. A temperature fitted on rows set aside calibrates the
probabilities, and ``reject_below`` marks predictions not to be relied on.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
with no labelled rows every text is ``und``. Of languages that are equally
likely the first in alphabetical order is predicted. Texts of any length are
read whole, repeated rows are predicted each; an empty table gives no rows.
Columns of the names that ``predict`` adds are replaced, others are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling, store, text

BITS, DIM = 16, 16
ORDERS = (1, 2, 3, 4)
#: Predictions under this calibrated probability are rejected.
REJECT_BELOW = 0.5
_LETTER = text.byte_class((0x41, 0x5A), (0x61, 0x7A))


def subwords(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the given words, and each word's bounds among them."""
    n = ends - starts + 2
    bounds = np.concatenate([[0], np.cumsum(n)])
    flat = np.full(bounds[-1], 0x20, np.uint8)  # a space on either side of each word
    inner = np.ones(len(flat), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    src = np.arange(len(flat)) - np.repeat(bounds[:-1] + 1 - starts, n)
    flat[inner] = text.LOWER[buf[src[inner]]]
    roll = text.Rolling(text.byte_values(flat))
    end = np.repeat(bounds[1:], n)
    pieces, owner = [], []
    word_of = np.repeat(np.arange(len(starts)), n)
    mask = np.uint64((1 << BITS) - 1)
    for k in ORDERS:
        h = roll.windows(k)
        ok = np.arange(len(h)) + k <= end[: len(h)]
        if k == 1:
            ok &= inner[: len(h)]
        pieces.append(h[ok])
        owner.append(word_of[: len(h)][ok])
    pieces.append(text.mix(roll.spans(bounds[:-1], bounds[1:]) + np.uint64(5)))
    owner.append(np.arange(len(starts)))
    h, o = np.concatenate(pieces), np.concatenate(owner)
    by = np.argsort(o, kind="stable")
    return (h[by] & mask).astype(np.int64), np.searchsorted(o[by], np.arange(len(starts) + 1))


@dataclass
class Model:
    langs: list[str]
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        # The softmax is linear, so a subword's share of the logits can be looked up at once.
        self.table = (self.embeddings @ self.softmax).astype(np.float32)

    def logits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = text.Words(buf, offsets)
        if not len(words.starts):
            return np.tile(self.bias, (len(offsets) - 1, 1))
        _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        ids, bounds = subwords(buf, words.starts[first], words.ends[first])
        sums = text.group_sum(self.table[ids], bounds)
        sizes = np.diff(bounds)
        total = text.group_sum(sums[back], words.bounds)
        count = text.group_sum(sizes[back], words.bounds)
        return total / np.maximum(count, 1)[:, None] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.3, seed: int = 7) -> Model | None:
    """Stochastic gradient descent, one text a step; every fifth row is set aside for the temperature."""
    langs = sorted({v for _, v in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    w = rng.normal(0, 0.1, (DIM, len(langs)))
    b = np.zeros(len(langs))
    bags = []
    buf, offsets = text.buffers(pa.array([t for t, _ in rows], pa.string()))
    for i, _, part, off in text.slices(buf, offsets, 1):
        words = text.Words(part, off)
        if len(words.starts):
            ids, count = np.unique(subwords(part, words.starts, words.ends)[0], return_counts=True)
            bags.append((ids.astype(np.int32), (count / count.sum()).astype(np.float32), langs.index(rows[i][1])))
    train = [x for i, x in enumerate(bags) if i % 5 != 4]
    aside = [x for i, x in enumerate(bags) if i % 5 == 4]
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            ids, share, y = train[k]
            mean = share @ emb[ids]
            p = softmax((mean @ w + b)[None])[0]
            p[y] -= 1
            lr = rate * (1 - done / steps)
            back = w @ p
            w -= lr * np.outer(mean, p)
            b -= lr * 0.1 * p
            emb[ids] -= (lr * 20 * share)[:, None] * back
            done += 1
    model = Model(langs, emb.astype(np.float32), w, b)
    if aside:
        z = np.array([share @ model.table[ids] + b for ids, share, _ in aside])
        y = np.array([v for _, _, v in aside])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 10, 80), key=loss))
    return model


def fit_on_labels(docs: DataFrame, lang: str = "lang") -> Model | None:
    """``docs``: the rows that may be learned from."""
    return sampling.fitted(sampling.labelled_sample(docs.select("doc_id", "text", F.col(lang).alias("label"))), fit)


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_ = text.group_sum(_LETTER[buf].astype(np.int64), offsets) > 0
    for k in np.flatnonzero(~ascii_):
        ascii_[k] = any(map(str.isalpha, bytes(buf[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")))
    return ascii_


def predict(docs: DataFrame, model: Model | None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without text, with lang_pred, score and rejected; reads only ``text``."""
    spark = docs.sparkSession
    store.bound_batches(spark)
    docs = store.without(docs, "lang_pred", "score", "rejected")
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            for i, j, buf, off in text.slices(*text.buffers(batch.column(batch.schema.get_field_index("text")))):
                if m is None:
                    break
                p = softmax(m.logits(buf, off) / m.temperature)
                ok = has_letter(buf, off)
                lang[i:j][ok] = np.array(m.langs, object)[p.argmax(1)][ok]
                score[i:j][ok] = p.max(1)[ok]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), pa.array(lang, pa.string()), pa.array(score), pa.array(score < reject_below)],
                names=[*(f.name for f in rest), "lang_pred", "score", "rejected"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.mapInArrow(run, fields + "lang_pred string, score double, rejected boolean")


def fold(doc_id: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
