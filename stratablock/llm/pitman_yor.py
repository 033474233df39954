"""Language-model scoring: a hierarchical Pitman-Yor model over words.

Every word, and the start of a text, has a context restaurant of what follows
it; all have the root restaurant over all words as parent, whose customers are
their tables and whose base is uniform over the vocabulary and one unseen word.
Seating is sampled by Gibbs sweeps (``Seating``): all customers of a dish leave
their tables and sit down again, at as many tables as their law says, given all
others as they sit: the ways to seat them by the discount, times the odds of
new tables by the parent's probability. Every customer moves in every sweep.
Tables are averaged over the sweeps after burn-in, and so are predictive
probabilities, which are linear in them; a text's score sums their logarithms,
and perplexity is 10 ** (-score / n_tokens).

Scale: documents are read in blocks of ``BLOCK_TOKENS``. A block sends each of
its different pairs of neighbours once, with its number among what is learned
from, to the shard of the pair's first word (by ranges of its hash). A shard
counts and seats whole restaurants and answers each block with numbers and
tables; tables go on to the shard of the seated word, where the root is
seated. So pairs travel once, as packed arrays, and nothing is dropped or
capped. A word with a large share of all tokens (``hot_words``, from a bounded
sample, at most four a shard) has its restaurant dealt over all shards by the
following word; its totals are summed on the driver. Such a list decides only
where pairs go. While a shard seats, the parent's probability is that of its
own tables, which words dealt by hash make an unbiased sample of all; the
probabilities that are scored use the whole root. How many shards there are
follows from the bytes of text, and draws from the words themselves: scores do
not depend on files, blocks or partitions.

Defined cases: a null or empty text is its end alone; a null in ``learn`` is
False; with nothing to learn from, all words are unseen. Texts of any length are
read whole; repeated rows are learned from and scored each; an empty table gives
no rows. Columns of the names that ``score`` adds are replaced, others are
carried. Words are told apart by 64-bit hashes, the followers of a word by 40 bits.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
ROOT_DISCOUNT, DISCOUNT = 0.5, 0.7
#: Customers of a dish up to which the ways to seat them are counted one by one; turns of a sweep; cells of a working matrix.
EXACT, TURNS, CELLS = 512, 8, 1 << 18
#: Bytes of text a shard has on average.
SHARD_BYTES = 5_000_000
#: Hash of the end of a text.
END = np.uint64(0x0E0E0E0E0E0E0E0F)
BLOCK_TOKENS = 1_000_000
#: Rows that words with a large share of all tokens are found in.
SAMPLE_ROWS = 2000
_LOW = np.uint64(24)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by its end; and the texts' bounds."""
    w = text.Words(text.LOWER[buf], offsets)
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.full(bounds[-1], END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = w.hashes()
    return out, bounds


def contexts(h: np.ndarray, bounds: np.ndarray, end: int | np.uint64) -> np.ndarray:
    """The preceding word of each token; a text begins after an end."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[bounds[:-1]] = end
    return out


@cache
def stirling(d: float) -> np.ndarray:
    """Logarithms of the weights of n customers of a dish at t tables, for n and t up to ``EXACT`` (generalized Stirling numbers)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore"):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.log(np.maximum(n - t * d, 0)) + out[n, 1:])
    return out


@cache
def _shortfall(d: float) -> np.ndarray:
    """What log weights at ``EXACT`` customers lack of their law for endlessly many, by tables less one."""
    t = np.arange(1, EXACT + 1)
    steps = np.concatenate([[0.0], np.cumsum(np.log(t[:-1] * d))])
    return stirling(d)[EXACT, 1:] + steps - (math.lgamma(EXACT - d) - math.lgamma(1 - d))


def uniform(names: np.ndarray, *salt: int) -> np.ndarray:
    """Draws that depend on names alone."""
    h = names
    for k in salt:
        h = text.mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Seating:
    """Restaurants with dishes of ``n`` customers each, seated by blocks: all customers of a dish leave and sit down again.

    How many tables they then have is drawn from its law given all others as they sit: the weight of t tables is the number of ways to
    seat n customers at them, by the discount, times the odds of t new tables, each by the parent's probability. That holds for any n;
    beyond ``EXACT`` customers the number of ways comes from that of ``EXACT``, at the same share of n ** d tables (ratios within 2 %).
    Dishes come by turns, ``TURNS`` a sweep, so that they see each other's tables.

    ``parent``: each dish's probability above; ``name``: of each dish, what its draws depend on; ``scale``: how many times its own tables
    a restaurant has in all, where it holds only a part of it.
    """

    def __init__(self, n: np.ndarray, where: np.ndarray, restaurants: int, parent: np.ndarray, d: float, name: np.ndarray, scale: np.ndarray | float = 1.0, strength: float = STRENGTH):
        self.d, self.strength = d, strength
        self.where_all, self.restaurants = where, restaurants
        self.scale = np.broadcast_to(np.asarray(scale, float), (restaurants,))
        self.t = np.minimum(n, 1).astype(np.int64)
        self.total = np.bincount(where, self.t, restaurants)
        # only dishes of several customers move; those of like size together
        live = np.flatnonzero(n > 1)
        self.live = live[np.argsort(n[live], kind="stable")]
        self.n = n[self.live].astype(np.int64)
        self.at, self.parent, self.name = where[self.live], np.minimum(parent[self.live], 1 - 1e-9), name[self.live]
        widths = [*(2**k for k in range(1, EXACT.bit_length())), np.iinfo(np.int64).max]
        ends = np.searchsorted(self.n, widths, side="right").tolist()
        self.groups = [(w, x, y) for w, x, y in zip(widths, [0, *ends], ends, strict=False) if y > x]
        self.sweeps = 0

    def _tables(self, q: np.ndarray, width: int, u: np.ndarray) -> np.ndarray:
        """Tables drawn for dishes of at most ``width`` customers."""
        others = self.scale[self.at[q]] * self.total[self.at[q]] - self.t[self.live[q]]
        base, p = self.strength / self.d + others, self.d * self.parent[q]
        log = np.cumsum(np.log((base[:, None] + np.arange(width)) * p[:, None]), axis=1)
        log += stirling(self.d)[self.n[q], 1 : width + 1]
        log -= log.max(axis=1, keepdims=True)
        weight = np.cumsum(np.exp(log, out=log), axis=1, out=log)
        return 1 + (weight < u[:, None] * weight[:, -1:]).sum(axis=1)

    def _many(self, k: int, u: float) -> int:
        """Tables drawn for a dish of more than ``EXACT`` customers."""
        n, p = int(self.n[k]), float(self.parent[k])
        base = self.strength / self.d + self.scale[self.at[k]] * self.total[self.at[k]] - self.t[self.live[k]]
        # for endlessly many customers the tables beyond the first are negative binomial, which bounds where the weight lies
        mean = (base + 1) * p / (1 - p)
        most = int(min(n, mean + 12 * math.sqrt(mean / (1 - p)) + 60))
        i = np.arange(1, most)
        log = np.concatenate([[0.0], np.cumsum(np.log((base + i) * p / i))])
        lack = _shortfall(self.d)
        x = np.arange(most) * (EXACT / n) ** self.d
        short = np.interp(x, np.arange(EXACT), lack)
        log += np.where(x < EXACT - 1, short, lack[-1] + (x - EXACT + 1) * (lack[-1] - lack[-2]))
        weight = np.cumsum(np.exp(log - log.max()))
        return 1 + int(np.searchsorted(weight, u * weight[-1]))

    def sweep(self) -> None:
        """Every customer of every dish leaves and sits down again."""
        self.sweeps += 1
        u, turn = uniform(self.name, 2 * self.sweeps), (uniform(self.name, 2 * self.sweeps + 1) * TURNS).astype(np.int64)
        for k in range(TURNS):
            for width, x, y in self.groups:
                q = x + np.flatnonzero(turn[x:y] == k)
                if width > EXACT:
                    for j in q.tolist():
                        self._sit(np.array([j]), np.array([self._many(j, u[j])]))
                    continue
                step = max(CELLS // width, 1)
                for i in range(0, len(q), step):
                    part = q[i : i + step]
                    self._sit(part, self._tables(part, width, u[part]))

    def _sit(self, q: np.ndarray, tables: np.ndarray) -> None:
        change = tables - self.t[self.live[q]]
        self.t[self.live[q]] = tables
        np.add.at(self.total, self.at[q], change)


def gibbs(seating: Seating, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish and of each restaurant, summed over the sweeps after burn-in."""
    t, total = np.zeros(len(seating.t), np.int64), np.zeros(seating.restaurants)
    for k in range(burn_in + samples):
        seating.sweep()
        if k >= burn_in:
            t += seating.t
            total += seating.total
    return t, total


@dataclass
class Hot:
    """Words with a large share of all tokens, ascending, and over how many shards the restaurant of each is dealt."""

    words: np.ndarray
    parts: np.ndarray


@dataclass
class Block:
    """Tokens of some documents: the different words, ascending, and each token's place among them.

    Different pairs come in order of their shards; ``hot`` ones last, in order of theirs.
    """

    words: np.ndarray
    place: np.ndarray
    bounds: np.ndarray

    def __post_init__(self) -> None:
        end = int(np.searchsorted(self.words, END))
        size = len(self.words)
        key = contexts(self.place, self.bounds, end).astype(np.int64) * size + self.place
        self.pairs, self.back = np.unique(key, return_inverse=True)
        self.u, self.w = self.pairs // size, self.pairs % size

    def order(self, hot: Hot, shards: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Pairs in order; how many are not of hot words; and the shards of those that are."""
        known = _among(hot.words, self.words)
        is_hot = known[self.u]
        plain, busy = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        first, follower = self.words[self.u[busy]], self.words[self.w[busy]]
        parts = hot.parts[np.searchsorted(hot.words, first)]
        shard = (_shard(first, shards) + ((follower >> _LOW) % parts.astype(np.uint64)).astype(np.int64)) % shards
        by = np.argsort(shard, kind="stable")
        return np.concatenate([plain, busy[by]]), len(plain), shard[by]


def _among(some: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(some, words), len(some) - 1)
    return some[at] == words


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    """By ranges of the hash: words in order are in order of their shards."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def _unpacked(raw: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _ascending(words: np.ndarray) -> np.ndarray:
    """Differences of ascending hashes: their high bytes are alike."""
    return np.diff(words, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _hashes(packed: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(packed.T).view(np.uint64).ravel(), dtype=np.uint64)


def _low(words: np.ndarray) -> np.ndarray:
    """40 bits of hashes, a byte a row."""
    return np.ascontiguousarray((words >> _LOW).view(np.uint8).reshape(-1, 8)[:, :5])


def _high(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :5] = packed
    return out.view(np.uint64).ravel()


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Name, rows, token hashes and bounds of each block of a task; the same whenever the task reads the same rows.

    The name is a hash of the tokens in order; equal blocks get equal answers.
    """
    rows, hashes, ends, n = [], [], [], 0

    def block() -> tuple:
        h = np.concatenate(hashes)
        name = text.mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        return int(name.view(np.int64)), rows, h, np.concatenate([[0], *ends])

    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i, j, buf, off in text.slices(*text.buffers(batch.column(at))):
            h, bounds = tokens(buf, off)
            rows.append(batch.slice(i, j - i).drop_columns(["text"]))
            hashes.append(h)
            ends.append(bounds[1:] + n)
            n += len(h)
            if n >= size:
                yield block()
                rows, hashes, ends, n = [], [], [], 0
    if rows:
        yield block()


_ROWS = "kind int, part int, block long, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, block, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], names=["kind", "part", "block", "body"])


def hot_words(docs: DataFrame, shards: int, many: int, rows: int = SAMPLE_ROWS) -> Hot:
    """Words with more than a quarter of a shard's share of the tokens of a sample of some ``rows`` of ``many`` rows, chosen by a hash of their text.

    Each is dealt over as many shards as it has quarters: over all words, five for each shard at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text.slices(*text.buffers(batch.column(0))):
                w, n = np.unique(tokens(buf, off)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(max(many, 1))) < rows).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = some.orderBy(F.desc("n"), "word").limit(4 * shards + 1).collect()
    total = some.agg(F.sum("n")).first()[0] or 0
    return hot_of({r["word"]: r["n"] * 4 * shards / total for r in top if r["n"] * 4 * shards > total}, shards)


def hot_of(quarters: dict[int, float], shards: int) -> Hot:
    """From the signed hashes of words and how many quarters of a shard's share each has."""
    words = np.array(list(quarters), np.int64).view(np.uint64)
    by = np.argsort(words)
    return Hot(words[by], np.minimum(np.ceil(np.array(list(quarters.values()), float)), shards).astype(np.int64)[by])


#: Kinds of rows between the steps.
ASKED, TOLD, TABLES, WORDS, TOTALS, ROOT, BODY = range(7)


def _asking(hot: Hot, shards: int, size: int):
    """Rows of text and learn to messages of their blocks to each shard: words, how many pairs each begins, followers, and how often they are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows, h, bounds in _blocks(batches, size):
            learn = np.concatenate([r.column(r.schema.get_field_index("learn")).fill_null(False).to_numpy(zero_copy_only=False) for r in rows])
            b = Block(*np.unique(h, return_inverse=True), bounds)
            n = np.bincount(b.back, np.repeat(learn, np.diff(bounds)), len(b.pairs)).astype(np.int32)
            order, plain, busy = b.order(hot, shards)
            known = _among(hot.words, b.words)
            own = np.flatnonzero(~known)
            cuts = np.searchsorted(_shard(b.words[own], shards), np.arange(shards + 1))
            each = np.bincount(b.u[order[:plain]], minlength=len(b.words))[own]
            pair = np.concatenate([[0], np.cumsum(each)])
            late = np.searchsorted(busy, np.arange(shards + 1)) + plain
            out = []
            for s in range(shards):
                x, y = cuts[s], cuts[s + 1]
                p, q, i, j = pair[x], pair[y], late[s], late[s + 1]
                if y > x or j > i:
                    mine = np.concatenate([order[p:q], order[i:j]])
                    busy_u = b.words[b.u[order[i:j]]]
                    body = _packed(_ascending(b.words[own[x:y]]), each[x:y].astype(np.int32), np.searchsorted(hot.words, busy_u).astype(np.int32), _low(b.words[b.w[mine]]), n[mine])
                    out.append((ASKED, s, name, body))
            yield _batch(out)

    return run


def _restaurants(hot: Hot, shards: int, seed: int, d: float = DISCOUNT):
    """A shard's messages to answers: numbers and tables of pairs and contexts, tables by follower, words asked for, and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, asked = None, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(1)[k].as_py()
                names.append(batch.column(2)[k].as_py())
                asked.append(_unpacked(batch.column(3)[k].as_py()))
        if not names:
            return
        by = np.argsort(np.array(names), kind="stable").tolist()  # the same order in every run
        names, asked = [names[k] for k in by], [asked[k] for k in by]
        words = [_hashes(a[0]) for a in asked]
        u = np.concatenate([np.concatenate([np.repeat(x, a[1]), hot.words[a[2]]]) for x, a in zip(words, asked, strict=True)])
        w = _high(np.concatenate([a[3] for a in asked]))
        n = np.concatenate([a[4] for a in asked]).astype(np.int64)
        # dishes: different pairs, in the order of their names
        named, first, back = np.unique(text.mix(u) ^ text.mix(w + np.uint64(1)), return_index=True, return_inverse=True)
        back = back.astype(np.int32)
        count = np.bincount(back, n).astype(np.int64)
        u, w = u[first], w[first]
        sizes = [len(a[4]) for a in asked]
        packed = [a[0] for a in asked]
        del asked, n, first
        context, where = np.unique(u, return_inverse=True)
        dish = np.flatnonzero(count)
        follower, which = np.unique(w[dish], return_inverse=True)
        del u, w
        c = count[dish]
        seen = np.bincount(which)
        parent = (seen - ROOT_DISCOUNT + (STRENGTH + ROOT_DISCOUNT * len(seen)) / (len(seen) + 1)) / (STRENGTH + len(c)) if len(c) else np.zeros(0)
        is_hot = _among(hot.words, context)
        scale = np.ones(len(context))
        scale[is_hot] = hot.parts[np.searchsorted(hot.words, context[is_hot])]
        t, tables = gibbs(Seating(c, where[dish], len(context), parent[which], d, named[dish] + np.uint64(seed), scale))
        all_t = np.zeros(len(count), np.int64)
        all_t[dish] = t
        size = np.bincount(where, count, len(context)).astype(np.int64)
        out, at = [], 0
        for name, x, m, raw in zip(names, words, sizes, packed, strict=True):
            mine = back[at : at + m]
            here = np.searchsorted(context, x)
            out.append((TOLD, part, name, _packed(d, count[mine].astype(np.int32), all_t[mine].astype(np.int32), size[here].astype(np.int64), tables[here].astype(np.int64))))
            out.append((WORDS, part, name, _packed(raw)))
            at += m
        to = _shard(follower << _LOW, shards)
        sums = np.bincount(which, t).astype(np.int64) if len(c) else np.zeros(0, np.int64)
        cuts = np.searchsorted(to, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            x, y = cuts[s], cuts[s + 1]
            out.append((TABLES, s, 0, _packed(_ascending(follower[x:y] << _LOW), sums[x:y])))
        busy, own = np.flatnonzero(is_hot), ~is_hot
        totals = (np.searchsorted(hot.words, context[busy]), size[busy], d * tables[busy], int((size[own] > 0).sum()), int(size[own].sum()), int(t.sum()))
        out.append((TOTALS, part, 0, _packed(*totals)))
        for k in range(0, len(out), 200):
            yield _batch(out[k : k + 200])

    return run


def _root(seed: int, types: int):
    """A shard's tables by word, seated in the root: customers and tables of the words that blocks ask for, and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, sums, asked = None, [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                kind, part, block, body = (batch.column(i)[k].as_py() for i in range(4))
                if kind == TABLES:
                    w, n = _unpacked(body)
                    words.append(_hashes(w))
                    sums.append(n)
                else:
                    asked.append((block, body))
        if part is None:
            return
        none = np.zeros(0, np.int64)
        word, back = np.unique(np.concatenate([none.view(np.uint64), *words]), return_inverse=True)
        total = np.bincount(back, np.concatenate([none, *sums]), len(word))
        customers = np.maximum(1, np.rint(total / SAMPLES)).astype(np.int64)
        # its words stand for all: the root has as many times its tables as there are words
        scale = types / max(len(word), 1)
        even = np.full(len(word), 1 / (types + 1))
        t, _ = gibbs(Seating(customers, np.zeros(len(word), np.int64), 1, even, ROOT_DISCOUNT, text.mix(word) + np.uint64(seed + 7), scale))
        out = [(TOTALS, part, 0, _packed(int(customers.sum()), int(t.sum())))]
        for block, body in sorted(asked):
            x = (_hashes(_unpacked(body)[0]) >> _LOW) << _LOW
            at = np.minimum(np.searchsorted(word, x), max(len(word) - 1, 0))
            has = word[at] == x if len(word) else np.zeros(len(x), bool)
            told = [np.where(has, v[at], 0).astype(np.int32) if len(word) else np.zeros(len(x), np.int32) for v in (customers, t)]
            out.append((ROOT, part, block, _packed(*told)))
        yield _batch(out)

    return run


#: The block under whose name hot words are asked of the root: no message of a block has them.
_HOT = -1


def _hot_asked(hot: Hot, shards: int) -> list[tuple]:
    where = _shard(hot.words, shards)
    return [(WORDS, s, _HOT, _packed(_ascending(hot.words[where == s]))) for s in np.unique(where).tolist()]


@dataclass
class Totals:
    """What a block needs beside its answers."""

    hot: Hot  # words, their tokens, discounts times tables summed over samples, and root customers and tables
    hot_n: np.ndarray
    hot_back: np.ndarray
    hot_c: np.ndarray
    hot_t: np.ndarray
    types: int
    tokens: int
    customers: int = 0
    tables: int = 0

    @classmethod
    def of(cls, hot: Hot, shards: list[tuple]) -> Totals:
        """Of what the shards tell of hot words, and of how many words and tokens they have."""
        size, back = np.zeros(len(hot.words), np.int64), np.zeros(len(hot.words))
        for words, n, t, *_ in shards:
            np.add.at(size, words, n)
            np.add.at(back, words, t)
        zero = np.zeros(len(hot.words))
        return cls(hot, size, back, zero.copy(), zero.copy(), sum(r[3] for r in shards) + int((size > 0).sum()), sum(r[4] for r in shards) + int(size.sum()))

    def add_root(self, rows: list[tuple[int, int, tuple]], shards: int) -> None:
        """What the root's shards tell: their sums, and customers and tables of hot words."""
        where = _shard(self.hot.words, shards)
        for kind, part, told in rows:
            if kind == TOTALS:
                self.customers += told[0]
                self.tables += told[1]
            else:
                self.hot_c[where == part], self.hot_t[where == part] = told

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def root(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Probabilities of words with ``c`` customers and ``t`` tables (over samples) in the root."""
        under = STRENGTH + self.customers
        new = (STRENGTH + ROOT_DISCOUNT * self.tables / SAMPLES) / under
        return (c - ROOT_DISCOUNT * t / SAMPLES) / under + new / (self.types + 1)


def _scored(told: list[tuple[int, int, bytes]], b: Block, totals: Totals, shards: int) -> tuple[np.ndarray, ...]:
    """Of each token: how often its word is learned from, and log10 of its probability."""
    order, plain, busy = b.order(totals.hot, shards)
    known = _among(totals.hot.words, b.words)
    own = np.flatnonzero(~known)
    ends = np.searchsorted(_shard(b.words[own], shards), np.arange(shards + 1))
    pair_ends = np.concatenate([[0], np.cumsum(np.bincount(b.u[order[:plain]], minlength=len(b.words))[own])])
    late = np.searchsorted(busy, np.arange(shards + 1)) + plain
    n, t, d = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order))
    size, back = np.zeros(len(b.words), np.int64), np.zeros(len(b.words))
    c0, t0 = np.zeros(len(b.words)), np.zeros(len(b.words))
    at = np.searchsorted(totals.hot.words, b.words[known])
    size[known], back[known] = totals.hot_n[at], totals.hot_back[at]
    c0[known], t0[known] = totals.hot_c[at], totals.hot_t[at]
    answers = {(kind, s): body for kind, s, body in told}
    for s in range(shards):
        x, y = ends[s], ends[s + 1]
        i, j = late[s], late[s + 1]
        if y == x and j == i:
            continue
        if (TOLD, s) not in answers or (ROOT, s) not in answers:
            raise RuntimeError("a block lacks an answer: its rows were not read in the same order again")
        dd, num, tab, own_n, own_t = _unpacked(answers[TOLD, s])
        p, q = pair_ends[x], pair_ends[y]
        for into, values in ((n, num), (t, tab)):
            into[p:q], into[i:j] = values[: q - p], values[q - p :]
        d[p:q] = d[i:j] = dd
        size[own[x:y]], back[own[x:y]] = own_n, dd * own_t
        c0[own[x:y]], t0[own[x:y]] = _unpacked(answers[ROOT, s])
    u, w = b.u[order], b.w[order]
    weight = (STRENGTH + back / SAMPLES) / (STRENGTH + size)
    p = (n - d * t / SAMPLES) / (STRENGTH + size[u]) + weight[u] * totals.root(c0, t0)[w]
    log = np.empty(len(order))
    log[order] = np.log10(p)
    return size[b.place], log[b.back]


def score(docs: DataFrame, learn: str = "learn", seed: int = 11, block_tokens: int = BLOCK_TOKENS, stable: bool = False, discount: float = DISCOUNT) -> tuple[DataFrame, int]:
    """``docs`` without text, with n_tokens, n_known, base_score and score; and the number of tokens learned from.

    The model learns from rows where the Boolean column ``learn`` is true, and
    scores all. ``docs`` is read twice in the same order: unless ``stable`` says
    that it will be (a scan of files), it is written as a table first.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    docs = store.without(docs, "n_tokens", "n_known", "base_score", "score")
    docs = docs if stable else store.cut(docs, "scored")
    docs = docs.withColumn("learn", F.col(learn)) if learn != "learn" else docs
    many, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = -(-(size or 1) // SHARD_BYTES)  # by the data alone, as what a shard knows of the root depends on it
    hot = hot_words(docs, shards, many)
    asked = docs.select("text", "learn").mapInArrow(_asking(hot, shards, block_tokens), _ROWS)
    told = store.cut(asked.repartitionById(shards, "part").mapInArrow(_restaurants(hot, shards, seed, discount), _ROWS), "told")
    totals = Totals.of(hot, [_unpacked(r["body"]) for r in told.filter(F.col("kind") == TOTALS).collect()])
    to_root = told.filter(F.col("kind").isin(TABLES, WORDS)).unionByName(spark.createDataFrame(_hot_asked(hot, shards), _ROWS))
    root = store.cut(to_root.repartitionById(shards, "part").mapInArrow(_root(seed, totals.types), _ROWS), "root")
    few = root.filter((F.col("kind") == TOTALS) | (F.col("block") == _HOT)).collect()
    totals.add_root([(r["kind"], r["part"], _unpacked(r["body"])) for r in few], shards)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    dropped = learn == "learn"
    kept = [f for f in rest if f.name != "learn" or dropped]

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held, h, bounds in _blocks(batches, block_tokens):
            words, place = np.unique(h, return_inverse=True)
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield _batch([(BODY, 0, name, _packed(sink.getvalue().to_pybytes(), _ascending(words), place.astype(np.int32).view(np.uint8).reshape(-1, 4).T.copy(), bounds))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answers = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                kind, part, block, body = (batch.column(i)[k].as_py() for i in range(4))
                if block != at:
                    at, answers = block, []
                if kind != BODY:
                    answers.append((kind, part, body))
                    continue
                raw, words, place, bounds = _unpacked(body)
                place = np.ascontiguousarray(place.T).view(np.int32).ravel()
                count, log = _scored(answers, Block(_hashes(words), place, bounds), totals, shards)
                added = [
                    pa.array(np.diff(bounds)), pa.array(text.group_sum((count > 0).astype(np.int64), bounds)),
                    pa.array(text.group_sum(totals.base(count), bounds)), pa.array(text.group_sum(log, bounds)),
                ]
                table = pa.ipc.open_stream(raw).read_all().select([f.name for f in kept]).combine_chunks()
                own = table.to_batches()[0] if table.num_columns else None
                yield pa.RecordBatch.from_arrays([*(own.columns if own else []), *added], names=[*(f.name for f in kept), "n_tokens", "n_known", "base_score", "score"])

    answers = told.filter(F.col("kind") == TOLD).unionByName(root.filter((F.col("kind") == ROOT) & (F.col("block") != _HOT)))
    every = answers.unionByName(docs.select("text", *(f.name for f in rest)).mapInArrow(bodies, _ROWS))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    out = (
        every.repartition(4 * store.partitions(spark), "block")  # a block or two a task
        .sortWithinPartitions("block", "kind")
        .select("kind", "part", "block", "body")
        .mapInArrow(finish, fields + "n_tokens long, n_known long, base_score double, score double")
    )
    return out, totals.tokens
