"""SentencePiece encoding and decoding for merge-type vocabularies.

A normalised text starts as a sequence of characters. All adjacent pairs whose
concatenation is a piece stand on an agenda ordered by score, ties by position;
the first pair is merged, its neighbours' pairs go on the agenda, and pairs
whose symbols have changed meanwhile are passed over, until none is left.
Symbols that are no piece become bytes.

No piece of the usual vocabularies has a word mark after another character, so
no merge ever joins the end of one word and the mark of the next: each word has
an agenda of its own, and a batch runs it once for each different word. Where a
vocabulary has such a piece, the whole text is one word. The agendas of a
batch's short words are one array of (score, position) keys: each round takes
the first entry of every word, merges it and renews the entries beside it. A
long word has a heap. What a batch has encoded is held against the
sentencepiece library: every new word, by the ids that the library gives it.

The model travels to the tasks as its bytes (bounded: a vocabulary file).

Defined cases: a null or empty text has the begin and end ids only and decodes
to an empty text; repeated rows are encoded each; texts of any length are
encoded whole; an empty table gives no rows; columns of the names that
``encode`` adds are replaced, others are carried.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from . import store

VOCABULARY = "piece_bpe_32k"
#: The mark of a space in pieces.
MARK = "▁"
#: Words kept with their ids by a task; words of more characters have a heap of their own, and are not kept.
KEPT_WORDS, SHORT = 300_000, 48
#: Fixed values of the model's format: kinds of pieces, and the kind of model that merges.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
_NONE = np.iinfo(np.int64).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message; 4-byte and 8-byte values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


def pack(ids: list[int]) -> bytes:
    """Unsigned 32-bit integers, little-endian."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Model:
    """A merge-type model; ``processor`` is the library's, for normalising, decoding and checks."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.begin, self.end, self.unknown = self.processor.bos_id(), self.processor.eos_id(), self.processor.unk_id()
        scores, kinds = [], []
        model_type = 1
        self.kinds = kinds
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
        if model_type != MERGES:
            raise ValueError("not a merge-type vocabulary")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not offered")
        names = [self.processor.id_to_piece(k) for k in range(len(kinds))]
        self.rank = {n: (-s, k) for k, (n, s, kind) in enumerate(zip(names, scores, kinds, strict=True)) if kind == NORMAL}
        self.reserved = {n: k for k, (n, kind) in enumerate(zip(names, kinds, strict=True)) if kind != NORMAL}
        self.bytes = [self.reserved[f"<0x{b:02X}>"] for b in range(256)] if BYTE in kinds else None
        self._tables(names)
        joined = any(MARK in n.lstrip(MARK) for n in self.rank)
        #: Does the library put a mark before every text?
        self.marked = self.processor.normalize("a") == MARK + "a"
        self._word = re.compile(r"(?s).+" if joined else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._plain = self.marked and not joined
        self.known: dict[str, bytes] = {}

    def _tables(self, names: list[str]) -> None:
        """Symbols as numbers: pieces have their ids, other characters follow; pairs that make a piece, sorted."""
        n = len(names)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        if self.bytes:  # a character of one byte that is no piece
            self.symbol[:128] = self.bytes[:128]
        for piece, k in [*self.reserved.items(), *((p, k) for p, (_, k) in self.rank.items())]:
            if len(piece) == 1:
                self.symbol[ord(piece)] = k
        number = lambda s: self.rank[s][1] if s in self.rank else int(self.symbol[ord(s)]) if len(s) == 1 else None
        pairs = [(a << 32 | b, score, k) for p, (score, k) in self.rank.items() for i in range(1, len(p)) if (a := number(p[:i])) is not None and (b := number(p[i:])) is not None]
        table = np.array(sorted(pairs) or [(0, 0.0, 0)], object)
        self.pairs, self.made = table[:, 0].astype(np.int64), table[:, 2].astype(np.int64)
        self.order = np.unique(table[:, 1].astype(np.float64), return_inverse=True)[1].astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; -1 where it makes no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def short_ids(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words, from one agenda for all: each round merges the first pair of every word that has one."""
        out: dict[str, bytes] = {}
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), sizes)
        pair = np.full(len(sym), -1)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self._found(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = np.where(pair >= 0, self.order[pair] << 32 | np.arange(len(sym)), _NONE)
            first = np.minimum.reduceat(key, starts)
            go = np.repeat(first < _NONE, np.diff(np.r_[starts, len(sym)]))
            done.append((word[~go], sym[~go]))
            at = first[first < _NONE] & 0xFFFFFFFF
            sym[at] = self.made[pair[at]]
            go[at + 1] = False
            moved = np.cumsum(go) - 1
            sym, word, pair, at = sym[go], word[go], pair[go], moved[at]
            for left in (at[at > 0] - 1, at):
                near = left[left + 1 < len(sym)]
                same = word[near] == word[near + 1]
                pair[left] = -1
                pair[near[same]] = self._found(sym[near[same]], sym[near[same] + 1])
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int),) * 2
        by = np.argsort(word, kind="stable")
        flat, ends = sym[by], np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        packed = flat.astype("<u4").tobytes()
        odd = set(word[sym >= len(self.kinds)].tolist())
        at = 0
        for k, (w, end) in enumerate(zip(words, ends, strict=True)):
            out[w] = self._ids([x if x < len(self.kinds) else chr(x - len(self.kinds)) for x in flat[at:end].tolist()]) if k in odd else packed[4 * at : 4 * end]
            at = end
        return out

    def merged(self, word: str) -> list[str]:
        """The symbols of a normalised word after all merges."""
        symbols, rank = list(word), self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(found[0], k, k + 1, 2) for k in range(n - 1) if (found := rank.get(symbols[k] + symbols[k + 1]))]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbols[left], symbols[right] = a + b, ""
            k = after[left] = after[right]
            if k < n:
                before[k] = left
                if found := rank.get(symbols[left] + symbols[k]):
                    heapq.heappush(agenda, (found[0], left, k, size + len(symbols[k])))
            k = before[left]
            if k >= 0 and (found := rank.get(symbols[k] + symbols[left])):
                heapq.heappush(agenda, (found[0], k, left, size + len(symbols[k])))
        return [s for s in symbols if s]

    def word_ids(self, word: str) -> bytes:
        """Packed ids of a word, from a heap of its own."""
        return self._ids([self.rank[s][1] if s in self.rank else s for s in self.merged(word)])

    def _ids(self, symbols: list[int | str]) -> bytes:
        """Ids of symbols, of which those that are no piece are given as characters."""
        out: list[int] = []
        for s in symbols:
            if isinstance(s, int):
                out.append(s)
            elif s in self.reserved:
                out.append(self.reserved[s])
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return pack(out)

    def words(self, normal: str) -> list[str]:
        """The words of a normalised text, from mark to mark."""
        if self._plain and MARK * 2 not in normal and normal[-1:] != MARK:
            return [MARK + w for w in normal.split(MARK)[1:]]
        return self._word.findall(normal)

    def encode(self, texts: list[str], checked: bool = True) -> list[np.ndarray]:
        """Ids of each text with the begin and end ids; ``checked``: new words are held against the library."""
        split = [self.words(t) for t in self.processor.normalize(texts)]
        words = set(chain.from_iterable(split))
        if len(self.known) > KEPT_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        ids = self.short_ids([w for w in new if len(w) <= SHORT]) | {w: self.word_ids(w) for w in new if len(w) > SHORT}
        if checked:
            self.check(ids)
        self.known |= ids
        begin, end = pack([self.begin]), pack([self.end])
        out = [np.frombuffer(b"".join([begin, *map(self.known.__getitem__, words), end]), "<u4") for words in split]
        for w in ids:
            if len(w) > SHORT:
                del self.known[w]
        if self.bytes is None:  # neighbouring unknown symbols of two words are one
            out = [x[np.r_[True, (x[1:] != x[:-1]) | (x[1:] != self.unknown)]] for x in out]
        return out

    def check(self, ids: dict[str, bytes]) -> None:
        """The library must give the same ids to every word that is the normal form of a text of its own."""
        words = [w for w in ids if w[0] == MARK] if self.marked else list(ids)
        own = [w[self.marked :].replace(MARK, " ") for w in words]
        back = self.processor.normalize(own)
        for w, t, b, found in zip(words, own, back, self.processor.encode(own, num_threads=1), strict=True):
            if t and b == w and pack(found) != ids[w]:
                raise ValueError(f"ids of {w!r} differ from the library's: {found}")


@cache
def _model(data: bytes) -> Model:
    return Model(data)


def model_bytes(vocabulary: str = VOCABULARY) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.model"), "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: bytes | None = None, packed: bool = False) -> DataFrame:
    """``docs`` with its token ids (``ids``) and the text that the library decodes them to (``decoded``).

    Ids are an array, or with ``packed`` binary: unsigned 32-bit integers, little-endian.
    """
    spark, data = docs.sparkSession, vocabulary or model_bytes()
    store.bound_batches(spark, rows=500, mb=4)
    docs = store.without(docs, "ids", "decoded")
    names, place = [*docs.columns, "ids", "decoded"], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for batch in batches:
            ids = model.encode([t or "" for t in batch.column(place).to_pylist()])
            decoded = model.processor.decode([x.tolist() for x in ids], num_threads=1) if ids else []
            if packed:
                column = pa.array([x.tobytes() for x in ids], pa.binary())
            else:
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view("<i4") if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, pa.array(decoded, pa.string())], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", BinaryType() if packed else ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digests(docs: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """doc_id, number of ids, and digests of the packed ids and of the decoded text (UTF-8)."""
    return encode(docs.select("doc_id", "text"), vocabulary, packed=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
