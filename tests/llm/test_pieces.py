"""SentencePiece ids against the library, on every kind of text."""

import hashlib
import random

import numpy as np
import pytest
from helpers import SCHEMA, by_id, corpus, frame

from stratablock.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.model_bytes())


def strange(seed, n=4000):
    rng = random.Random(seed)
    letters = "aábcdeé 日本語\n\t▁ \x00<s>0x  ٠😀ﬁthe in   ington"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*texts, "", " ", "  ", "a" * 3000, " " * 2000, "日本" * 2000, "▁" * 50, "<s>", "</s>", "<unk>", "<0x41>", "in▁the", "a　b", " a ", "x" * 48, "x" * 49]


def test_ids_equal_the_library(model):
    texts = [t or "" for _, t, *_ in corpus()] + strange(1)
    want = model.processor.encode(texts, add_bos=True, add_eos=True)
    assert [x.tolist() for x in model.encode(texts)] == want
    assert [x.tolist() for x in model.encode(texts)] == want  # from kept words


def test_heap_and_shared_agenda_agree(model):
    words = list({w for t in strange(2) for w in model.words(model.processor.normalize(t)) if len(w) <= pieces.SHORT})
    assert len(words) > 5000
    assert model.short_ids(words) == {w: model.word_ids(w) for w in words}


def test_agenda_takes_the_best_score_first(model):
    """Against a plain loop that looks at all pairs each time."""
    for word in {w for t in strange(3, 300) for w in model.words(model.processor.normalize(t)) if len(w) < 200}:
        s = list(word)
        while pairs := [(model.rank[a + b][0], k) for k, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in model.rank]:
            k = min(pairs)[1]
            s[k : k + 2] = [s[k] + s[k + 1]]
        assert model.merged(word) == s


def test_words_forgotten_are_encoded_again(model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 50)
    small = pieces.Model(pieces.model_bytes())
    texts = strange(4, 500)
    for k in range(0, len(texts), 7):
        assert [x.tolist() for x in small.encode(texts[k : k + 7])] == model.processor.encode(texts[k : k + 7], add_bos=True, add_eos=True)


def test_difference_from_the_library_is_an_error(model):
    with pytest.raises(ValueError, match="differ"):
        model.check({"▁the": pieces.pack([5, 6])})


def test_columns_and_digests(spark, model):
    texts = {i: t for i, t, *_ in corpus()}
    found = by_id(pieces.encode(frame(spark)))
    for i, rows in found.items():
        for r in rows:
            want = model.processor.encode(texts[i] or "", add_bos=True, add_eos=True)
            assert r["ids"] == want and r["decoded"] == model.processor.decode(want) and r["lang"] in ("en", "de", None)
    assert sum(map(len, found.values())) == len(corpus())
    for i, rows in by_id(pieces.digests(frame(spark))).items():
        ids = model.processor.encode(texts[i] or "", add_bos=True, add_eos=True)
        sha = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.processor.decode(ids).encode()).hexdigest())
        assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {(len(ids), *sha)}


def test_empty_table_and_clashing_names(spark):
    assert pieces.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "a b", "old", "old")], "doc_id long, text string, IDS string, decoded string")
    assert [(r["text"], r["decoded"], len(r["ids"])) for r in pieces.encode(clash).collect()] == [("a b", "a b", 4)]
