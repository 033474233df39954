"""The registered queries over the smallest tables, against plain versions and their contracts' columns."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_dedup import brute_classes, repeats
from test_scans import brute_base, brute_hits
from test_text_models import brute_surface
from test_vectors import brute_negatives

from stratablock.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "op1_substring_dedup": "doc_id bigint n_words bigint n_removed bigint kept_sha256 string",
    "op2_language_id": "doc_id bigint held_out boolean lang_pred string score double",
    "op3_url_filters": "page_id bigint host string path string rule string verdict string",
    "op4_best_fit_packing": "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint",
    "op5_jaccard_join": "doc_id bigint n_shingles bigint component_id bigint",
    "op6_license_scan": "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint base_labels string labels string score double",
    "op7_lm_scoring": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint base_score double score double",
    "op8_suffix_array_dedup": "doc_id bigint n_bytes bigint n_removed bigint n_spans bigint kept_sha256 string",
    "op9_decontamination": "doc_id bigint n_words bigint n_hit bigint n_items bigint items_sha256 string contaminated boolean",
    "op11_hard_negatives": "anchor_id bigint positive_id bigint rank int negative_id bigint positive_score bigint negative_score bigint",
    "op12_sentencepiece": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
    "op13_whitening": "vec_id bigint component int n bigint deviation bigint whitened double explained double identity_error double",
    "op10_quality_rules": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
}


def table(name, *columns):
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pylist()]


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id", "text")


def rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want = COLUMNS[name].split()
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in want[::2]} == dict(zip(want[::2], want[1::2], strict=True))
    return df.collect()


def one(spark, name, docs):
    found = rows(spark, name)
    assert len(found) == len(docs)
    return {r.doc_id: r for r in found}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, docs):
    got = one(spark, "op1_substring_dedup", docs)
    seqs = [(t or "").encode().split() for _, t in docs]
    for (k, _), s, gone in zip(docs, seqs, repeats(seqs, 35), strict=True):
        kept = b" ".join(w for w, g in zip(s, gone, strict=True) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(s), gone.sum(), sha(kept))


def test_op2(spark, docs):
    got = one(spark, "op2_language_id", docs)
    langs = dict(table("documents", "doc_id", "lang"))
    right = []
    for k, t in docs:
        held = zlib.crc32(str(k).encode()) % 5 == 0
        letters = any(map(str.isalpha, t or ""))
        assert got[k].held_out == held and (got[k].lang_pred == "und") == (not letters) and 0 <= got[k].score <= 1
        if held and letters and langs[k]:
            right.append(got[k].lang_pred == langs[k])
    assert np.mean(right) > 0.8 and {r.lang_pred for r in got.values()} <= {*langs.values(), "und"}


def test_op3(spark):
    found = rows(spark, "op3_url_filters")
    assert len(found) == len(table("pages", "page_id")) and {r.verdict for r in found} <= {"allow", "block"}


def test_op4(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces, bins = {}, {}
    for r in rows(spark, "op4_best_fit_packing"):
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for k, t in docs:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        assert sorted(pieces[k]) == [(n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    for b in bins.values():
        ends = [sum(n for _, n in sorted(b)[:k]) for k in range(len(b) + 1)]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_op5(spark, docs):
    got = one(spark, "op5_jaccard_join", docs)
    assert {k: (r.n_shingles, r.component_id, r.n_links) for k, r in got.items()} == {k: want for (k, _), want in zip(docs, brute_classes(docs), strict=True)}


def test_op6(spark, docs):
    got = one(spark, "op6_license_scan", docs)
    for k, t in docs:
        n, found = brute_base(t)
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), ",".join(sorted({f[1] for f in found})))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert {*r.base_labels.split(",")} <= {*r.labels.split(","), ""} and 0 <= r.score <= 1


def test_op7(spark, docs):
    got = one(spark, "op7_lm_scoring", docs)
    toks = {k: (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split() + [None] for k, t in docs}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    c = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in toks.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    perplexity = lambda column: 10 ** (-sum(r[column] for k, r in got.items() if held[k]) / sum(len(ws) for k, ws in toks.items() if held[k]))
    assert perplexity("score") < 0.8 * perplexity("base_score")  # of held-out texts


def test_op8(spark, docs):
    got = one(spark, "op8_suffix_array_dedup", docs)
    seqs = [(t or "").encode() for _, t in docs]
    for (k, _), s, gone in zip(docs, seqs, repeats(seqs, 400), strict=True):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (len(s), gone.sum(), runs)
        assert got[k].kept_sha256 == sha(np.frombuffer(s, np.uint8)[~gone].tobytes())


def test_op9(spark, docs):
    got = one(spark, "op9_decontamination", docs)
    items = table("benchmark", "item_id", "text")
    for (k, _), (n, hit, found) in zip(docs, brute_hits(docs, items, 10), strict=True):
        digest = sha(",".join(sorted(map(str, found))).encode())
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (n, hit.sum(), len(found), digest, bool(hit.any()))


def test_op10(spark, docs):
    got = one(spark, "op10_quality_rules", docs)
    good = dict(table("labels", "doc_id", "quality"))
    right = []
    for k, t in docs:
        r, want = got[k], brute_surface(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
        if k in good and not r.base_failed:
            right.append(r.kept == bool(good[k]))
    assert np.mean(right) > 0.8


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted((tuple(None if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_registered_once():
    assert sorted(queries.QUERIES) == sorted(COLUMNS)


def test_hard_negatives(spark):
    own = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in table("embeddings", "vec_id", "embedding", "label")]
    assert sorted(map(tuple, rows(spark, "op11_hard_negatives"))) == sorted(brute_negatives(own))


def test_sentencepiece(spark, docs):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = one(spark, "op12_sentencepiece", docs)
    for i, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = found[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))


def test_whitening(spark):
    own = table("embeddings", "vec_id", "embedding")
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in own])
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    want = (centred @ u[:, ::-1] / np.sqrt(e[::-1]))[:, :32]
    found = rows(spark, "op13_whitening")
    assert len(found) == n * 32 and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-8
    at, deviation = {i: k for k, (i, _) in enumerate(own)}, ((n * x - total) ** 2).sum(axis=1)
    got = np.zeros((n, 32))
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained - e[-r.component] / e.sum()) < 1e-9
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-7)
