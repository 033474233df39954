import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, by_id, corpus, frame, words
from pyspark.sql import functions as F

from stratablock.llm import langid, pitman_yor, quality, sampling, text


def brute_surface(body):
    body = body or ""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", body)
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    trigrams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if trigrams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), len(inside)


def labelled():
    good = [(" ".join(words(k, 80)), 1) for k in range(60)]
    bad = [(" ".join(w + "%%%" for w in words(100 + k, 80)), 0) for k in range(30)]
    return good + bad


def test_surface_columns_equal_brute_force(spark):
    rows = corpus() + [(30, "a b c a b c\na b c a b c\n\n \na # b", *[None] * 5)]
    got = by_id(quality.score(frame(spark, rows), quality.fit([])))
    for r in rows:
        want = brute_surface(r[1])
        for x in got[r[0]]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
            assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert x.kept == (not x.base_failed) and x.quality_score == 1.0  # no labels: all are kept


def test_quality_model_separates_and_is_calibrated():
    model = quality.fit(labelled())
    fresh = pa.array([" ".join(words(500, 80)), " ".join(w + "%%%" for w in words(501, 80)), "", None], pa.string())
    p = model.scores(fresh)
    assert p[0] > 0.7 and p[1] < 0.3 and ((p >= 0) & (p <= 1)).all()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sample_pairs_each_text_with_its_own_label(spark, kind):
    rows = [(1, "aaa", "en"), (1, "bbb", "de"), (1, "bbb", "de"), (2, "ccc", "en"), (3, None, "en"), (4, "ddd", None), (None, "eee", "fr"), (5, "long " * 30, "fr")]
    df = spark.createDataFrame([(None if k is None else str(k) if kind == "string" else k, t, v) for k, t, v in rows], f"doc_id {kind}, text string, label string")
    seen = []
    for n in (1, 3):
        got = sampling.labelled_sample(df.repartition(n), max_bytes=60).orderBy("place").collect()
        seen.append([(r.text, r.label) for r in got])
    assert seen[0] == seen[1] and set(seen[0]) == {("aaa", "en"), ("bbb", "de"), ("ccc", "en")} and len(seen[0]) == 3
    assert sampling.labelled_sample(df, max_rows=2).count() == 2
    assert sampling.labelled_sample(df, max_bytes=3).count() == 1
    labels = df.select("doc_id", F.when(F.col("label") == "en", 1).otherwise(0).alias("quality"))
    known = {(r.text, r.label) for r in sampling.labels_of(df, labels, "quality").collect()}
    assert {("aaa", 0), ("bbb", 0), ("ccc", 1)} <= known  # of an id's labels the smallest, for all its rows
    assert sampling.fitted(sampling.labelled_sample(df.filter("false")), len) == 0
    assert sampling.fitted(sampling.labelled_sample(df, max_bytes=60), len) == 3


def test_quality_on_labels(spark):
    rows = [(k, t, *[None] * 5) for k, (t, _) in enumerate(labelled())]
    labels = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(labelled())] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = by_id(quality.score(frame(spark, rows), quality.fit_on_labels(frame(spark, rows), labels)))
    assert all(got[k][0].kept == bool(q) for k, (_, q) in enumerate(labelled()))
    assert quality.score(frame(spark, []), quality.fit([])).count() == 0


def language(seed, letters, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rows = [(k, language(k, "aeiourst" if k % 2 else "kzwyxqpé"), "one" if k % 2 else "two", *[None] * 4) for k in range(80)]
    model = langid.fit([(r[1], r[2]) for r in rows[:60]])
    extra = [(200, None, "one", *[None] * 4), (201, "", "one", *[None] * 4), (202, "123 -- ¿?", "two", *[None] * 4), (203, "日本", None, *[None] * 4)]
    got = by_id(langid.predict(frame(spark, rows[60:] + extra), model))
    assert all(got[r[0]][0].lang_pred == r[2] for r in rows[60:])
    assert [(got[k][0].lang_pred, got[k][0].score) for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203][0].lang_pred in ("one", "two")
    assert all(0 <= x.score <= 1 for v in got.values() for x in v)
    none = by_id(langid.predict(frame(spark), langid.fit([])))
    assert {x.lang_pred for v in none.values() for x in v} == {"und"}


def test_fold_is_the_crc_of_the_id(spark):
    got = spark.range(20).withColumnRenamed("id", "doc_id").select("doc_id", langid.fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_language_model_base_and_order(spark, block):
    rows = corpus()
    docs = frame(spark).withColumn("learn", F.col("doc_id") % 2 == 0)
    scored, total = pitman_yor.score(docs, block_tokens=block)
    low = {i: i + 32 for i in range(65, 91)}
    toks = [(r[1] or "").translate(low).encode().split() + [None] for r in rows]
    c = Counter(w for r, t in zip(rows, toks, strict=True) if r[0] is not None and r[0] % 2 == 0 for w in t)
    n, v = sum(c.values()), len(c)
    assert total == n and {"lang", "source", "learn"} <= set(scored.columns) and "text" not in scored.columns
    got = by_id(scored)
    assert sum(map(len, got.values())) == len(rows)
    for r, t in zip(rows, toks, strict=True):
        for x in got[r[0]]:
            assert x.n_tokens == len(t) and x.n_known == sum(c[w] > 0 for w in t)
            assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            assert x.score < 0


def test_language_model_of_nothing(spark):
    docs = frame(spark).withColumn("learn", F.lit(False))
    scored, total = pitman_yor.score(docs)
    got = by_id(scored)
    assert total == 0 and all(x.n_known == 0 and x.base_score == 0.0 and math.isfinite(x.score) for v in got.values() for x in v)
    assert pitman_yor.score(frame(spark, []).withColumn("learn", F.lit(True)))[0].count() == 0


def in_process(texts, learn, shards, hot, size=1 << 20):
    """The model's steps without Spark: each block's totals, words and tokens' counts and log probabilities."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(learn, pa.bool_())], names=["text", "learn"])
    every = lambda batches: [r for x in batches for r in x.to_pylist()]
    by_part = lambda rows: [pitman_yor._batch([(r["kind"], r["part"], r["block"], r["body"]) for r in rows if r["part"] == s]) for s in range(shards)]
    asked = every(pitman_yor._asking(hot, shards, size)(iter([batch])))
    told = [r for x in by_part(asked) for r in every(pitman_yor._restaurants(hot, shards, 3)(iter([x])))]
    totals = pitman_yor.Totals.of(hot, [pitman_yor._unpacked(r["body"]) for r in told if r["kind"] == pitman_yor.TOTALS])
    more = [dict(zip(("kind", "part", "block", "body"), x, strict=True)) for x in pitman_yor._hot_asked(hot, shards)]
    to_root = [r for r in told if r["kind"] in (pitman_yor.TABLES, pitman_yor.WORDS)] + more
    root = [r for x in by_part(to_root) for r in every(pitman_yor._root(3, totals.types)(iter([x])))]
    few = [r for r in root if r["kind"] == pitman_yor.TOTALS or r["block"] == pitman_yor._HOT]
    totals.add_root([(r["kind"], r["part"], pitman_yor._unpacked(r["body"])) for r in few], shards)
    for name, _, h, bounds in pitman_yor._blocks(iter([batch]), size):
        b = pitman_yor.Block(*np.unique(h, return_inverse=True), bounds)
        mine = [(r["kind"], r["part"], r["body"]) for r in told + root if r["block"] == name]
        yield totals, b, *pitman_yor._scored(mine, b, totals, shards)


@pytest.mark.parametrize("shards,busy", [(1, []), (3, []), (3, ["a", "b"]), (2, ["a", "never"])])
def test_probabilities_of_every_context_sum_to_one(shards, busy):
    rng = np.random.default_rng(5)
    vocabulary = [*"abcdefgh", *(f"w{k}" for k in range(25))]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    learned = [" ".join(rng.choice(vocabulary, 40, p=weights / weights.sum())) for _ in range(30)]
    known = sorted({w for t in learned for w in t.split()})
    # every word, the end, and one that is not known, after every word and after a start
    probes = [f"{u} {w}" for u in known for w in [*known, "zzz"]] + known + ["zzz", ""]
    hashes = text.Words(*text.buffers(pa.array(busy, pa.string()))).hashes().view(np.int64).tolist()
    hot = pitman_yor.hot_of({h: 1.5 + 4 * k for k, h in enumerate(hashes)}, shards)
    texts = learned + probes
    ((totals, b, count, log),) = in_process(texts, [True] * 30 + [False] * len(probes), shards, hot)
    assert totals.types == len(known) + 1 and totals.tokens == 30 * 41
    assert totals.customers >= totals.types
    p = {}
    for k in range(30, len(texts)):
        words = [*texts[k].split(), None]
        for u, w, x in zip([None, *words], words, log[b.bounds[k] : b.bounds[k + 1]], strict=False):
            p[u, w] = 10**x
    for u in [None, *known]:
        mass = sum(p[u, w] for w in [*known, None, "zzz"])
        assert math.isclose(mass, 1, abs_tol=1e-6), (u, mass)
    seen = Counter(w for t in learned for w in [*t.split(), None])
    flat = [w for t in texts for w in [*t.split(), None]]
    assert count.tolist() == [seen[w] for w in flat]


def test_blocks_do_not_change_what_is_learned():
    texts = [" ".join(words(k, 60, 30)) for k in range(40)]
    learn = [k % 3 > 0 for k in range(40)]
    none = pitman_yor.hot_of({}, 2)
    ((whole, b, count, log),) = in_process(texts, learn, 2, none)
    parts = list(in_process(texts * 1, learn, 2, none, size=1))
    assert (parts[0][0].types, parts[0][0].tokens, parts[0][0].customers) == (whole.types, whole.tokens, whole.customers)
    assert np.array_equal(np.concatenate([c for _, _, c, _ in parts]), count)
    assert np.allclose(np.concatenate([x for _, _, _, x in parts]), log)


def stirling(n, d):
    """Weights of a dish's customers at t = 0..n tables."""
    s = np.zeros(n + 1)
    s[0] = 1
    for m in range(n):
        s = np.concatenate([[0], s[:-1]]) + np.maximum(m - d * np.arange(n + 1), 0) * s
        s /= s.max()
    return s


def brute_tables(dishes, d, strength=1.0):
    """Mean tables of each dish of one restaurant, over all seatings: dishes are (customers, probability above)."""
    ways = [stirling(n, d) for n, _ in dishes]
    total, mean = 0.0, np.zeros(len(dishes))
    for t in np.ndindex(*(n for n, _ in dishes)):
        t = np.array(t) + 1
        if any(w[k] <= 0 for w, k in zip(ways, t, strict=True)):
            continue
        log = np.log(strength + d * np.arange(t.sum())).sum() + sum(np.log(w[k]) + k * math.log(g) for w, k, (_, g) in zip(ways, t, dishes, strict=True))
        weight = math.exp(log)
        total += weight
        mean += weight * t
    return mean / total


CASES = [
    ([(2, 0.4)], 0.6), ([(6, 0.3)], 0.6), ([(12, 0.9)], 0.6), ([(5, 0.4), (3, 0.2)], 0.6), ([(7, 0.5), (2, 0.1), (4, 0.3)], 0.6), ([(100, 0.3)], 0.6),
    ([(1000, 0.3)], 0.6), ([(1000, 0.01)], 0.8), ([(3000, 0.05)], 0.9), ([(600, 0.5)], 0.5),
]


@pytest.mark.parametrize("dishes, d", CASES)
def test_seating_equals_brute_force(dishes, d):
    """At the operator's own numbers of sweeps."""
    copies = 4000 if max(n for n, _ in dishes) <= pitman_yor.EXACT else 1000
    n, parent = np.tile([c for c, _ in dishes], copies), np.tile([g for _, g in dishes], copies)
    names = text.mix(np.arange(len(n)).astype(np.uint64))
    seating = pitman_yor.Seating(n, np.repeat(np.arange(copies), len(dishes)), copies, parent, d, names)
    t, total = pitman_yor.gibbs(seating)
    assert np.allclose(t.reshape(copies, -1).mean(axis=0) / pitman_yor.SAMPLES, brute_tables(dishes, d), rtol=0.03)
    assert total.sum() == t.sum() and (seating.t <= n).all() and (seating.t >= 1).all()
    assert np.array_equal(seating.total, np.bincount(seating.where_all, seating.t, copies))


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(k, " ".join(words(k, 80, 60)), *[None] * 5) for k in range(120)]
    found = []
    for parts in (2, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("learn", F.col("doc_id") % 3 > 0)
        found.append({k: v[0].score for k, v in by_id(pitman_yor.score(docs, block_tokens=500 * parts)[0]).items()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_model_prefers_what_it_has_seen(spark):
    rows = [(k, f"x{k % 40} y{k % 40} z", *[None] * 5) for k in range(400)] + [(1000, "x1 y1 z", *[None] * 5), (1001, "x1 y2 z", *[None] * 5), (1002, "x1 never z", *[None] * 5)]
    got = by_id(pitman_yor.score(frame(spark, rows).withColumn("learn", F.col("doc_id") < 1000))[0])
    assert math.isclose(got[1000][0].base_score, got[1001][0].base_score)
    assert got[1000][0].score > got[1001][0].score + 1 > got[1002][0].score + 1  # y1 follows x1, y2 never does


def test_words_and_hashes():
    buf, off = text.buffers(pa.array(["a bb\ta", None, "", "bb", " ccc "], pa.string()))
    w = text.Words(buf, off)
    assert w.counts.tolist() == [3, 0, 0, 1, 1]
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert [bytes(buf[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == [b"a", b"bb", b"a", b"bb", b"ccc"]


def plain_mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def plain_hash(raw):
    """The hash of a run of bytes, one byte after another."""
    values, base = text.byte_values(np.arange(256, dtype=np.uint8)).tolist(), 0x9E3779B97F4A7C15
    return plain_mix(sum(values[b] * pow(base, k, 2**64) for k, b in enumerate(raw)) % 2**64)


def awkward():
    return [r[1] for r in corpus()] + ["a", "A a", "Été à la plage", "x" * 700, "one two three", "#* 12"]


def test_language_prediction_equals_plain_loops(spark):
    rows = [(language(k, "aeiourst" if k % 3 else "kzwyxqpé"), ("one", "two", "three")[k % 3]) for k in range(60)]
    model = langid.fit(rows)
    texts = awkward()
    got = by_id(langid.predict(frame(spark, [(k, t, *[None] * 5) for k, t in enumerate(texts)]), model))
    low, mask = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))), (1 << langid.BITS) - 1
    for k, t in enumerate(texts):
        total, n = np.zeros(len(model.langs)), 0
        for w in (t or "").encode().translate(low).split():
            flat = b" " + w + b" "
            pieces = [flat[i : i + m] for m in langid.ORDERS for i in range(len(flat) - m + 1) if m > 1 or 0 < i < len(flat) - 1]
            for bucket in [*(plain_hash(p) & mask for p in pieces), plain_mix((plain_hash(flat) + 5) % 2**64) & mask]:
                total += model.embeddings[bucket].astype(float) @ model.softmax
                n += 1
        e = np.exp((total / max(n, 1) + model.bias) / model.temperature)
        letter = any(map(str.isalpha, t or ""))
        want = model.langs[int((e / e.sum()).argmax())] if letter else "und"
        assert got[k][0].lang_pred == want and got[k][0].score == pytest.approx((e / e.sum()).max() if letter else 0, abs=1e-4)
        assert got[k][0].rejected == (got[k][0].score < langid.REJECT_BELOW)


def test_quality_score_equals_plain_loops(spark):
    model = quality.fit(labelled())
    texts = awkward() + [labelled()[0][0], labelled()[70][0]]
    got = by_id(quality.score(frame(spark, [(k, t, *[None] * 5) for k, t in enumerate(texts)]), model))
    mask = (1 << quality.BITS) - 1
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        hashes = [plain_hash(w) for w in raw.split()]
        families = [[plain_hash(raw[i : i + m]) for i in range(len(raw) - m + 1)] if len(raw) < 3000 else None for m in quality.CHAR_ORDERS]
        if None in families:
            continue
        families += [[plain_mix((h + 11) % 2**64) for h in hashes], [plain_mix((a * 31 + b) % 2**64) for a, b in zip(hashes, hashes[1:], strict=False)]]
        z = model.bias + sum(sum(float(model.weights[f][h & mask]) for h in own) / max(len(own), 1) for f, own in enumerate(families))
        p = 1 / (1 + math.exp(-max(min(model.slope * z + model.shift, 40), -40)))
        assert got[k][0].quality_score == pytest.approx(p, abs=1e-5)
        assert got[k][0].kept == (not got[k][0].base_failed and got[k][0].quality_score >= quality.KEEP_FROM)


def test_models_of_empty_tables(spark):
    none = frame(spark, [])
    model = langid.fit_on_labels(none)
    assert model is None and langid.predict(none, model).collect() == [] and by_id(langid.predict(frame(spark), model))[0][0].lang_pred == "und"
    assert quality.score(none, quality.fit_on_labels(none, spark.createDataFrame([], "doc_id long, quality int"))).collect() == []
