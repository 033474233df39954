import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import by_id, corpus, frame, words

from stratablock.llm import anchors, automaton, jaccard, lpf


def repeats(sequences, window):
    count = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("threshold,hot", [(35, 5000), (35, 1), (8, 3)])
def test_substring_dedup_equals_brute_force(spark, threshold, hot):
    rows = corpus()
    seqs = [(r[1] or "").encode().split() for r in rows]
    got = by_id(automaton.remove_repeats(frame(spark), threshold, hot))
    for r, s, gone in zip(rows, seqs, repeats(seqs, threshold), strict=True):
        kept = b" ".join(w for w, g in zip(s, gone, strict=True) if not g)
        for x in got[r[0]]:
            assert (x.n_words, x.n_removed, x.kept_text) == (len(s), gone.sum(), kept.decode())
            assert x.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("threshold,hot", [(400, 5000), (400, 1), (50, 4)])
def test_suffix_array_dedup_equals_brute_force(spark, threshold, hot):
    rows = corpus()
    seqs = [(r[1] or "").encode() for r in rows]
    got = by_id(lpf.remove_repeats(frame(spark), threshold, hot))
    for r, s, gone in zip(rows, seqs, repeats(seqs, threshold), strict=True):
        kept = np.frombuffer(s, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        for x in got[r[0]]:
            assert (x.n_bytes, x.n_removed, x.n_spans) == (len(s), gone.sum(), runs)
            assert bytes(x.kept) == kept and x.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert automaton.remove_repeats(empty).count() == 0
    assert lpf.remove_repeats(empty).count() == 0
    assert jaccard.classes(empty).count() == 0


def test_automaton_counts_and_matches():
    a = automaton.SuffixAutomaton()
    a.add("abcbc")
    a.add("xbcb", 3)
    a.finish()
    assert a.matching("abcb") == [0, 1, 2, 3]  # a occurs once; bcb four times
    assert a.matching("zz") == [0, 0]


def test_lpf_keeps_the_first_copy():
    body = bytes(np.random.default_rng(0).integers(97, 122, 600, dtype=np.uint8))
    spans = lpf.engine_for(True)([(1, body), (1, b"q" + body)], 400)
    assert spans[0].tolist() == [] and spans[1].tolist() == [[1, 601]]


@pytest.mark.parametrize("window", [400, 401, 402, 403])
def test_matches_of_just_the_threshold(window):
    rng = np.random.default_rng(window)
    some = [b"%d" % k + bytes(rng.integers(97, 122, 298, dtype=np.uint8)) + b"%d" % k for k in range(4)]  # what surrounds a match differs
    shared = bytes(rng.integers(97, 122, window, dtype=np.uint8))
    spans = lpf.engine_for(False)([(1, some[0] + shared + some[1]), (1, some[2] + shared + some[3]), (1, some[0] + shared[1:] + some[2])], window)
    assert [x.tolist() for x in spans[:2]] == [[[300, 300 + window]]] * 2 and not len(spans[2])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, 90, dtype=np.uint64)
    found = []
    for n in (5, 40):
        values = np.concatenate([rng.integers(0, 1 << 60, n, dtype=np.uint64), shared])
        a, b, key, _ = anchors.segments(anchors.Units(values, np.array([0, len(values)])), 35, 8)
        owner = {s: k for x, y, k in zip(a, b, key, strict=True) for s in range(x, y + 1)}
        assert sorted(owner) == list(range(len(values) - 34))
        found.append([owner[n + i] for i in range(90 - 34)])
    assert found[0] == found[1]


def shingles(body):
    w = (body or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """Of each row: its set's size, the smallest id of its class, and how many other rows it links with."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    return [(len(s), least.get(find(i)), n) for i, (s, n) in enumerate(zip(sets, links, strict=True))]


def near_copies():
    """A chain of texts each close to the next, and a hub with many near copies."""
    rows, base = [], words(20, 200)
    for k in range(12):
        base = base[8:] + words(30 + k, 8)
        rows.append((100 + k, " ".join(base), None, None, None, None, None))
    hub = words(21, 150)
    for k in range(40):
        w = list(hub)
        w[k * 3 % 150] = f"edit{k}"
        rows.append((200 + k, " ".join(w), None, None, None, None, None))
    return rows


@pytest.mark.parametrize("chunk", [512, 3])
def test_jaccard_classes_equal_brute_force(spark, chunk):
    rows = corpus() + near_copies()
    got = by_id(jaccard.classes(frame(spark, rows), chunk=chunk))
    for r, want in zip(rows, brute_classes(rows), strict=True):
        for x in got[r[0]]:
            assert (x.n_shingles, x.component_id, x.n_links) == want, r[0]


def test_similarity_exactly_at_the_threshold(spark):
    """7 shared of 8 and 9 in all 10... sets of 7 and 7 that share 6 are at 6/8."""
    one, two = [f"a{i}" for i in range(11)], [f"a{i}" for i in range(10)] + ["b"]
    rows = [(1, " ".join(one), *[None] * 5), (2, " ".join(two), *[None] * 5)]
    got = by_id(jaccard.classes(frame(spark, rows)))
    assert got[2][0].component_id == 1  # 6 shared of 8
    rows = [(1, " ".join(one[:10]), *[None] * 5), (2, " ".join(two[:9] + ["c"]), *[None] * 5)]
    assert by_id(jaccard.classes(frame(spark, rows)))[2][0].component_id == 2  # 5 shared of 7


def test_trie_finds_every_link():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(10_000, 80, replace=False)).astype(np.uint64)
    members = []
    for _ in range(60):
        keep = rng.random(80) > rng.random() * 0.3
        members.append(np.unique(np.concatenate([base[keep], rng.choice(10_000, 8).astype(np.uint64)])))
    linked = lambda a, b: 100 * (n := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - n)
    want = {(i, j) for i in range(60) for j in range(i) if linked(members[i], members[j])}
    found = [(max(p), min(p)) for p in jaccard.join_sets(members, 75)]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    across = set(jaccard.join_sets(members[:25], 75, members[25:]))
    assert across == {(i - 25, j) for i, j in want if i >= 25 > j}


def test_rows_that_meet_grow_in_proportion_under_boilerplate(spark, monkeypatch):
    """Near pairs that all share one passage: blocks must not be led by it."""
    passage = words(1, 64, 10**6)
    sent = []
    plain = jaccard._groups
    monkeypatch.setattr(jaccard, "_groups", lambda *a: sent.append(plain(*a).count()) or plain(*a))
    for n in (300, 600):
        rows = []
        for k in range(n):
            own = words(1000 + k // 2, 140, 10**6)
            rows.append((k, " ".join([*own[:70], *passage, *own[70:], f"x{k}"]), *[None] * 5))
        found = by_id(jaccard.classes(frame(spark, rows)))
        assert {k: (v[0].component_id, v[0].n_links) for k, v in found.items()} == {k: (k - k % 2, 1) for k in range(n)}
    assert sent[1] <= 2.5 * sent[0] and sent[1] <= 4 * 600, sent
