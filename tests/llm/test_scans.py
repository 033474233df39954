import re
import zlib

import numpy as np
import pytest
from helpers import by_id, corpus, frame, words

from stratablock.llm import fmindex, licenses, packing, queries, urls

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(body):
    return WORD.findall((body or "").encode().lower())


def brute_hits(rows, items, size):
    windows = {}
    for item, body in items:
        w = low(body)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    for r in rows:
        w = low(r[1])
        hit, found = np.zeros(len(w), bool), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = True
                    found |= windows[tuple(w[i : i + n])]
        yield len(w), hit, sorted(x for x in found if x is not None)


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_decontamination_equals_brute_force(spark, block):
    items = [(1, " ".join(words(1, 70)[5:40])), (2, " ".join(words(2, 120)[20:33])), (3, "two"), (4, None), (5, "--"), (None, " ".join(words(8, 50)[:12])), (1, " ".join(words(4, 30)[:11]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = corpus()
    got = by_id(fmindex.decontaminate(frame(spark), bench, block_bytes=block))
    for r, (n, hit, found) in zip(rows, brute_hits(rows, items, 10), strict=True):
        for x in got[r[0]]:
            assert (x.n_words, x.n_hit, list(x.item_ids)) == (n, hit.sum(), found), r[0]
            covered = [i for s in x.spans for i in range(s.start, s.end)]
            assert covered == np.flatnonzero(hit).tolist()
            assert low(x.clean_text) == [w for w, h in zip(low(r[1]), hit, strict=True) if not h]


def test_items_of_any_type(spark):
    items = [("b", " ".join(words(1, 70)[5:40])), ("a", " ".join(words(1, 70)[5:40])), (None, "two"), ("c", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = by_id(fmindex.decontaminate(frame(spark), bench))
    assert list(got[8][0].item_ids) == ["a", "b"] and list(got[6][0].item_ids) == ["c"] and got[6][0].n_hit == 2


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(x.n_hit == 0 for v in by_id(fmindex.decontaminate(frame(spark), none)).values() for x in v)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert fmindex.decontaminate(frame(spark, []), some).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    runs = [rng.integers(1, 5, n) for n in (30, 1, 17, 30)] + [np.full(40, 2)]
    joined = np.concatenate([np.append(r, 0) for r in runs])
    index = fmindex.FMIndex(joined, 4)
    for n in (1, 2, 5):
        patterns = np.array(sorted({tuple(joined[i : i + n]) for i in range(len(joined) - n)} - {()}))
        patterns = patterns[(patterns > 0).all(axis=1)]
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(joined) - n + 1) if (joined[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_minimum_bin_slack_packs_fully():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 900)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    plan = packing.minimum_bin_slack(histogram, 100)
    used = {}
    for bins, chosen in plan:
        assert bins > 0 and sum(k * c for k, c in chosen.items()) <= 100
        for k, c in chosen.items():
            used[k] = used.get(k, 0) + bins * c
    assert used == histogram
    rooms: list[int] = []
    for x in sorted(sizes.tolist(), reverse=True):  # best fit, longest first
        fit = min((r for r in rooms if r >= x), default=None)
        rooms.remove(fit) if fit is not None else None
        rooms.append((100 if fit is None else fit) - x)
    assert sum(b for b, _ in plan) <= min(1.01 * len(rooms), 1.01 * sizes.sum() / 100 + 1)
    best = packing.fullest([(7, 2), (5, 1), (3, 1)], 16)
    assert sum(k * c for k, c in best.items()) == 15


def test_both_tokenizer_libraries_agree():
    """Every character of the shorter way in every company, and random texts of them."""
    full, fast = packing._encoders(packing.VOCABULARY)
    chars = [chr(c) for c in range(ord(packing._SAFE) + 1)]
    same = lambda t: fast.encode_ordinary(t) == full.encode(t, add_special_tokens=False).ids
    for c in chars:
        assert all(same(t) for t in (c, "a" + c, c + "a", " " + c, c + " ", c + c, "1" + c + "1", "'" + c)), repr(c)
    rng = np.random.default_rng(12)
    bits = ["'s", "'ll", "don't", "123", "  ", "\n\n", "\r\n", "\t", "abc", "É", "ǆ", "½", "--", *chars]
    odds = np.array([20.0] * 13 + [1.0] * len(chars))
    for _ in range(4000):
        t = "".join(rng.choice(bits, rng.integers(1, 60), p=odds / odds.sum()))
        assert same(t), repr(t)
    assert packing.token_ids("日本 " + packing.SPECIAL) == full.encode("日本 " + packing.SPECIAL, add_special_tokens=False).ids


def test_packing_places_every_token(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = corpus() + [(40, "end <|endoftext|> 'll  x \n\n  y", *[None] * 5)]
    found = packing.pack(frame(spark, rows), capacity=256).collect()
    want = sorted((r[0] is None, r[0] or 0, len(full.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    total = {}
    bins = {}
    for x in found:
        total.setdefault(x.doc_id, []).append(x)
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(x.length for x in found) == sum(n for _, _, n in want)
    for r in rows:
        ids = np.array([*full.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        pieces = {(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
        assert {(x.piece, x.start, x.length, x.ids_crc32) for x in total[r[0]]} == pieces
    assert packing.pack(frame(spark, [])).count() == 0


PAGES = [
    (1, "http://a.example.org/en/1?x"), (2, "https://EXAMPLE.org/es/2#y"), (3, "https://www.x.com/fr/9"), (4, "https://x.com/de/9"), (5, None), (6, "no scheme"),
    (7, "ftp://bad.net"), (8, "http://bad.net/p"), (9, "http://good.net/p"), (10, "x://y.com://z/fr/"), (1, "http://a.example.org/en/1?x"), (11, "http://notexample.org/es/1"),
]


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    outcomes = spark.createDataFrame([("http://bad.net/a", 1)] * 60 + [("http://good.net/a", 0)] * 200 + [(None, 1), ("http://good.net/b", None)], "url string, bad int")
    got = {r.page_id: r for r in urls.judge(pages, outcomes).collect()}
    view = lambda k: (got[k].host, got[k].path, got[k].rule, got[k].verdict)
    assert view(1) == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert view(2) == ("example.org", "/es/2", "example.org/es/", "block")
    assert view(3) == ("www.x.com", "/fr/9", "com/fr/", "allow")
    assert view(4) == ("x.com", "/de/9", "com/de/", "block")
    assert view(5)[:3] == view(6)[:3] == ("", "", None)
    assert view(7) == ("bad.net", "", None, "block") and view(8)[3] == "block" and view(9)[3] == "allow"
    assert view(10)[:2] == ("y.com:", "//z/fr/") and view(11)[2] == "org/"
    assert urls.judge(pages, outcomes).count() == len(PAGES)
    none = urls.judge(pages, outcomes.limit(0))
    assert {r.verdict for r in none.filter("rule is null").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), outcomes).count() == 0


LICENSED = [
    (1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0"), (3, None), (4, ""),
    (5, "SPDX-License-Identifier: BSD-3-Clause"), (6, "under the mit licenses; cc-by-nc cc by nc"), (7, "This work is licensed under the GNU General Public License, version 3"),
    (8, "submit licenses permitted"), (9, "CREATIVE COMMONS BY-SA 4.0 license"), (9, "CREATIVE COMMONS BY-SA 4.0 license"),
]


def test_license_scan(spark):
    got = by_id(licenses.scan(spark.createDataFrame(LICENSED, "doc_id long, text string").withColumn("score", licenses.F.lit("clash"))))
    view = lambda k: (got[k][0].n_base, got[k][0].first_word, got[k][0].last_word, got[k][0].base_labels, got[k][0].labels)
    assert view(1) == (1, 1, 1, "mit", "mit")
    assert view(2) == (2, 3, 9, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert view(3) == view(4) == (0, None, None, "", "") and got[3][0].score == 0.0
    assert view(5) == (0, None, None, "", "bsd-3-clause") and got[5][0].score == 1.0
    assert view(6) == (2, 4, 7, "cc-by-nc", "cc-by-nc")
    assert view(7)[4] == "gpl-3" and view(8)[4] == "" and view(9)[4] == "cc-by-sa" and len(got[9]) == 2
    assert got[1][0].n_words == 5 and got[6][0].n_words == 10


def surviving(dets):
    """By definition: who lies inside another, or beside a better one that stays, goes."""
    span = lambda d: (d[0], -d[1])
    inside = lambda d, e: span(e)[0] <= span(d)[0] and span(d)[1] <= span(e)[1]
    outer = []
    for d in dets:
        rest = [e for e in dets if e is not d and inside(d, e)]
        # equal intervals: the better priority, then the first label
        if all(span(e) == span(d) and (e[2:], id(e)) > (d[2:], id(d)) for e in rest):
            outer.append(d)
    kept = []
    for d in sorted(outer, key=lambda d: (d[2], d[0])):
        if all(span(k)[1] <= span(d)[0] or span(d)[1] <= span(k)[0] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_license_suppression_equals_its_definition(spark):
    rng = np.random.default_rng(6)
    cases = []
    for _ in range(60):
        n = int(rng.integers(1, 14))
        cases.append([(int(a), -int(a + m), int(p), f"l{p}{k}", 0.5) for k, (a, m, p) in enumerate(zip(rng.integers(0, 30, n), rng.integers(1, 12, n), rng.integers(1, 6, n), strict=True))])
    # a better one replaces its neighbour, and what only the neighbour overlapped comes back
    cases.append([(0, -10, 2, "a", 0.5), (8, -20, 1, "b", 0.5), (18, -30, 2, "c", 0.5), (25, -40, 3, "d", 0.5)])
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, d array<struct<start:int,back:int,p:int,label:string,c:double>>")
    got = {r.k: [tuple(x) for x in r.kept] for r in df.select("k", licenses._survivors(licenses.F.col("d")).alias("kept")).collect()}
    assert got == {k: surviving(c) for k, c in enumerate(cases)}
    assert [x[3] for x in got[60]] == ["b", "d"]


def test_rules_are_many_and_have_their_keyword():
    assert len(licenses.RULES) > 400 and len(licenses.WORDING) > 100
    for _, _, _, word, regex in licenses.RULES:
        re.compile(regex)
        assert word == word.lower()


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11))


NOTICES = [
    (1, "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"), to deal", "mit"),
    (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    (3, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    (4, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "isc"),
    (5, "This is free and unencumbered software released into the public domain.", "unlicense"),
    (6, "Altered source versions must be plainly marked as such, and must not be\n * misrepresented as being the original software.", "zlib"),
    (7, "you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    (8, "https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    (9, "an anybody may sell whatever is granted", ""),
]


def brute_base(body):
    """Words, and the places of each base phrase."""
    w = low(body)
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.encode().split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def test_license_base_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    bits = ["under the MIT license", "apache license, version 2", "CC-BY-NC", "under", "the", "mit", "license", "é", "日本", "x1", "\n", ". ", "--", "\x00", "𝔘", "KİK"]
    rows = [(k, "".join(str(rng.choice(bits)) + str(rng.choice([" ", "", "\t", "."])) for _ in range(rng.integers(0, 14)))) for k in range(300)]
    rows += [(400, " "), (401, "\n\n"), (402, "a"), (403, " a"), (404, "a "), (405, None), (406, "")] + [(500 + r[0], r[1]) for r in corpus() if r[0] is not None]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, body in rows:
        n, found = brute_base(body)
        for x in got[k]:
            assert (x.n_words, x.n_base, x.base_labels) == (n, len(found), ",".join(sorted({f[1] for f in found}))), body
            assert (x.first_word, x.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
            assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_license_wording(spark):
    got = by_id(licenses.scan(spark.createDataFrame([r[:2] for r in NOTICES], "doc_id long, text string")))
    assert {k: got[k][0].labels for k in got} == {r[0]: r[2] for r in NOTICES}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def variants(tree):
    """Texts that a parsed pattern matches, each choice and option taken in one of them at least."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            found = [chr(arg)]
        elif name == "IN":
            found = [chr(x) for _, x in arg]
        elif name == "BRANCH":
            found = [v for branch in arg[1] for v in variants(branch)]
        elif name == "SUBPATTERN":
            found = variants(arg[3])
        elif name == "MAX_REPEAT":
            found = ([""] if arg[0] == 0 else []) + variants(arg[2])
        else:
            assert name == "ASSERT"
            found = [""]
        # the first of all others beside each, and the last: not the whole product
        out = list(dict.fromkeys([o + found[0] for o in out] + [out[0] + f for f in found] + [out[-1] + f for f in found]))
    return out


def test_license_gates_are_necessary():
    assert not any(re.search(r"[^a-z]", s) for s in licenses.STEMS)
    for _, _, _, word, regex in licenses.RULES:
        for body in variants(re._parser.parse(regex)):
            padded = f" {body} "
            assert re.search(regex, padded), (regex, body)
            assert licenses._gate(word) in padded, (regex, body)
            assert any(s in body for s in licenses.STEMS), (regex, body)


def test_license_scan_without_the_word_license(spark):
    rows = [
        (1, "Released under GPLv3.", "gpl-3"), (2, "distributed under CC BY-SA 4.0", "cc-by-sa"), (3, "available under Apache 2.0", "apache-2"), (4, "dedicated to the public\ndomain", "public-domain"),
        (5, "licensed under MPLv2", "mpl-2"), (6, "FreeBSD license", "bsd-2-clause"), (7, "licensed under GPLv1", "gpl-1"), (8, "released in the wild", ""),
    ]
    got = by_id(licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")))
    assert {k: got[k][0].labels for k in got} == {r[0]: r[2] for r in rows}
    assert got[1][0].score == 0.9 and got[8][0].score == 0.0


def test_url_suffixes_of_several_labels(spark):
    want = {
        "a.foo.co.uk": ("foo.co.uk", "co.uk"), "foo.co.uk": ("foo.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:8080": ("x.com", "com"), "y.com:": ("y.com", "com"), "a.b.com.au:80": ("b.com.au", "com.au"),
        "me.github.io": ("me.github.io", "github.io"), "d.b.s3.amazonaws.com": ("b.s3.amazonaws.com", "s3.amazonaws.com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"),
        "[::1]:80": ("[::1]", "[::1]"), "www.x.org": ("x.org", "org"), "notco.uk": ("notco.uk", "uk"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", urls.domain(urls.F.col("h")).alias("d"), urls.suffix(urls.F.col("h")).alias("s"))
    assert {r.h: (r.d, r.s) for r in df.collect()} == want


def test_url_evidence_reaches_the_registrants_other_hosts(spark):
    pages = spark.createDataFrame([(1, "http://b.foo.co.uk/"), (2, "http://b.bar.co.uk/"), (3, "http://a.foo.co.uk/"), (4, "http://a.bar.co.uk/")], "page_id long, url string")
    outcomes = spark.createDataFrame([("http://a.foo.co.uk/", 1)] * 300 + [("http://a.bar.co.uk/", 0)] * 300, "url string, bad int")
    got = {r.page_id: r for r in urls.judge(pages, outcomes, rules=[]).collect()}
    assert got[1].bad_mean > 0.6 > 0.4 > got[2].bad_mean and got[3].verdict == "block" and got[4].verdict == "allow"
