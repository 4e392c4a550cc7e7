from __future__ import annotations

import itertools
import random
import re
from re import _parser as parser

from loyalscope.llm.licenses import BASE, detections, gates, normalise, rules, scan_licenses
from tests.llm.helpers import make_docs, real_docs

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), sorted((i, label) for phrase, label in BASE for i in range(len(words))
                              if words[i:i + len(phrase.split())] == phrase.split())


def base(r):
    return r.n_words, [(x.word, x.label) for x in r.base]


def labels_of(r):
    return [x.label for x in r.found]


def test_real_documents(spark):
    docs = real_docs(spark, "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(texts) and all(base(r) == brute(texts[r.doc_id]) for r in rows)
    assert sum(bool(r.base) for r in rows) > 5
    assert sum(bool(r.found) and not re.search("(?i)licen|copyright|rights|cc", texts[r.doc_id]) for r in rows) == 0


def test_rules_and_suppression(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0": ["apache-2.0"],
        "GNU Lesser General Public License v2.1 or later": ["lgpl-2.1"],
        "SPDX-License-Identifier: GPL-3.0-only": ["gpl-3.0"],
        "released under CC BY-NC-SA 4.0": ["cc-by-nc-sa"],
        "under the BSD 3-Clause License": ["bsd-3-clause"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": ["mit"],
        "All rights reserved.": ["all-rights-reserved"],
        "the mitigation licenseholder": [],
        "an ordinary sentence": [],
    }
    docs = make_docs(spark, list(cases))
    got = {r.doc_id: labels_of(r) for r in scan_licenses(docs).collect()}
    assert got == dict(enumerate(cases.values()))
    assert len(rules()) > 250 and len({(r.label, r.name) for r in rules()}) == len(rules())


def test_random_texts_and_edges(spark):
    rnd = random.Random(6)
    parts = ["GNU", "general", "Public", "license", "License", "apache", "mit", "MIT", "cc", "CC", "by", "é", "ü1", "x"]
    texts = [rnd.choice([" ", "-", "\n", ", "]).join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(300)]
    texts += [None, "", "   ", "cc by cc by cc-by", "mit license mit license", "İ K ſ MIT License", "a" * 10**6, "MIT License " * 20_000]
    docs = make_docs(spark, texts).withColumnRenamed("lang", "found").withColumnRenamed("source", "base")
    rows = scan_licenses(docs).collect()
    assert {r.doc_id: base(r) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
    assert all(0 <= x.start < x.end <= r.n_words for r in rows for x in r.found)
    assert scan_licenses(docs.limit(0)).collect() == []
    rows = scan_licenses(make_docs(spark, [(None, "cc by"), (None, "cc by")])).collect()
    assert [base(r) for r in rows] == [(2, [(0, "cc-by")])] * 2


def variants(tree, most=100):
    """Texts that a pattern matches: branches, repeats at their least and once more; ``most`` of them, evenly spread."""
    texts = [""]
    for kind, value in tree:
        if kind is parser.LITERAL:
            some = [chr(value)]
        elif kind is parser.IN:
            first, x = value[0]
            some = [chr(x if first is parser.LITERAL else x[0]) if first is not parser.CATEGORY else "7"]
        elif kind is parser.ANY:
            some = ["x"]
        elif kind is parser.SUBPATTERN:
            some = variants(value[-1], most)
        elif kind is parser.BRANCH:
            some = [t for branch in value[1] for t in variants(branch, most)]
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            low, high, inner = value
            some = [t for n in range(low, min(high, low + 1) + 1) for t in map("".join, itertools.product(variants(inner, most), repeat=n))]
        else:
            assert kind in (parser.ASSERT, parser.AT), kind
            some = [""]
        texts = [a + b for a, b in itertools.product(texts, some)]
        texts = texts[::-(-len(texts) // most)]
    return texts


def test_every_rule_is_reached_by_each_of_its_texts():
    by_keywords = [(last, first, r) for last, own in gates() for first, r in own]
    assert len(by_keywords) == len(rules())
    for last, first, r in by_keywords:
        texts = variants(parser.parse(r.pattern.pattern.decode()))
        assert texts
        for words in texts:
            text = words.encode() + b" "
            assert r.pattern.search(text), (r, text)
            assert any(k in text for k in last) and any(k in text for k in first), (r, text)
        assert any(r in [x for *_, x in detections(w.encode() + b" ")] for w in texts), r


def test_texts_without_a_common_license_word():
    cases = {
        "Released under GPL v3": "gpl-3.0", "distributed under the terms of the MPL 2.0": "mpl-2.0", "available under BSD 3-Clause": "bsd-3-clause",
        "https://creativecommons.org/publicdomain/zero/1.0/": "cc0", "for non-commercial use only": "non-commercial",
        "unauthorized copying of this file is strictly prohibited": "proprietary", "the terms of the MPL 2.0": "mpl-2.0",
        "neither the name of X nor the names of its contributors may be used to endorse or promote": "bsd-3-clause",
    }
    for text, label in cases.items():
        assert [r.label for *_, r in detections(b" " + b" ".join(normalise(text.encode())) + b" ")] == [label], text


def test_a_bare_name_is_no_grant():
    for text in ("provided by Ruby", "published by Elastic in May", "provided by the boost programme", "distributed by Apache helicopters",
                 "made available by MIT", "released under Python 3 supervision by php"):
        labels = [r.label for *_, r in detections(b" " + b" ".join(normalise(text.encode())) + b" ")]
        assert labels == (["python"] if "Python 3" in text else []), (text, labels)
    for text, label in (("licensed under MIT", "mit"), ("provided under the Ruby license", "ruby"), ("covered by the PostgreSQL License", "postgresql")):
        assert label in [r.label for *_, r in detections(b" " + b" ".join(normalise(text.encode())) + b" ")], text


def test_gates_and_suppression_against_all_rules_and_all_pairs():
    rnd = random.Random(12)
    parts = ["gnu", "general", "public", "license", "lesser", "library", "apache", "software", "version 2", "2 0", "mit", "under", "by", "the", "terms of", "licensed",
             "released", "cc", "by sa", "nc", "creative commons", "attribution", "gpl", "v3", "bsd", "3 clause", "spdx license identifier", "or later", "all rights reserved",
             "copyright 2020", "acme", "mozilla public license", "elastic", "ruby", "copyleft", "public domain", "word", "this is free and unencumbered software released into the public domain"]
    every, gated, hits = rules(), gates(), 0
    for _ in range(300):
        text = b" " + b" ".join(normalise(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(3, 25))).encode())) + b" "
        found = [(m.start() + 1, m.end(), r) for r in every for m in r.pattern.finditer(text)]

        def beats(o, m):
            inside = o[0] <= m[0] and m[1] <= o[1]
            return inside and (o[2].priority > m[2].priority or o[2].priority == m[2].priority and (
                o[1] - o[0] > m[1] - m[0] or o[1] - o[0] == m[1] - m[0] and (o[2].label, o[2].name) < (m[2].label, m[2].name)))

        want = sorted(((lo, hi, r.label, r.name) for lo, hi, r in found if not any(beats(o, (lo, hi, r)) for o in found)))
        starts = [i for i, c in enumerate(text) if c == 32]
        want = sorted((starts.index(lo - 1), starts.index(hi), label, name) for lo, hi, label, name in want)
        assert [(a, b, r.label, r.name) for a, b, r in detections(text, gated)] == want, text
        hits += len(want)
    assert hits > 500
