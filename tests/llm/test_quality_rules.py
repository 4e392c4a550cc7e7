from __future__ import annotations

import math
import random
import re

import pytest

from loyalscope.llm.quality_rules import CLASSES, COMMON, quality_rules
from tests.llm.helpers import make_docs, real_docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, at = {}, {}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    for w in windows:
        at[w] = at.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if at[w] > 1 for j in range(i, i + 3)}
    dup = 0
    for x in lines:
        dup += x in seen
        seen[x] = 1
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_real_documents(spark):
    docs = real_docs(spark, "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = quality_rules(docs).collect()
    assert len(rows) == len(texts) and all(base(r) == brute(texts[r.doc_id]) for r in rows)
    assert all(0 <= d <= 1 for r in rows for d in (r.class_distance, r.word_distance))
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(r.kept for r in clean) > 0.98 * len(clean) and sum(not r.kept for r in junk) > 0.5 * len(junk)


def test_random_texts(spark):
    rnd = random.Random(4)
    parts = ["a", "b", "c", "dé", "\U0001f600#", "*", " ", " ", " ", "\n", "\t", "\x0b", "\x0c\r", "\xa0", "\x00", "'"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(200))) for _ in range(200)]
    texts += [None, "", " ", "a", "a b", "a a a", "x y z x y z", "a\n a\na\n\n\n \n a", "w " * 60_000]
    docs = make_docs(spark, texts, lang=None).withColumnRenamed("source", "t").withColumnRenamed("n_chars", "w")
    rows = quality_rules(docs).collect()
    assert {r.doc_id: base(r) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("lang", ["lang", None])
def test_empty_table_and_repeated_rows(spark, lang):
    docs = make_docs(spark, [(None, "a b"), (None, "a b"), (2, "x " * 80)])
    assert quality_rules(docs.limit(0), lang_col=lang).collect() == []
    assert sorted(str(base(r)) for r in quality_rules(docs, lang_col=lang).collect()) == sorted(str(brute(t)) for t in ("a b", "a b", "x " * 80))


@pytest.mark.parametrize("russian", [100, 8])
def test_every_language_has_its_own_reference(spark, russian):
    rnd = random.Random(russian)

    def text(letters):
        return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(150)) + "."

    rows = [(i, text("abcdefghijklmnoprstuwyząćęłńóśźż"), "pl") for i in range(400)] + [(1000 + i, text("абвгдежзийклмнопрстуфхцчшщыьэюя"), "ru") for i in range(russian)]
    rows += [(2000, text("0123456789#*$"), "ru"), (3000, text("абвг"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    assert kept == {r[0] for r in rows} - {2000}


def distance(p, q):
    def half(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def test_distances_against_a_plain_version(spark):
    docs = real_docs(spark)
    texts = {r.doc_id: (r.text or "", r.lang or "") for r in docs.collect()}
    shares = {}
    for i, (text, lang) in texts.items():
        n, words = max(len(text), 1), re.findall(r"[^\x20\x09-\x0D]+", text)
        classes = [sum(map(len, re.findall(p, text))) / n for p in CLASSES.values()] + [(len(text) - sum(map(len, words))) / n]
        common = COMMON.get(lang, COMMON["en"])
        own = [sum(w.lower() == c for w in words) / max(len(words), 1) for c in common]
        shares[i] = [x + [max(0, 1 - sum(x))] for x in (classes, own)]
    passed = [i for i, (text, _) in texts.items() if not brute(text)[5]]
    for r in quality_rules(docs).collect():
        like = [shares[i] for i in passed if texts[i][1] == texts[r.doc_id][1]]
        for k, got in enumerate((r.class_distance, r.word_distance)):
            mean = [sum(x) / len(like) for x in zip(*(s[k] for s in like))]
            assert abs(got - distance(shares[r.doc_id][k], mean)) < 1e-6
        far = r.n_words >= 50 and r.class_distance > 0.3 or texts[r.doc_id][1] in COMMON and r.n_words >= 100 and r.word_distance > 0.55
        assert r.kept == (not r.base_failed and not far)
