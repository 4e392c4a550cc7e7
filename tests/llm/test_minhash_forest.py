from __future__ import annotations

import random

import pytest

from loyalscope.llm.components import connected_components
from loyalscope.llm.minhash_forest import near_duplicates
from tests.llm.helpers import make_docs, real_docs


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(docs, width, share=80):
    sets = {d: shingles(t, width) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    for a, s in sets.items():
        for b in {y for x in s for y in by_shingle[x] if y < a}:
            both = len(s & sets[b])
            if 100 * both >= share * (len(s) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


def result(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **options).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_real_documents(spark, width):
    docs = real_docs(spark, "sf0.01")
    want = brute({r.doc_id: r.text for r in docs.collect()}, width)
    assert sum(not x[2] for x in want.values()) > 20
    assert result(docs, width=width) == want


def test_one_large_group_of_near_copies_and_a_shared_passage(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(400):                     # edits of one text: some pairs are above 0.8, some below
        words = list(base)
        for _ in range(rnd.randrange(0, 14)):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    for i in range(200):                     # much in common, but not alike
        texts.append(" ".join(passage + [f"x{rnd.randrange(10**6)}" for _ in range(60)]))
    texts += [texts[0]] * 30 + ["a", "a", "A", "b", None, "", "  ", "two words", "Two  Words", "two words more"]
    docs = make_docs(spark, texts)
    want = brute(dict(enumerate(texts)), 2)
    got = result(docs, width=2, region=16, block=32)
    assert {d: g for d, g in got.items() if g != want[d]} == {}


def test_null_ids_repeated_rows_clashing_columns_and_empty_table(spark):
    docs = make_docs(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "a b c"), (9, None)])
    docs = docs.withColumnRenamed("lang", "component_id").withColumnRenamed("source", "print")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width=2).collect()), key=str)
    assert rows == sorted([(None, 2, None, True), (7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, 1000: 1000, 1001: 1000}


def test_text_ids(spark):
    """Ids that are no integers: the same classes, named by the smallest id in text order; NULL and repeated ids."""
    base = [f"w{i}" for i in range(40)]
    rows = [("b10", " ".join(base)), ("b9", " ".join(base[:-1] + ["x"])), ("a", "quite another text of its own"), ("c", ""), ("d", None),
            (None, " ".join(base)), ("e", " ".join(base)), ("e", "quite another text of its own"), ("f", "nothing alike here at all")]
    docs = spark.createDataFrame(rows, "name string, body string")
    got = sorted(near_duplicates(docs, "name", "body").collect(), key=lambda r: (r[0] or "", r[1]))
    assert [(r.name, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (None, 36, None, True), ("a", 2, "a", True), ("b10", 36, "b10", True), ("b9", 36, "b10", False), ("c", 0, "c", True),
        ("d", 0, "d", True), ("e", 2, "a", False), ("e", 36, "b10", False), ("f", 1, "f", True)]
    assert near_duplicates(docs.limit(0), "name", "body").collect() == []
