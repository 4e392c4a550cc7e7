from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa

from loyalscope.llm.substring_dedup import _count, bucket_edges, packed, sorted_order, substring_dedup, unpacked
from tests.llm.helpers import make_docs, real_docs


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def run(docs, width):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in
                   substring_dedup(docs, width=width).collect()), key=str)


def test_random_small_vocabulary(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", " \t\n", "a\x0bb\x0cc d\xa0e", texts[0], texts[0]]
    got = run(make_docs(spark, texts), 4)
    assert got == sorted(((i, *x) for i, x in enumerate(brute(texts, 4))), key=str)


def test_real_documents(spark):
    docs = real_docs(spark)
    rows = docs.collect()
    got = run(docs, 35)
    assert got == sorted(((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 35))), key=str)
    assert sum(x[2] for x in got) > 0


def test_one_long_text_repeating_itself(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    (row,) = substring_dedup(make_docs(spark, [f"{text} middle {text}"])).collect()
    assert (row.n_words, row.n_removed, row.kept_text) == (60_001, 60_000, "middle")
    assert [(r.start, r.end) for r in row.removed] == [(0, 30_000), (30_001, 60_001)]


def test_repeated_rows_null_ids_clashing_columns_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs(spark, [(None, text), (None, text), (1, "short"), (1, "short")])
    docs = docs.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "_block")
    rows = substring_dedup(docs).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 40, 40]
    assert substring_dedup(docs.limit(0)).collect() == []


def test_many_equal_rows_under_one_id_or_none(spark):
    """A third of all rows are one text, under NULL and under one id: they are answered in place, others still see their windows."""
    rnd = random.Random(4)
    hot = " ".join(f"h{i}" for i in range(60))
    own = [" ".join(f"x{rnd.randrange(10**9)}" for _ in range(50)) for _ in range(20)]
    rows = [(None, hot)] * 30 + [(5, hot)] * 30 + [(6, "three short words")] * 40
    rows += [(100 + i, t) for i, t in enumerate(own)] + [(200, f"before {hot[: hot.index('h50')]}behind"), (201, "three short words")]
    got = run(make_docs(spark, rows).repartition(3), 35)
    for size in (64, 1 << 10, 1 << 20):                # from every repeated row in place to none
        docs = make_docs(spark, rows).repartition(3)
        mine = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in
                       substring_dedup(docs, block_bytes=size, bucket_bytes=1 << 12).collect()), key=str)
        assert mine == got == sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 35))), key=str)
    spans = substring_dedup(make_docs(spark, rows), block_bytes=64).where("doc_id = 5").first().removed
    assert [(r.start, r.end) for r in spans] == [(0, 60)]


def test_equal_first_hashes_are_told_apart():
    """Windows that share the first hash but not the second are different ones, in a block and between blocks."""
    first, second = np.array([7, 9, 7, 7, 9], np.uint64), np.array([2, 1, 1, 2, 1], np.uint32)
    order, new = sorted_order(first, second)
    assert [(int(first[i]), int(second[i])) for i in order] == [(7, 1), (7, 2), (7, 2), (9, 1), (9, 1)]
    assert new.tolist() == [True, True, False, True, False]
    low, high = bucket_edges(3)[1:3]
    a = np.array([low, low + 5, high - 1], np.uint64)
    parts = [packed(a, np.array(x, np.uint32), low, high) for x in ([1, 2, 3], [1, 9, 3])]
    table = pa.table({"bucket": pa.array([1, 1], pa.int32()), "block": pa.array([4, 8], pa.int32()), "prints": pa.array(parts, pa.binary())})
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=3).tolist() for x in _count(3)((pa.scalar(1),), table).column("bits").to_pylist()]
    assert bits == [[1, 0, 1], [1, 0, 1]]


def test_packed_fingerprints_round_trip():
    rng = np.random.default_rng(3)
    for buckets in (1, 3, 77, 200_000):
        edges = bucket_edges(buckets)
        for b in (0, buckets // 2, buckets - 1):
            span = edges[b + 1] - edges[b]
            first = np.unique(np.array([edges[b] + int(x * span) for x in rng.random(500)] + [edges[b], edges[b + 1] - 1], np.uint64))
            first = first[(first >= np.uint64(edges[b])) & (first <= np.uint64(edges[b + 1] - 1))]
            second = rng.integers(0, 1 << 32, len(first), dtype=np.uint32)
            got = unpacked(packed(first, second, edges[b], edges[b + 1]), edges[b], edges[b + 1])
            assert (got[0] == first).all() and (got[1] == second).all() and len(got[0]) == len(first)


def test_packed_fingerprints_take_less_than_ten_bytes():
    low, high = bucket_edges(100)[7:9]                 # one of a hundred buckets, of a block of 650,000 windows
    rng = np.random.default_rng(5)
    first, second = np.sort(rng.integers(low, high, 6_500, dtype=np.uint64)), rng.integers(0, 1 << 32, 6_500, dtype=np.uint32)
    raw = packed(first, second, low, high)
    assert len(raw) < 9.9 * 6_500
    assert all((x == y).all() for x, y in zip(unpacked(raw, low, high), (first, second)))
    none = packed(first[:0], second[:0], low, high)
    assert [len(x) for x in unpacked(none, low, high)] == [0, 0]
    same = packed(np.repeat(first[:1], 5), second[:5], low, high)          # one first hash, many windows
    assert unpacked(same, low, high)[0].tolist() == [int(first[0])] * 5
