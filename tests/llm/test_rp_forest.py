from __future__ import annotations

import numpy as np
import pytest

from loyalscope.llm.rp_forest import RATIO, Bands, Forest, lengths, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    usable = {i: np.array(v, np.float32).astype(float) for i, v in rows
              if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, x in usable.items():
        if q % every == 0:
            scores = sorted(((-float(x @ y), i) for i, y in usable.items() if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def every20(i):
    return i % 20 == 0


@pytest.mark.parametrize("sf, leaf", [("sf0.01", 256), ("sf0.1", 128)])
def test_recall_on_given_vectors(spark, sf, leaf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), found(nearest(df, every20, leaf=leaf))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-9 for i, s in rows if i in exact)


def test_lengths_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 5)).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(150)]          # one vector many times
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] + [1.0] * 5),
             (1020, [float("inf")] * 6), (None, [1.0] * 6), (1040, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("label", "node")
    got, want = found(nearest(df, every20, leaf=32, recall=1.0)), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [0.0, 1.0], 0), (20, [0.0, 1.0], 0)], SCHEMA)
    assert {q: [i for i, _ in r] for q, r in found(nearest(df, every20)).items()} == {0: [1, 20], 20: [1, 0]}
    assert nearest(df.limit(0), every20).collect() == []


@pytest.mark.parametrize("lengths", ["outlier", "lognormal"])
def test_recall_does_not_depend_on_the_longest_vector(spark, lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "outlier":
        x[1_111] *= 100
    else:
        x *= np.exp(rng.normal(size=(4_000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), every20, leaf=256))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def fitted(x, k=20, recall=0.95, leaf=128):
    band = np.round(np.log(lengths(x)) / np.log(RATIO))
    buckets = [(lengths(x)[band == b].min(), lengths(x)[band == b].max(), int((band == b).sum())) for b in sorted(set(band), reverse=True)]
    forest = Forest(x, Bands(buckets, leaf), 12, leaf)
    forest.calibrate(x, k, recall)
    at = forest.route(x)
    pairs = np.stack([np.repeat(at[:, 0], at.shape[1]), at.ravel()], axis=1)
    forest.met(np.unique(pairs[pairs[:, 1] >= 0], axis=0))
    return forest, at


@pytest.mark.parametrize("kind", ["unit", "clustered", "lognormal"])
def test_search_stops_early_and_misses_no_candidate(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8_000, 64))
    if kind == "clustered":
        x = rng.normal(size=(80, 64))[rng.integers(0, 80, 8_000)] + 0.3 * x
    x /= lengths(x)[:, None]
    if kind == "lognormal":
        x *= np.exp(rng.normal(size=(8_000, 1)))
    forest, at = fitted(x)
    asked = np.arange(3, 8_000, 100)
    scores = forest.leaf_scores(x[asked])
    bars, estimates = forest.thresholds(scores), forest.estimates(scores, at)
    recall, seen = [], []
    for q, own, bar, estimate in zip(asked, scores, bars, estimates):
        truth = x @ x[q]
        truth[q] = -np.inf
        passed = estimate >= bar
        recall.append(passed[np.argpartition(truth, -20)[-20:]].mean())
        opened = np.isin(at[:, 0], forest.first_leaves(own, bar))
        assert opened[passed].all()
        seen.append((passed.mean(), opened.mean()))
    candidates, visited = np.mean(seen, axis=0)
    assert np.mean(recall) >= 0.9 and candidates <= {"unit": 0.34, "clustered": 0.05, "lognormal": 0.2}[kind]
    assert kind != "clustered" or visited < 0.6


def test_text_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    by_text = nearest(df.selectExpr("CAST(vec_id AS STRING) AS node", "embedding AS v"), lambda i: i.endswith("0"), id_col="node", vector_col="v", recall=1.0)
    by_number = nearest(df, lambda i: i % 10 == 0, recall=1.0)
    assert [tuple(map(str, r)) for r in by_text.orderBy("query_id", "rank").collect()] == [tuple(map(str, r)) for r in by_number.orderBy("query_id", "rank").collect()]
