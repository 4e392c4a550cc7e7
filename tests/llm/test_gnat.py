from __future__ import annotations

import math

import numpy as np
import pytest

from loyalscope.llm.gnat import Lift, Tree, exact_scores, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, scale=256):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or None in v or not np.isfinite(v).all() or max(map(abs, v)) * scale >= 1 << 24:
            continue
        x = (label, [math.floor(scale * c) for c in v])
        best[i] = min(best.get(i, x), x)
    out = []
    for a, (label, x) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in best.items() if i != a)
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            p = -minus
            inside = [(-s, i) for s, i, other in scored if other != label and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(a, positive, r, i, p, s) for r, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def every100(i):
    return i % 100 == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = found(hard_negatives(df, every100, bin_rows=300))
    assert got == brute(rows) and got


def test_clustered_vectors_of_any_length(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    x = (centres[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 8))) * rng.lognormal(0, 0.5, (3000, 1))
    rows = [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in zip(rng.permutation(3000), x)]
    got = found(hard_negatives(spark.createDataFrame(rows, SCHEMA), every100, leaf=16, bin_rows=200))
    assert got == brute(rows) and len(got) > 500


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = [(i, [0.5, 0.25, 0.0], i % 3) for i in range(0, 1200, 4)]                         # copies in every label, anchors among them
    rows += [(i, [0.5, -0.25 + 0.001 * (i % 5), 0.3], i % 2) for i in range(1, 300, 4)]
    rows += [(2000, [-1.0, -1.0, -1.0], 0), (2100, [0.0, 0.0, 0.0], 1), (2200, None, 1), (2300, [1.0, None, 1.0], 1), (2400, [float("nan")] * 3, 1),
             (2500, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (2600, [1e6, 1.0, 1.0], 1), (2700, [float("inf")] * 3, 0), (2800, [0.1] * 3, 9),
             (2900, [0.2, 0.2, 0.2], 1), (2900, [0.2, 0.2, 0.2], 1), (3000, [0.9, 0.1, 0.1], 2), (3000, [0.4, 0.1, 0.1], 1), (3100, [60000.0, -3.0, 0.5], 1)]
    df = spark.createDataFrame(rows + [(5000, [1.0, 2.0], 1), (5001, [], 1)], SCHEMA)
    got = found(hard_negatives(df, every100, leaf=8, bin_rows=50))
    assert got == brute(rows)
    assert found(hard_negatives(df.limit(0), every100)) == [] == found(hard_negatives(df.where("vec_id = 2800"), every100))
    other = df.selectExpr("CAST(label AS STRING) AS node", "vec_id AS print", "embedding AS ids", "1 AS score")
    assert found(hard_negatives(other, every100, id_col="print", vector_col="ids", label_col="node", leaf=8)) == got


def test_tree_leaves_out_only_what_ranges_rule_out_and_does_leave_out():
    rng = np.random.default_rng(7)
    centres = rng.integers(-200, 200, size=(64, 6))
    x = centres[rng.integers(0, 64, 4000)] + rng.integers(-6, 7, size=(4000, 6))
    lift = Lift(int((x * x).sum(axis=1).max()))
    tree = Tree(lift.points(x[:1000]), 8, 32)
    leaves = tree.route(lift.points(x))
    tree.measure(lift.points(x), leaves)
    queries = x[::100]
    scores = exact_scores(queries, x)
    high = np.sort(scores, axis=1)[:, -10]
    low = np.ceil(0.97 * high)
    norm2 = (queries.astype(float) ** 2).sum(axis=1)
    near, far = lift.distance(norm2, high) - lift.slack, lift.distance(norm2, low) + lift.slack
    meets = tree.meet(lift.queries(queries), near[:, None], far[:, None])
    wanted = (scores >= low[:, None]) & (scores <= high[:, None])
    for q in range(len(queries)):
        assert meets[q, leaves[wanted[q]]].all()
    assert meets.mean() < 0.6 and len(tree.paths) > 30


def test_large_integers_stay_exact():
    a = np.array([[(1 << 24) - 1] * 64], np.int32)
    assert exact_scores(a, -a)[0, 0] == -64 * ((1 << 24) - 1) ** 2
