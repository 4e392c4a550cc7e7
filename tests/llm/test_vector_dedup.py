from __future__ import annotations

import math

import numpy as np
import pytest

from loyalscope.llm.vector_dedup import Tile, near_vectors, products, quantised, sure_and_open, unit_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    """n_links and component of every row, by all pairs in double precision."""
    n = len(rows)
    ok = [i is not None and v is not None and len(v) > 0 and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
          for i, v, label in rows]
    scaled = [np.array(v) / np.abs(v).max() if good else None for (_, v, _), good in zip(rows, ok)]
    unit = [x if x is None else x / np.linalg.norm(x) for x in scaled]
    near = [[b for b in range(n) if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] >= threshold] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        component = min(rows[b][0] for b in seen) if rows[a][0] is not None else None
        out.append((rows[a][0], len(near[a]), component, rows[a][0] == component))
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.uniform(0.05, 0.6, (n, 1))
    return x * rng.uniform(0.01, 50, (n, 1))


@pytest.mark.parametrize("tile", [40, 1024])
def test_against_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    rows = [(int(i), x.tolist(), int(rng.integers(0, 3))) for i, x in zip(rng.permutation(600), clustered(600))]
    got = found(near_vectors(spark.createDataFrame(rows, SCHEMA), tile=tile))
    want = brute(rows)
    assert got == want
    assert 50 < sum(r[1] > 0 for r in want) and sum(not r[3] for r in want) > 50


def test_copies_chains_ties_and_rows_that_take_no_part(spark):
    c, d = ([math.cos(math.radians(x)), math.sin(math.radians(x))] for x in (20, 40))
    rows = [(5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (7, c, 1), (1, d, 1), (0, d, 2),
            (20, None, 1), (21, [], 1), (22, [0.0, -0.0], 1), (23, [1.0, None], 1), (24, [float("nan"), 1.0], 1), (25, [float("inf"), 1.0], 1),
            (26, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (27, [1.0, 0.0, 0.0], 1), (28, [1e300, 0.0], 3), (29, [1e-300, 0.0], 3),
            (30, [0.0, 1.0], 4), (31, [-0.0, 1.0], 4)] + [(100 + i, [0.3, 0.4], 5) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near_vectors(df, tile=8)) == brute(rows)
    assert brute(rows)[0][2] is not None and (5, 4, 1, False) in brute(rows)       # a chain of 20 degree steps under 21.6
    text = df.selectExpr("CAST(vec_id AS STRING) AS name", "embedding AS print", "CAST(label AS STRING) AS node", "1 AS weight")
    by_name = near_vectors(text, id_col="name", vector_col="print", label_col="node", tile=8)
    assert by_name.columns == ["name", "n_links", "component_id", "kept"]
    assert sorted(r.n_links for r in by_name.collect()) == sorted(r[1] for r in brute(rows))
    assert near_vectors(df.limit(0)).collect() == []


def tile_of(points):
    q, *rest = quantised(unit_vectors(points))
    n = len(points)
    return Tile(np.arange(n).tobytes(), np.ones(n, np.int64).tobytes(), q.tobytes(), np.concatenate(rest).tobytes())


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_bounds_hold_and_are_tight(dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(1, dim))
    a, b = (base + rng.normal(size=(200, dim)) * rng.uniform(0.1, 0.6, (200, 1)) for _ in range(2))
    cosine = unit_vectors(a) @ unit_vectors(b).T
    (i, j), (x, y) = sure_and_open(tile_of(a), tile_of(b), 0.9)
    assert (cosine[i, j] >= 0.9).all()
    rest = np.ones_like(cosine, bool)
    rest[i, j] = rest[x, y] = False
    assert (cosine[rest] < 0.9).all() and len(x) < 0.35 * cosine.size and (np.abs(cosine[x, y] - 0.9) < 0.06).all()
    q = rng.integers(-127, 128, (5, dim)).astype(np.int8)
    assert (products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_one_group_of_near_copies_sends_no_pairs(spark):
    """A group of 600 near copies: rows in proportion to the group, no open pair."""
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(32) + 0.02 * rng.normal(size=32)).tolist(), 0) for i in range(600)]
    got = found(near_vectors(spark.createDataFrame(rows, SCHEMA), tile=128))
    assert got == sorted(((i, 599, 0, i == 0) for i in range(600)), key=str)
