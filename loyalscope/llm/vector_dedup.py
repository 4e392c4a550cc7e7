"""Embedding near-dedup: int8 tile products with rigorous bounds, full precision only where the bounds leave it open.

1. Equal vectors of a label become one node with its number of rows, so copies of a vector that a third of
   all rows share are one row from here on.
2. The nodes of a label (and dimension) are dealt into tiles of about ``tile`` nodes by their measured number. A unit vector x
   travels as int8 numbers q, its scale s and the exact length e of what rounding lost: x = q / s + lost, |lost| = e.
3. Every two tiles of a label meet once. With x' = q / s the product of x and y lies within |x'| e_y + e_x of
   that of x' and y' (Cauchy-Schwarz), so a pair is linked for sure, not linked for sure, or open.
4. Links for sure are counted in place, and of each tile pair's links only a spanning forest leaves the task, so a
   group of m near copies sends 2 m rows and not m * m. Open pairs are recomputed in double precision.
5. Components come from the forests and the recomputed links, in Spark.

The work is quadratic in the largest label, as the method is; no pair of rows is ever shuffled but the open ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.common import shuffle_partitions, stored
from loyalscope.llm.components import connected_components

#: What rounding of double precision sums may add to a bound.
SLACK = 1e-9
#: Dimensions whose int8 products float32 sums exactly (1,024 * 127 * 127 < 2**24).
EXACT_DIMENSIONS = 1024


def unit_vectors(points: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    points = points / np.abs(points).max(axis=1)[:, None]
    return points / np.sqrt((points * points).sum(axis=1))[:, None]


def quantised(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, 1 / scale, length of the rounded vector and length of the error of every unit vector."""
    step = np.abs(points).max(axis=1) / 127
    q = np.rint(points / step[:, None]).astype(np.int8)
    rounded = q * step[:, None]
    lost = points - rounded
    return q, step, np.sqrt((rounded * rounded).sum(axis=1)), np.sqrt((lost * lost).sum(axis=1)) + SLACK


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, in double precision."""
    out = np.zeros((len(q), len(p)))
    for lo in range(0, q.shape[1], EXACT_DIMENSIONS):
        out += q[:, lo:lo + EXACT_DIMENSIONS].astype(np.float32) @ p[:, lo:lo + EXACT_DIMENSIONS].astype(np.float32).T
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the links ``i`` to ``j``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pack(batches):
    """(id, label, print, vec): the vector as doubles with a fingerprint, or neither where it takes no part."""
    for b in batches:
        prints, vecs = [], []
        for i, label, x in zip(b.column(0), b.column(1), b.column(2)):
            raw = None
            if i.is_valid and label.is_valid and x.is_valid and len(x) and not x.values.null_count:
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0        # -0.0 becomes 0.0
                if np.isfinite(v).all() and v.any():
                    raw = v.tobytes()
            vecs.append(raw)
            prints.append(raw and xxhash.xxh3_128_digest(raw))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary()), pa.array(vecs, pa.binary())],
                                         names=["id", "label", "print", "vec"])


def _tile(key, table):
    """One row per tile: nodes, weights, int8 numbers, and their scales, lengths and errors."""
    raw = table.column("vec").to_pylist()
    q, *rest = quantised(unit_vectors(np.frombuffer(b"".join(raw)).reshape(len(raw), -1)))
    own = [np.asarray(table.column(c), np.int64).tobytes() for c in ("node", "weight")]
    return pa.table({"grp": [key[0].as_py()], "tile": pa.array([key[1].as_py()], pa.int32()),
                     "tiles": table.column("tiles").slice(0, 1),
                     "nodes": pa.array([own[0]], pa.binary()), "weights": pa.array([own[1]], pa.binary()),
                     "q": pa.array([q.tobytes()], pa.binary()), "reals": pa.array([np.concatenate(rest).tobytes()], pa.binary())})


class Tile:
    def __init__(self, nodes: bytes, weights: bytes, q: bytes, reals: bytes):
        self.nodes, self.weights = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64)
        n = len(self.nodes)
        self.q = np.frombuffer(q, np.int8).reshape(n, -1)
        self.step, self.length, self.error = np.frombuffer(reals).reshape(3, n)


def sure_and_open(a: Tile, b: Tile, threshold: float, rows: int = 256):
    """Index pairs whose cosine is at least ``threshold`` for sure, and those that the bounds leave open."""
    sure, left = [], []
    for lo in range(0, len(a.nodes), rows):
        part = slice(lo, lo + rows)
        near = products(a.q[part], b.q) * a.step[part, None] * b.step
        slack = a.length[part, None] * b.error + a.error[part, None] + SLACK
        if a is b:
            near[np.arange(len(near))[:, None] + lo >= np.arange(len(b.nodes))] = -4     # each pair once
        for out, hit in ((sure, near - slack >= threshold), (left, np.abs(near - threshold) <= slack)):
            i, j = np.nonzero(hit)
            out.append((i + lo, j))
    return tuple(tuple(map(np.concatenate, zip(*x))) for x in (sure, left))


def _meet(threshold: float):
    """(kind, a, b, n) of two tiles: 0 node ``a`` has sure links to ``n`` rows, 1 a link of the forest, 2 an open pair."""
    def rows_of(a: Tile, b: Tile):
        (i, j), (x, y) = sure_and_open(a, b, threshold)
        one = a is b
        nodes, weights = (a.nodes, a.weights) if one else (np.concatenate([a.nodes, b.nodes]), np.concatenate([a.weights, b.weights]))
        j, y = (j, y) if one else (j + len(a.nodes), y + len(a.nodes))
        count = np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes))
        some = np.flatnonzero(count)
        root = roots(len(nodes), i, j)
        child = np.flatnonzero(root != np.arange(len(nodes)))
        sizes = [len(some), len(child), len(x)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(3, dtype=np.int32), sizes)), pa.array(np.concatenate([nodes[some], nodes[child], nodes[x]])),
            pa.array(np.concatenate([nodes[some], nodes[root[child]], nodes[y]])),
            pa.array(np.concatenate([count[some].astype(np.int64), np.zeros(sizes[1] + sizes[2], np.int64)]))], names=["kind", "a", "b", "n"])

    def run(batches):
        pair, first = None, None
        for batch in batches:
            for at, (grp, lo, hi, side, *tile) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                own = Tile(*tile)
                if lo == hi:
                    yield rows_of(own, own)
                elif side == 0:
                    pair, first = (grp, lo, hi), own
                else:
                    assert pair == (grp, lo, hi)
                    yield rows_of(first, own)
    return run


def _cosines(threshold: float):
    """The pairs (a, b, weights) whose cosine in double precision is at least ``threshold``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (unit_vectors(np.frombuffer(b"".join(c), np.float64).reshape(b.num_rows, -1)) for c in (b.column(4).to_pylist(), b.column(5).to_pylist()))
                yield b.select([0, 1, 2, 3]).filter(pa.array((x * y).sum(axis=1) >= threshold))
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", tile: int = 1024) -> DataFrame:
    """``id_col``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable, itself included), ``kept``.

    Rows are linked if their labels are equal and not NULL and the cosine of their vectors in double precision is
    ``threshold`` or more. One row per input row, ids of any ordered type.

    A vector that is NULL, empty, zero or holds NULL or non-finite components links with nothing, nor does a row
    without a label. A row without an id takes no part either; its component is NULL and it is kept. Vectors of
    different dimensions are not compared. Repeated rows and rows that share an id are rows of their own (a row is
    linked with its copies). An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    rows = stored(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
                  .mapInArrow(_pack, f"id {kind}, label {label_kind}, print binary, vec binary"), "rows")
    # copies are counted before the shuffle; numbers are given once, in a stored table
    classes = (rows.where("vec IS NOT NULL").groupBy("label", "print")
               .agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("vec").alias("vec")))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("vec")), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.min("node").alias("grp"))
    dealt = (nodes.join(sizes, ["label", "dim"]).select("grp", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), "tiles", "node", "weight", "vec"))
    tiles = stored(dealt.groupBy("grp", "tile").applyInArrow(_tile, "grp long, tile int, tiles int, nodes binary, weights binary, q binary, reals binary"), "tiles")
    meetings = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "grp", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), (F.col("tile") > F.col("other")).cast("int").alias("side"),
        "nodes", "weights", "q", "reals")
    met = stored(meetings.repartition(parts, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "side")
                 .mapInArrow(_meet(threshold), "kind int, a long, b long, n long"), "met")

    def full(side: str) -> DataFrame:
        return nodes.select(F.col("node").alias(side), F.col("weight").alias(f"w{side}"), F.col("vec").alias(f"v{side}"))

    left = met.where("kind = 2").select("a", "b").join(full("a"), "a").join(full("b"), "b").select("a", "b", "wa", "wb", "va", "vb")
    exact = stored(left.mapInArrow(_cosines(threshold), "a long, b long, wa long, wb long"), "exact")
    counts = (met.where("kind = 0").select(F.col("a").alias("node"), "n")
              .unionByName(exact.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("wb").alias("n")),
                                                          F.struct(F.col("b").alias("node"), F.col("wa").alias("n")))).alias("x")).select("x.*"))
              .groupBy("node").agg(F.sum("n").alias("n")))
    links = stored(met.where("kind = 1").select("a", "b").unionByName(exact.select("a", "b")), "links")
    labels = connected_components(links).select("node", F.col("label").alias("root"))
    grouped = stored(nodes.select("label", "print", "node", "weight", "least").join(labels, "node", "left")
                     .withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left"), "grouped")
    least = grouped.groupBy("root").agg(F.min("least").alias("component"))
    known = grouped.join(least, "root").select("label", "print", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    component = F.coalesce("component", "id")
    return rows.join(known, ["label", "print"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
