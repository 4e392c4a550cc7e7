"""Approximate nearest neighbours: a forest of random-projection trees, searched through one queue that stops.

1. Equal vectors collapse into one (with its smallest ids, as many as a result can hold), so a vector
   that a third of all rows share is one point.
2. Vectors are dealt into bands of similar length, so that one long vector does not steer the others. In a
   band, points are scaled by the longest and an extra component makes all equally long, which turns inner
   products into nearest neighbours. Every band has its own trees, fitted on a bounded sample: a node splits
   its points at the median of a random projection, down to ``leaf`` points; a band of fewer is one leaf.
3. Every point is routed to its leaf in every tree of its band. Every leaf has a guide, made from the mean of its sample points,
   such that the sum of a query's products with the guides of a point's leaves estimates the point's score: all trees
   together say how promising a point is, and each candidate is scored once.
4. Calibration on the sample: for some of its points the exact neighbours are known, and so is the share of all points that
   an estimate as low as a neighbour's would let pass. The share that keeps ``recall`` of the neighbours
   is every query's: its threshold is that quantile of its own estimates over sample points.
5. A query opens leaves of all trees and bands through one queue, best first, and stops when no unopened point of a
   band can reach the threshold. Points lie in bins by their leaf of the first tree; a query goes once to each
   bin it opened, where points at the threshold or above are candidates: their inner products are ranked exactly, in double precision.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalscope.llm.common import received, shipped, shuffle_partitions, stored
from loyalscope.llm.gnat import best, leaf_bins
from loyalscope.llm.samples import hashed_sample

#: Candidates beyond ``k`` that outlive rounding differences, and queries that a worker compares at once.
SPARE, BATCH = 4, 64
#: Leaves of a tree that are opened at once.
STEP = 8
#: Lengths in a band differ by this factor at most, unless the band is one leaf.
RATIO = 1.25
#: Sample points that calibrate, and sample points whose estimates give a query's threshold.
ASKED, PROBES = 128, 4096
# Fixed value: no tree.
ABSENT = np.iinfo(np.int32).min


class Bands:
    """Ranges of lengths, longest first: ``low`` and ``top`` length and number of ``rows`` of each."""

    def __init__(self, buckets: list[tuple[float, float, int]], least: int):
        """``buckets``: (low, top, rows), longest first; neighbours join up to ``least`` rows."""
        joined: list[list] = []
        for low, top, rows in buckets:
            if joined and joined[-1][2] + rows <= least:
                joined[-1][0], joined[-1][2] = low, joined[-1][2] + rows
            else:
                joined.append([low, top, rows])
        self.low, self.top, self.rows = (np.array(x, float) for x in zip(*joined))

    def of(self, points: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(-self.low, -lengths(points)), len(self.low) - 1)

    def lift(self, points: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Points over their band's longest, with the component that brings them to length 1."""
        scaled = points / self.top[band][:, None]
        return np.hstack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))[:, None]])


def lengths(points: np.ndarray) -> np.ndarray:
    peak = np.abs(points).max(axis=1)
    return peak * np.sqrt(((points / peak[:, None]) ** 2).sum(axis=1))


class Forest:
    """Trees as arrays: node i has planes[i], cuts[i] and children; a negative child is leaf -1 - child.

    ``roots`` by band and tree.
    """

    def __init__(self, points: np.ndarray, bands: Bands, trees: int, leaf: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bands, self.trees = bands, trees
        self.planes, self.cuts, self.children, self.leaves = [], [], [], 0
        self.roots = np.full((len(bands.rows), trees), ABSENT, np.int32)
        at, dim = bands.of(points), points.shape[1] + 1
        points = bands.lift(points, at)
        for band in range(len(bands.rows)):
            own = np.flatnonzero(at == band)
            for t in range(trees if len(own) > leaf else 1):
                self.roots[band, t] = self._grow(points, own, leaf, rng)
        self.planes = np.array(self.planes, np.float32).reshape(-1, dim)
        self.cuts = np.array(self.cuts, np.float32)
        self.children = np.array(self.children, np.int32).reshape(-1, 2)

    def _grow(self, points, at, leaf, rng) -> int:
        if len(at) > leaf:
            plane = rng.normal(size=points.shape[1])
            side = points[at] @ plane
            cut = float(np.median(side))
            left, right = at[side <= cut], at[side > cut]
            if len(left) and len(right):
                i = len(self.planes)
                self.planes.append(plane)
                self.cuts.append(cut)
                self.children.append(None)
                self.children[i] = (self._grow(points, left, leaf, rng), self._grow(points, right, leaf, rng))
                return i
        self.leaves += 1
        return -self.leaves

    def margins(self, points: np.ndarray) -> np.ndarray:
        return points.astype(np.float32) @ self.planes.T - self.cuts

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point in every tree of its band, -1 where the band has fewer trees."""
        out = np.empty((len(points), self.trees), np.int32)
        for lo in range(0, len(points), 512):
            band = self.bands.of(points[lo:lo + 512])
            margin = self.margins(self.bands.lift(points[lo:lo + 512], band))
            rows = np.arange(len(margin))
            for t in range(self.trees):
                node = self.roots[band, t]
                while (inner := node >= 0).any():
                    at = node[inner]
                    node[inner] = self.children[at, (margin[rows[inner], at] > 0).astype(np.int8)]
                out[lo:lo + 512, t] = np.where(node == ABSENT, -1, -1 - np.maximum(node, -self.leaves))
        return out

    def calibrate(self, points: np.ndarray, k: int, recall: float) -> None:
        """Guides of the leaves, and the share of points that keeps ``recall`` of the ``k`` nearest of sample points."""
        at, band = self.route(points), self.bands.of(points)
        self.whole = np.zeros(self.leaves, bool)                     # leaves of bands without trees: always open
        self.first = np.zeros(len(self.bands.rows), np.int64)        # trees of each band
        guides = np.zeros((self.leaves, points.shape[1]))
        for b, roots in enumerate(self.roots):
            own = np.flatnonzero(band == b)
            self.first[b] = (roots != ABSENT).sum()
            if self.first[b] == 1 and roots[0] < 0:
                self.whole[-1 - roots[0]] = True
                continue
            mean = points[own].mean(axis=0)
            sums, count = np.zeros_like(guides), np.bincount(at[own].ravel(), minlength=self.leaves)[:, None]
            for t in range(self.trees):
                np.add.at(sums, at[own, t], points[own])
            used = np.flatnonzero(count)
            off = sums[used] / count[used] - mean
            # how much of a score the trees' offsets explain: least squares over pairs of sample points
            asked = points[own[:ASKED]]
            estimate = (asked @ off.T)[:, np.searchsorted(used, at[own[:PROBES]])].sum(axis=2)
            truth = (asked @ (points[own[:PROBES]] - mean).T)
            apart = np.arange(len(asked))[:, None] != np.arange(estimate.shape[1])
            power = (estimate[apart] ** 2).sum()
            slope = float((estimate[apart] * truth[apart]).sum() / power) if power else 0.0
            guides[used] = slope * off + mean / self.trees
        self.guides = guides.astype(np.float32)
        self.probes = at[:PROBES]
        self.share = 1.0
        asked = points[:ASKED]
        estimate = self.estimates(self.leaf_scores(asked), at)
        truth = asked @ points.T
        passed = []
        for q in range(len(asked)):
            truth[q, q] = -np.inf
            near = np.argpartition(truth[q], -k)[-k:] if len(points) > k else np.arange(len(points))
            order = np.sort(estimate[q])
            passed.append(1 - np.searchsorted(order, estimate[q, near[near != q]]) / len(order))
        if len(points) > k + 1:
            self.share = float(min(1.0, np.quantile(np.concatenate(passed), recall) + 1 / len(points)))

    def leaf_scores(self, queries: np.ndarray) -> np.ndarray:
        scores = queries.astype(np.float32) @ self.guides.T
        scores[:, self.whole] = np.inf
        return scores

    @staticmethod
    def estimates(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By query and point, from the scores of the point's leaves (-1: none)."""
        out = np.zeros((len(scores), len(at)), np.float32)
        for t in range(at.shape[1]):
            out += np.where(at[:, t] >= 0, scores[:, at[:, t]], 0)
        return out

    def thresholds(self, scores: np.ndarray) -> np.ndarray:
        if self.share >= 1 or not len(self.probes):
            return np.full(len(scores), -np.inf, np.float32)
        return np.quantile(self.estimates(scores, self.probes), 1 - self.share, axis=1, method="lower").astype(np.float32)

    def open(self, scores: np.ndarray, threshold: float) -> list[int]:
        """Leaves of one query, best first, from one queue over all trees and bands. A band is done when a point in none
        of its opened leaves has an estimate below ``threshold``."""
        queue, ahead, opened = [], np.zeros(len(self.first)), []
        for b, lists in enumerate(self.by_tree):
            for t, leaves in enumerate(lists):
                order = leaves[np.argsort(-scores[leaves], kind="stable")]
                ahead[b] += scores[order[0]]
                heapq.heappush(queue, (-float(scores[order[0]]), b, t, 0, order))
        while queue:
            _, b, t, i, order = heapq.heappop(queue)
            if ahead[b] < threshold:
                continue
            after = i + STEP
            opened += order[i:after].tolist()
            if after < len(order):
                ahead[b] += scores[order[after]] - scores[order[i]]
                heapq.heappush(queue, (-float(scores[order[after]]), b, t, after, order))
            else:
                ahead[b] = -np.inf                       # every point of the band is in a leaf of this tree
        return opened

    def met(self, pairs: np.ndarray) -> None:
        """``pairs``: (first tree's leaf, leaf of any tree) that hold a point in common."""
        self.common = np.zeros((self.leaves, self.leaves), bool)
        self.common[pairs[:, 0], pairs[:, 1]] = True
        of = {}
        for b, t, leaf in self.members():
            of.setdefault((b, t), []).append(leaf)
        self.by_tree = [[np.array(of[b, t]) for t in range(int(n))] for b, n in enumerate(self.first)]

    def members(self):
        """(band, tree, leaf) of every leaf."""
        for b, roots in enumerate(self.roots):
            for t, root in enumerate(roots[:int(self.first[b])]):
                todo = [int(root)]
                while todo:
                    node = todo.pop()
                    if node < 0:
                        yield b, t, -1 - node
                    else:
                        todo += self.children[node].tolist()

    def first_leaves(self, scores: np.ndarray, threshold: float) -> np.ndarray:
        """Leaves of the first trees that hold a point of an opened leaf and can hold one at the threshold."""
        threshold -= 1e-5 * self.trees * float(np.abs(scores[~self.whole]).max(initial=0))      # sums of float32 in another order
        opened = np.zeros(self.leaves, bool)
        opened[self.open(scores, threshold)] = True
        out = []
        for trees in self.by_tree:
            most = scores[trees[0]].copy()
            for leaves in trees[1:]:
                most += np.where(self.common[np.ix_(trees[0], leaves)], scores[leaves], -np.inf).max(axis=1)
            seen = (self.common[trees[0]] & opened).any(axis=1)
            out.append(trees[0][seen & (most >= threshold)])
        return np.concatenate(out)


def _vectors(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _pack(batches):
    for b in batches:
        lists = b.column(1)
        n = b.num_rows
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in flat], pa.binary())], names=["node", "asked", "vec"])


def _route(forest):
    """(node, asked, vec, leaf, leaves): the leaf in the first tree of its band and those in all trees."""
    def run(batches):
        f = received(forest)
        for b in batches:
            at = f.route(_vectors(b.column(2))) if b.num_rows else np.zeros((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[:, 0].astype(np.int64)), pa.array([x.tobytes() for x in at], pa.binary())],
                                             names=["node", "asked", "vec", "leaf", "leaves"])
    return run


def _common(batches):
    """Distinct (leaf in the first tree, leaf in any tree) of a task."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        if b.num_rows:
            at = _codes(b.column(1).to_pylist())
            pairs = np.stack([np.repeat(at[:, 0], at.shape[1]), at.ravel()], axis=1)
            seen.update(map(tuple, np.unique(pairs[pairs[:, 1] >= 0], axis=0).tolist()))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.int32()), pa.array([y for _, y in seen], pa.int32())], names=["first", "leaf"])


def _codes(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int32).reshape(len(values), -1)


def _bin(key, table):
    """One row per bin: nodes in order, their leaves and vectors."""
    table = table.sort_by("node")
    return pa.table({"bin": [key[0].as_py()], "nodes": pa.array([np.asarray(table.column("node"), np.int64).tobytes()], pa.binary()),
                     "leaves": pa.array([b"".join(table.column("leaves").to_pylist())], pa.binary()),
                     "vec": pa.array([b"".join(table.column("vec").to_pylist())], pa.binary())})


def _ask(forest, places):
    """(bin, query, vec, threshold): every query at the bins of the first leaves that it has to see."""
    def run(batches):
        f, (first, count) = received(forest), received(places)
        for b in batches:
            bins, rows, bars = [], [], []
            for lo in range(0, b.num_rows, BATCH):
                scores = f.leaf_scores(_vectors(b.column(1).slice(lo, BATCH)))
                for q, (own, bar) in enumerate(zip(scores, f.thresholds(scores).tolist())):
                    at = sorted({k for leaf in f.first_leaves(own, bar) for k in range(first[leaf], first[leaf] + count[leaf])})
                    bins += at
                    rows += [lo + q] * len(at)
                    bars += [bar] * len(at)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(bars, pa.float64())],
                                             names=["bin", "query", "vec", "threshold"])
    return run


def _rank(forest, k: int):
    """(query, node, score): each query's best candidates of a bin. A bin's row comes before its queries."""
    def run(batches):
        f, at, nodes, points = received(forest), None, None, None
        for b in batches:
            bins, kinds = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out: tuple[list, list, list] = ([], [], [])
            lo = 0
            while lo < b.num_rows:
                if kinds[lo] == 0:
                    nodes = np.frombuffer(b.column(4)[lo].as_py(), np.int64)
                    at = np.frombuffer(b.column(5)[lo].as_py(), np.int32).reshape(len(nodes), -1)
                    points = np.frombuffer(b.column(3)[lo].as_py()).reshape(len(nodes), -1)
                    lo += 1
                    continue
                hi = lo + 1
                while hi < min(b.num_rows, lo + BATCH) and kinds[hi] == 1 and bins[hi] == bins[lo]:
                    hi += 1
                part = b.slice(lo, hi - lo)
                queries = _vectors(part.column(3))
                estimates = f.estimates(f.leaf_scores(queries), at)
                for name, x, estimate, bar in zip(part.column(2).to_pylist(), queries, estimates, part.column(6).to_pylist()):
                    fit = np.flatnonzero(estimate >= bar)
                    scores = points[fit] @ x
                    top = best(scores, nodes[fit], k)
                    out[0].extend([name] * len(top))
                    out[1].extend(nodes[fit[top]].tolist())
                    out[2].extend(scores[top].tolist())
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                                             names=["query", "node", "score"])
    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 12,
            leaf: int = 256, recall: float = 0.95, fit_values: int = 1 << 22, bin_rows: int = 16_384) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` largest inner products found for every query.

    ``is_query`` is a condition on the id; a query's candidates are all other rows. The forest is fitted and calibrated on a sample of
    at most ``fit_values`` numbers (distinct vectors with the smallest hashes of their row numbers); every row is indexed.
    ``recall`` is the share of the sample points' nearest that calibration keeps; 1 asks for all of them, not for an exact search.

    Ids are of any ordered type; ties go to the smaller id. Rows without an id, NULL or zero vectors, and vectors with NULL or
    non-finite components take no part; nor do vectors of another dimension than the most frequent one. Rows that repeat an id
    count once, with the first of their vectors. Fewer candidates than ``k``: all of them. Empty in, empty out.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    usable = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
              .where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
                     & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))))
    sizes = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head(1)
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if not sizes:
        return empty
    fit_rows = max(2, fit_values // sizes[0].dim)
    usable = usable.where(F.size("v") == sizes[0].dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = usable.where(is_query(F.col("id")))
    # of equal vectors only the smallest ids can be among the k nearest; the limit acts before the shuffle too
    first = Window.partitionBy("v").orderBy("id")
    few = usable.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # numbers in the order of the smallest ids, given once, in a stored table
    points = stored(grouped.orderBy(F.element_at("ids", 1)).withColumn("node", F.monotonically_increasing_id()), "points")
    queries = stored(asked.join(points.select("v", "node"), "v").select("id", "node"), "queries")
    wanted = queries.groupBy("node").agg(F.lit(True).alias("asked"))
    flagged = points.join(wanted, "node", "left").select("node", F.col("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    packed = stored(flagged.mapInArrow(_pack, "node long, asked boolean, vec binary"), "packed")
    peak = F.array_max(F.transform("v", F.abs))
    norm = F.least(peak * F.sqrt(F.aggregate(F.transform("v", lambda x: x / peak), F.lit(0.0), lambda a, x: a + x * x)), F.lit(sys.float_info.max))
    buckets = (points.select(norm.alias("norm")).groupBy(F.round(F.log("norm") / F.lit(float(np.log(RATIO)))).cast("int").alias("b"))
               .agg(F.min("norm"), F.max("norm"), F.count(F.lit(1))).orderBy(F.desc("b")).collect())      # a few thousand at most
    bands = Bands([tuple(b)[1:] for b in buckets], int(leaf * max(1.0, sum(b[3] for b in buckets) / fit_rows)))
    sample = hashed_sample(packed.select("node", "vec"), fit_rows, "node").collect()           # fit_values numbers
    some = np.frombuffer(b"".join(bytes(r.vec) for r in sample)).reshape(len(sample), -1)
    fitted = Forest(some, bands, trees, leaf)
    fitted.calibrate(some, k, recall)
    bare = shipped(spark, fitted)                                          # at most trees * 2 * fit_rows / leaf nodes, and a leaf a band
    routed = stored(packed.mapInArrow(_route(bare), "node long, asked boolean, vec binary, leaf long, leaves binary"), "routed")
    common = routed.select("leaf", "leaves").mapInArrow(_common, "first int, leaf int").distinct().collect()      # pairs of leaves of a band
    loads = {r.leaf: r["count"] for r in routed.groupBy("leaf").count().collect()}             # as many as the sample made
    fitted.met(np.array([tuple(r) for r in common]))
    forest, places = shipped(spark, fitted), leaf_bins(loads, fitted.leaves, bin_rows)
    place = F.broadcast(spark.createDataFrame([*zip(range(fitted.leaves), *places)], "leaf long, first long, count long"))
    bins = stored(routed.join(place, "leaf").select((F.col("first") + F.pmod(F.xxhash64("node"), "count")).alias("bin"), "node", "leaves", "vec")
                  .groupBy("bin").applyInArrow(_bin, "bin long, nodes binary, leaves binary, vec binary"), "bins")
    sent = (routed.where("asked").select("node", "vec").mapInArrow(_ask(forest, shipped(spark, places)), "bin long, query long, vec binary, threshold double"))
    none = F.lit(None).cast("binary")
    rows = (bins.select("bin", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "vec", "nodes", "leaves", F.lit(None).cast("double").alias("threshold"))
            .unionByName(sent.select("bin", F.lit(1).alias("kind"), "query", "vec", none.alias("nodes"), none.alias("leaves"), "threshold")))
    hits = (rows.repartition(parts, "bin").sortWithinPartitions("bin", "kind", "query")
            .mapInArrow(_rank(forest, k + 1 + SPARE), "query long, node long, score double"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1 + SPARE).select("query", "node")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    asked_points = points.join(wanted, "node").select(F.col("node").alias("query"), F.col("v").alias("q"))
    scored = (found.join(asked_points, "query").join(points, "node")
              .select("query", score.alias("score"), F.explode("ids").alias("vec_id")))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    per_query = queries.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(scored, "query").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (per_query.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
