"""Hard-negative mining: a GNAT-style multiway hyperplane tree searched exactly.

1. Vectors become integers, so scores (inner products) are exact. Equal vectors of a label become one node that
   keeps as many of its smallest ids as a result can hold.
2. An extra component makes all nodes equally long (R); a score s then is a distance, d**2 = |q|**2 + R**2 - 2 s, and the
   scores from low to high are an annulus around the query.
3. The tree: every split point takes the rows that are nearest to it. The split points come from a bounded sample; every
   row is routed, and for each split point i and sibling j the range of distances from i to *all* rows under j is
   measured in Spark. A query whose annulus meets no distance that the range of some i allows passes j by.
4. Leaves are exact: they are dealt into bins of about ``bin_rows`` rows (a large leaf over several), a query travels once to each
   bin with a leaf that it could not eliminate.
5. Four searches: positives in the query's own leaf, then in all leaves within the distance of what was found; negatives of every
   window in the own leaf, then in all leaves that the windows' annuli, narrowed by what was found, still meet.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyalscope.llm.common import received, shipped, shuffle_partitions, stored
from loyalscope.llm.samples import hashed_sample

#: Integer components of this size and more take no part: their products do not fit into 64 bits.
TOO_LARGE = 1 << 24
#: Rounding of a distance, as a share of R.
SLACK = 1e-6
#: Queries that a worker compares at once.
BATCH = 64


class Lift:
    """Rows with the extra component that brings all to length ``radius``; queries have 0 there."""

    def __init__(self, radius2: int):
        self.radius2, self.slack = float(radius2), SLACK * float(radius2) ** 0.5

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.radius2 - (x * x).sum(axis=1), 0))[:, None]])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x.astype(np.float64), np.zeros((len(x), 1))])

    def distance(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of a row with this score from queries with these squared lengths."""
        return np.sqrt(np.maximum(norm2 + self.radius2 - 2 * score, 0))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T), 0))


class Tree:
    """Inner node i has split points ``points[i]``, ``children[i]`` (leaf c is -1 - c) and, once measured, ``low[i]`` and ``high[i]``.

    ``paths[leaf]`` lists (inner node, child number) from the root down.
    """

    def __init__(self, sample: np.ndarray, fan: int, leaf: int, seed: int = 0):
        self.points, self.children, self.paths = [], [], []
        self._grow(sample, fan, leaf, np.random.default_rng(seed), [])
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def _grow(self, sample, fan, leaf, rng, path) -> int:
        if len(sample) > leaf:
            points = self._split_points(sample, fan, rng)
            nearest = distances(sample, points).argmin(axis=1)
            if len(np.unique(nearest)) > 1:
                i = len(self.points)
                self.points.append(points)
                self.children.append(np.zeros(len(points), np.int64))
                for j in range(len(points)):
                    self.children[i][j] = self._grow(sample[nearest == j], fan, leaf, rng, [*path, (i, j)])
                return i
        self.paths.append(path)
        return -len(self.paths)

    @staticmethod
    def _split_points(sample, fan, rng) -> np.ndarray:
        """``fan`` of three times as many random rows, each the farthest from those before."""
        some = sample[rng.choice(len(sample), min(3 * fan, len(sample)), replace=False)]
        chosen, far = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < min(fan, len(some)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every lifted row."""
        at = np.zeros(len(x), np.int64) if self.points else np.full(len(x), -1)
        while (inner := at >= 0).any():
            for i in np.unique(at[inner]):
                rows = np.flatnonzero(at == i)
                at[rows] = self.children[i][distances(x[rows], self.points[i]).argmin(axis=1)]
        return -1 - at

    def measure(self, x: np.ndarray, leaves: np.ndarray) -> None:
        """Widen the ranges by lifted rows that lie in ``leaves``."""
        for leaf in np.unique(leaves):
            rows = x[leaves == leaf]
            for i, j in self.paths[leaf]:
                d = distances(rows, self.points[i])
                self.low[i][:, j] = np.minimum(self.low[i][:, j], d.min(axis=0))
                self.high[i][:, j] = np.maximum(self.high[i][:, j], d.max(axis=0))

    def meet(self, x: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """By query and leaf: whether a row of the leaf can be at a distance in one of the query's annuli (``near`` to ``far`` by window)."""
        out = np.zeros((len(x), len(self.paths)), bool)
        todo = [(0 if self.points else -1, near <= far)]
        while todo:
            node, live = todo.pop()
            if node < 0:
                out[:, -1 - node] = live.any(axis=1)
                continue
            d = distances(x, self.points[node])
            stay = np.zeros((*live.shape, len(self.points[node])), bool)                   # query, window, child
            for w in range(live.shape[1]):
                least, most = np.maximum(d - far[:, w, None], near[:, w, None] - d), d + far[:, w, None]
                gone = (self.high[node] < least[:, :, None]) | (self.low[node] > most[:, :, None])
                stay[:, w] = live[:, w, None] & ~gone.any(axis=1)
            todo += [(int(c), stay[:, :, j]) for j, c in enumerate(self.children[node]) if stay[:, :, j].any()]
        return out


def _rows(column, dtype=np.int32) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _pack(scale: float):
    """(id, label, print, vec): integers of the usable vectors, 32 bits each."""
    def run(batches):
        for b in batches:
            prints, vecs = [], []
            for i, label, x in zip(b.column(0), b.column(1), b.column(2)):
                raw = None
                if i.is_valid and label.is_valid and x.is_valid and len(x) and not x.values.null_count:
                    v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if (np.abs(v) < TOO_LARGE).all():                # false for NaN and infinity too
                        raw = v.astype(np.int32).tobytes()
                vecs.append(raw)
                prints.append(raw and xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary()), pa.array(vecs, pa.binary())],
                                             names=["id", "label", "print", "vec"])
    return run


def _route(tree, lift):
    def run(batches):
        own_tree, own_lift = received(tree), received(lift)
        for b in batches:
            leaves = own_tree.route(own_lift.points(_rows(b.column(2)))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.int64())], names=[*b.schema.names, "leaf"])
    return run


def _measure(tree, lift):
    """A task's ranges, one row per inner node."""
    def run(batches):
        own_tree, own_lift = received(tree), received(lift)
        for b in batches:
            if b.num_rows:
                own_tree.measure(own_lift.points(_rows(b.column(0))), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(own_tree.low)), pa.int64()), pa.array([x.tobytes() for x in own_tree.low], pa.binary()),
                                          pa.array([x.tobytes() for x in own_tree.high], pa.binary())], names=["inner", "low", "high"])
    return run


def _widest(key, table):
    low, high = _rows(table.column("low"), float).min(axis=0), _rows(table.column("high"), float).max(axis=0)
    return pa.table({"inner": [key[0].as_py()], "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary())})


def _bin(key, table):
    """One row per bin: nodes, labels and vectors by leaf, then node."""
    table = table.sort_by([("leaf", "ascending"), ("node", "ascending")])
    own = [np.asarray(table.column(c), np.int64).tobytes() for c in ("leaf", "node", "label")]
    return pa.table({"bin": [key[0].as_py()], "leaves": pa.array([own[0]], pa.binary()), "nodes": pa.array([own[1]], pa.binary()),
                     "labels": pa.array([own[2]], pa.binary()), "vecs": pa.array([b"".join(table.column("vec").to_pylist())], pa.binary())})


def _ask(tree, lift, bins, own_leaf: bool):
    """(bin, node, label, vec, windows, leaves): every query at the bins that hold leaves it has to see. Windows are (low, high) scores."""
    def run(batches):
        own_tree, own_lift, (first, count) = received(tree), received(lift), received(bins)
        for b in batches:
            out: list[list] = [[], [], []]
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                vec = _rows(part.column(2))
                x = own_lift.queries(vec)
                if own_leaf:
                    meets = np.zeros((len(x), len(own_tree.paths)), bool)
                    meets[np.arange(len(x)), own_tree.route(own_lift.points(vec))] = True
                else:
                    windows = [np.frombuffer(w).reshape(-1, 2) for w in part.column(3).to_pylist()]
                    wide = np.full((len(x), max(map(len, windows), default=0), 2), np.nan)      # comparisons with nan are false
                    for row, w in zip(wide, windows):
                        row[:len(w)] = w
                    norm2 = (x * x).sum(axis=1)[:, None]
                    near, far = own_lift.distance(norm2, wide[:, :, 1]) - own_lift.slack, own_lift.distance(norm2, wide[:, :, 0]) + own_lift.slack
                    meets = own_tree.meet(x, near, far)
                for q, row in enumerate(meets):
                    by_bin: dict[int, list[int]] = {}
                    for leaf in np.flatnonzero(row):
                        for k in range(first[leaf], first[leaf] + count[leaf]):
                            by_bin.setdefault(k, []).append(leaf)
                    out[0].extend(by_bin)
                    out[1].extend([lo + q] * len(by_bin))
                    out[2].extend(np.array(x, np.int64).tobytes() for x in by_bin.values())
            at = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(c.take(at) for c in b.columns), pa.array(out[2], pa.binary())],
                                             names=["bin", "node", "label", "vec", "windows", "leaves"])
    return run


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; in double precision where it is exact."""
    if queries.size and points.size and float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1] < 2.0 ** 53:
        return queries.astype(np.float64) @ points.astype(np.float64).T
    return queries.astype(np.int64) @ points.astype(np.int64).T


def best(scores: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` largest scores, ties to the smaller node."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((nodes[at], -scores[at]))][:k]


def _look(same: bool, k: int):
    """(query, window, node, score): each query's ``k`` best nodes in a bin by window, of its own label (``same``) or of others.

    A bin's row comes before its queries.
    """
    def run(batches):
        bin_at = leaves = nodes = labels = points = starts = ends = None
        for b in batches:
            bins, kinds = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out: list[list] = [[], [], [], []]
            lo = 0
            while lo < b.num_rows:
                if kinds[lo] == 0:
                    leaves, nodes, labels = (np.frombuffer(b.column(i)[lo].as_py(), np.int64) for i in (3, 6, 7))
                    points = np.frombuffer(b.column(4)[lo].as_py(), np.int32).reshape(len(nodes), -1)
                    bin_at, starts, ends = bins[lo], *(np.searchsorted(leaves, np.unique(leaves), side) for side in ("left", "right"))
                    lo += 1
                    continue
                hi = lo + 1
                while hi < min(b.num_rows, lo + BATCH) and kinds[hi] == 1 and bins[hi] == bins[lo]:
                    hi += 1
                assert bins[lo] == bin_at
                part = b.slice(lo, hi - lo)
                asked = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
                vecs = _rows(part.column(4))
                live, score = np.zeros((len(asked), len(nodes)), bool), np.zeros((len(asked), len(nodes)))
                for s, e in zip(starts, ends):
                    q = np.flatnonzero([leaves[s] in a for a in asked])
                    if len(q):
                        found = exact_scores(vecs[q], points[s:e])
                        score = score if score.dtype == found.dtype else score.astype(np.int64)
                        score[q, s:e], live[q, s:e] = found, True
                for q, (node, label, windows) in enumerate(zip(*(part.column(i).to_pylist() for i in (2, 8, 5)))):
                    fit = np.flatnonzero(live[q] & ((labels == label) == same))
                    s = score[q, fit]
                    for w, (low, high) in enumerate(np.frombuffer(windows).reshape(-1, 2)):
                        inside = np.flatnonzero((s >= low) & (s <= high))
                        top = inside[best(s[inside], nodes[fit[inside]], k)]
                        out[0].extend([node] * len(top))
                        out[1].extend([w] * len(top))
                        out[2].extend(nodes[fit[top]].tolist())
                        out[3].extend(s[top].astype(np.int64).tolist())
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.int64())], names=["query", "window", "node", "score"])
    return run


def leaf_bins(loads: dict[int, int], leaves: int, rows: int) -> tuple[list[int], list[int]]:
    """First bin and number of bins of every leaf: neighbours share a bin up to ``rows``, larger leaves are dealt over several."""
    first, count, at, filled = [], [], -1, rows
    for i in range(leaves):
        own = loads.get(i, 0)
        if filled + own > rows:
            at, filled = at + 1, 0
        first.append(at)
        count.append(max(1, -(-own // rows)))
        at, filled = at + count[-1] - 1, filled + own if count[-1] == 1 else rows
    return first, count


class Index:
    """The tree over stored nodes (``node``, ``label`` as a number, ``vec``), dealt into bins."""

    def __init__(self, nodes: DataFrame, radius2: int, fan: int, leaf: int, fit_rows: int, bin_rows: int):
        self.spark = spark = nodes.sparkSession
        self.parts = shuffle_partitions(spark)
        lift = Lift(radius2)
        sample = hashed_sample(nodes.select("node", "vec"), fit_rows, "node").collect()        # fit_rows vectors
        tree = Tree(lift.points(np.frombuffer(b"".join(bytes(r.vec) for r in sample), np.int32).reshape(len(sample), -1)), fan, leaf)
        self.lift, bare = shipped(spark, lift), shipped(spark, tree)
        routed = stored(nodes.select("node", "label", "vec").mapInArrow(_route(bare, self.lift), "node long, label long, vec binary, leaf long"), "routed")
        ranges = (routed.select("vec", "leaf").mapInArrow(_measure(bare, self.lift), "inner long, low binary, high binary")
                  .groupBy("inner").applyInArrow(_widest, "inner long, low binary, high binary"))
        for r in ranges.collect():                                                             # as many as the sample made
            shape = tree.low[r.inner].shape
            tree.low[r.inner], tree.high[r.inner] = (np.frombuffer(bytes(x)).reshape(shape) for x in (r.low, r.high))
        self.tree = shipped(spark, tree)
        loads = {r.leaf: r["count"] for r in routed.groupBy("leaf").count().collect()}         # as many as the sample made
        first, count = leaf_bins(loads, len(tree.paths), bin_rows)
        self.leaf_bins = shipped(spark, (first, count))
        place = F.broadcast(spark.createDataFrame([*zip(range(len(first)), first, count)], "leaf long, first long, count long"))
        dealt = routed.join(place, "leaf").select((F.col("first") + F.pmod(F.xxhash64("node"), "count")).alias("bin"), "leaf", "node", "label", "vec")
        self.bins = stored(dealt.groupBy("bin").applyInArrow(_bin, "bin long, leaves binary, nodes binary, labels binary, vecs binary"), "bins")

    def search(self, queries: DataFrame, same: bool, k: int, own_leaf: bool) -> DataFrame:
        """(query, window, node, score) of ``queries`` (node, label, vec, windows): candidates that hold the ``k`` best of every window."""
        asked = queries.select("node", "label", "vec", "windows").mapInArrow(
            _ask(self.tree, self.lift, self.leaf_bins, own_leaf), "bin long, node long, label long, vec binary, windows binary, leaves binary")
        none, kind = F.lit(None).cast("binary"), F.lit(0).alias("kind")
        rows = self.bins.select("bin", kind, F.lit(None).cast("long").alias("query"), "leaves", F.col("vecs").alias("vec"), none.alias("windows"),
                                "nodes", "labels", F.lit(None).cast("long").alias("label"))
        rows = rows.unionByName(asked.select("bin", F.lit(1).alias("kind"), F.col("node").alias("query"), "leaves", "vec", "windows",
                                             none.alias("nodes"), none.alias("labels"), "label"))
        return (rows.repartition(self.parts, "bin").sortWithinPartitions("bin", "kind", "query")
                .mapInArrow(_look(same, k), "query long, window int, node long, score long"))


def _windows(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))


def _flat(batches):
    """Windows as pairs of doubles."""
    for b in batches:
        flat = [np.array([[w["low"], w["high"]] for w in ws], float).tobytes() for ws in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(flat, pa.binary())], names=["node", "label", "vec", "windows"])


def _with_windows(queries: DataFrame) -> DataFrame:
    return queries.select("node", "label", "vec", "windows").mapInArrow(_flat, "node long, label long, vec binary, windows binary")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, share: int = 80, scale: float = 256,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", fan: int = 16, leaf: int = 64,
                   fit_rows: int = 16_384, bin_rows: int = 16_384) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Vectors become integers, floor(scale * x); a score is the integer inner product with the anchor. ``is_anchor`` is a
    condition on the id. An anchor's positives are the first ``positives`` other rows of its label by score, its negatives for each
    positive the first ``negatives`` rows of other labels with ``share`` * positive <= 100 * negative <= 100 * positive;
    ties go to the smaller id, fewer rows are all. Exact: the tree only leaves out what its ranges rule out.

    Rows without an id or a label, vectors that are NULL, empty or hold NULL or non-finite components, and integers of 2**24 and more
    take no part, nor do vectors of another dimension than the most frequent one. Rows that repeat an id count once, with
    the smallest label and vector. Labels that are no numbers are compared by 64-bit hash. Nothing to mine: an empty result.
    """
    spark = vectors.sparkSession
    label = F.col(label_col)
    code = label.cast("long") if isinstance(vectors.schema[label_col].dataType, T.IntegralType) else F.when(label.isNotNull(), F.xxhash64(label))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), code.alias("label"), F.col(vector_col).alias("v"))
    packed = rows.mapInArrow(_pack(scale), "id long, label long, print binary, vec binary").where("vec IS NOT NULL")
    once = stored(packed.groupBy("id").agg(F.min(F.struct("label", "vec", "print")).alias("r")).select("id", "r.*"), "once")
    sizes = once.groupBy(F.octet_length("vec").alias("bytes")).count().orderBy(F.desc("count"), "bytes").head(1)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    once = once.where(F.octet_length("vec") == sizes[0].bytes)
    # of equal vectors only the smallest ids can be in a result; the limit acts before the shuffle too
    keep = max(positives + 1, negatives)
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("label", "print").orderBy("id"))).where(F.col("r") <= keep)
    nodes = stored(few.groupBy("label", "print").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")), "nodes")
    anchors = stored(once.where(is_anchor(F.col("id"))).select("id", "label", "print").join(nodes.select("label", "print", "node"), ["label", "print"])
                     .select(F.col("id").alias("anchor"), "node"), "anchors")
    asked = stored(nodes.select("node", "label", "vec").join(anchors.select("node").distinct(), "node", "left_semi"), "asked")
    norms = nodes.select("vec").mapInArrow(_norms, "norm2 long").agg(F.max("norm2")).head()[0]
    index = Index(nodes, norms, fan, leaf, fit_rows, bin_rows)

    def found(queries: DataFrame, same: bool, k: int, own_leaf: bool, name: str) -> DataFrame:
        """(query, window, id, score, r): the k best rows of every window."""
        hits = index.search(queries, same, k, own_leaf).join(nodes.select("node", "ids"), "node").select("query", "window", "score", F.explode("ids").alias("id"))
        order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
        return stored(hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k), name)

    far, nearest = F.lit(-float(sys.maxsize)), F.lit(float(sys.maxsize))
    wide = asked.withColumn("windows", F.array(_windows(far, nearest)))
    top = positives + 1                                                     # the anchor itself is among the rows
    first = found(_with_windows(wide), True, top, True, "near")
    bound = first.where(F.col("r") == top).select(F.col("query").alias("node"), "score")
    narrow = asked.join(bound, "node", "left").withColumn("windows", F.array(_windows(F.coalesce("score", far), nearest)))
    close = found(_with_windows(narrow), True, top, False, "positives")
    per_anchor = (anchors.join(close.withColumnRenamed("query", "node"), "node").where("id <> anchor")
                  .withColumn("p", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))).where(F.col("p") <= positives)
                  .select("anchor", "node", F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    per_anchor = stored(per_anchor, "per_anchor")
    low = F.ceil(F.col("positive_score") * share / F.lit(100).cast("decimal(20,0)")).cast("long")
    scores = per_anchor.where("positive_score >= 0").select("node", "positive_score").distinct().withColumn("low", low)
    ranked = stored(scores.withColumn("window", F.row_number().over(Window.partitionBy("node").orderBy("positive_score")) - 1), "windows")

    def asking(lows: DataFrame) -> DataFrame:
        own = lows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("window", _windows(F.col("low"), F.col("positive_score")).alias("w")))).alias("ws"))
        return _with_windows(asked.join(own.select("node", F.col("ws.w").alias("windows")), "node"))

    start = found(asking(ranked), False, negatives, True, "start")
    better = start.where(F.col("r") == negatives).select(F.col("query").alias("node"), "window", "score")
    narrowed = ranked.join(better, ["node", "window"], "left").withColumn("low", F.greatest("low", "score"))
    hard = found(asking(narrowed), False, negatives, False, "negatives").withColumnRenamed("query", "node").join(ranked, ["node", "window"])
    hard = hard.select("node", "positive_score", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("r").alias("rank"))
    return (per_anchor.join(hard, ["node", "positive_score"])
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"))


def _norms(batches):
    for b in batches:
        if b.num_rows:
            x = _rows(b.column(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((x * x).sum(axis=1).max())])], names=["norm2"])
