"""MinHash near-dedup with an LSH forest, exact links and distributed components.

1. A document's set of word shingles gives ``n``, a 128-bit fingerprint and 120 MinHash values (one
   pass over the texts). Documents with equal sets collapse into the one with the smallest id.
2. Forest: 24 sorted signature orders, each a rotation of the signature. In an order, documents that
   share a prefix form a region. Depth adapts to the region: one of more than ``region`` documents
   descends to longer prefixes, so a document's hub is the smallest id it shares the longest needed
   prefix with. A pair of similarity 0.8 misses all 24 orders with a chance of about 7e-5.
3. Links to hubs are confirmed on full sets and joined into components.
4. The rest, exactly: regions whose members are in different components compare those members by
   signature in blocks (several blocks for large regions) and every pair that may be similar enough is
   confirmed on full sets, first the best ones, then all whose components still differ and whose longer
   signatures allow it. A pair of similarity 0.8 fails a signature's test with a chance of about 3e-6.

A region, hub or component is never gathered in one task: counts and minima are combined before the
shuffle, hubs are salted by their number of links, regions split into blocks of ``block`` documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyalscope.llm.common import mix, raw_texts, shuffle_partitions, stored, word_hashes, word_memo
from loyalscope.llm.components import connected_components

#: Orders, prefix lengths by level, and MinHash values of a signature (orders x first prefix).
TREES, DEPTHS = 24, (5, 10, 20)
HASHES = TREES * DEPTHS[0]
#: Values of the longer signature that sorts out the rest before full sets are compared.
LONG = 2048
#: Of m values, two sets of similarity s have at least s * m less this many standard deviations in common.
DEVIATIONS = 4.5


def shingle_set(words: list[bytes], width: int, memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle of its own kind."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, memo)
    take = min(width, len(h))
    n = len(h) - take + 1
    acc = np.full(n, take, np.uint64)
    for j in range(take):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(acc)


def multipliers(count: int = HASHES, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values, cut to 16 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        low = np.minimum(low, np.multiply.outer(factors, values[at:at + 1024]).min(axis=1))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def _signatures(width: int):
    def run(batches):
        memo, factors = word_memo(), multipliers()
        for batch in batches:
            n, prints, sigs = [], [], []
            for raw in raw_texts(batch.column(1)):
                values = shingle_set(raw.lower().split(), width, memo)
                memo.trim()
                n.append(len(values))
                prints.append(xxhash.xxh3_128_digest(values.tobytes()))
                sigs.append(signature(values, factors).tobytes() if len(values) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                                              pa.array(sigs, pa.binary())], names=["id", "n", "print", "sig"])
    return run


def _matrix(column, dtype=np.uint16) -> np.ndarray:
    """Equal-length binary values as rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _forest(batches):
    """(id, order, keys at every depth) for each order."""
    for batch in batches:
        ids, sig = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)).astype(np.uint64)
        if not len(ids):
            continue
        for tree in range(TREES):
            acc, keys = np.full(len(ids), tree, np.uint64), []
            for j in range(DEPTHS[-1]):
                acc = mix(acc + sig[:, (tree * DEPTHS[0] + j) % HASHES] + np.uint64(1))
                if j + 1 in DEPTHS:
                    keys.append(pa.array(acc.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), tree, np.int32)), *keys],
                                             names=["node", "tree", *(f"k{i}" for i in range(len(DEPTHS)))])


def hubs(forest: DataFrame, region: int) -> DataFrame:
    """``node``, ``hub``: per order, the smallest node of the region at the depth that the region needs."""
    rows = forest.withColumn("hub", F.lit(None).cast("long"))
    done = None
    for level in range(len(DEPTHS)):
        key = f"k{level}"
        shared = (rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1"))
        met = (rows.join(shared, key, "left" if level else "inner")
               .withColumn("hub", F.when(F.col("least") < F.col("node"), F.col("least")).otherwise(F.col("hub"))))
        last = level + 1 == len(DEPTHS)
        small = met.where(F.lit(last) | (F.coalesce("size", F.lit(1)) <= region)).select("node", "hub")
        done = small if done is None else done.unionByName(small)
        rows = met.where(F.col("size") > region).drop("size", "least")
    return done.where("hub IS NOT NULL")


def _confirm(share: int):
    """Exact links between a group's first row (the hub's set) and the others."""
    def run(batches):
        hub, own = None, None
        for batch in batches:
            keys, salts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            nodes, sets = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a, b = [], []
            for key, salt, node, raw in zip(keys, salts, nodes, sets):
                values = np.frombuffer(raw, np.uint64)
                if node == key:
                    hub, own = (key, salt), values
                elif hub == (key, salt):
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if 100 * both >= share * (len(own) + len(values) - both):
                        a.append(key)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, share: int, salt: int = 512) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose full sets are similar enough. A hub ``a`` with many partners is dealt over
    tasks of about ``salt`` partners; its set goes to each."""
    parts = shuffle_partitions(sets.sparkSession)
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("s"))
    members = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("salt"), F.col("b").alias("node"))
    owners = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.col("a").alias("node"))
    rows = members.unionByName(owners).join(sets, "node").select("a", "salt", "node", "set")
    return (rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("node") != F.col("a"))
            .mapInArrow(_confirm(share), "a long, b long"))


def _shingle_sets(width: int):
    def run(batches):
        memo = word_memo()
        for batch in batches:
            sets = []
            for raw in raw_texts(batch.column(1)):
                sets.append(shingle_set(raw.lower().split(), width, memo).tobytes())
                memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])
    return run


def _sketches(batches):
    """A longer signature, of one byte per value, from the full set."""
    factors = multipliers(LONG, seed=21)
    for batch in batches:
        raw = (np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(v, factors).astype(np.uint8).tobytes() for v in raw], pa.binary())],
                                         names=["node", "sketch"])


def _whole_blocks(batches, rows: int = 20_000):
    """Columns of about ``rows`` sorted rows that never cut a key: five of numbers, then signatures and sketches."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)), _matrix(batch.column(6)),
                     _matrix(batch.column(7), np.uint8)))
        if sum(len(x[0]) for x in held) >= rows:
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield tuple(c[:cut] for c in columns)
            held = [tuple(c[cut:] for c in columns)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _least_equal(values: int, share: int) -> float:
    wanted = share / 100
    return values * wanted - DEVIATIONS * (values * wanted * (1 - wanted)) ** 0.5


def _compare(share: int, best: bool):
    """Pairs of a block whose labels differ and whose sizes and signatures allow the similarity.

    Rows of side 2 meet all others of their block, else sides meet. A pair counts in the first order that
    brings it together, once. With ``best`` each node gives its most similar partner in the block only.
    """
    least, least_long = _least_equal(HASHES, share), _least_equal(LONG, share)

    def block_pairs(key, node, label, n, side, tree, sig, sketch):
        at = np.arange(len(key))
        for k in range(1, len(key)):
            at = at[at < len(key) - k]
            at = at[key[at] == key[at + k]]
            if not len(at):
                return
            i = at[(label[at] != label[at + k]) & ((side[at] != side[at + k]) | (side[at] == 2))]
            small, large = np.minimum(n[i], n[i + k]), np.maximum(n[i], n[i + k])
            i = i[100 * small >= share * large]
            for lo in range(0, len(i), 5_000):
                part = i[lo:lo + 5_000]
                equal = sig[part] == sig[part + k]
                same = equal.sum(axis=1)
                good = (same >= least) & (equal.reshape(-1, TREES, DEPTHS[0]).all(axis=2).argmax(axis=1) == tree[part])
                part, same = part[good], same[good]
                if not best:
                    good = (sketch[part] == sketch[part + k]).sum(axis=1) >= least_long
                    part, same = part[good], same[good]
                yield part, part + k, same

    def run(batches):
        for columns in _whole_blocks(batches):
            found = list(block_pairs(*columns))
            if found:
                yield pairs_of(columns[1], *map(np.concatenate, zip(*found)))

    def pairs_of(node, i, j, same):
        if best:                                   # each node's most similar partner here
            both, other, score = np.append(i, j), np.append(j, i), np.append(same, same)
            order = np.lexsort((node[other], -score, both))
            first = np.append(True, both[order][1:] != both[order][:-1])[:len(order)]
            i, j = both[order][first], other[order][first]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def rest_pairs(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, share: int, best: bool, block: int) -> DataFrame:
    """Pairs of one region that may be similar and are in different components.

    Regions of up to ``block`` nodes are one block. In larger ones the nodes of the largest component and
    the others are cut into blocks; others meet all blocks, the largest component only the others.
    """
    parts = shuffle_partitions(members.sparkSession)
    labelled = members.join(labels, "node", "left").select("k0", "tree", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("k0", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = (sizes.groupBy("k0").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("top"))
             .where("labels > 1").select("k0", "size", F.col("top.c").alias("most"), F.col("top.label").alias("top")))
    rows = labelled.join(mixed, "k0")
    own, others = F.ceil(F.col("most") / block).cast("int"), F.ceil((F.col("size") - F.col("most")) / block).cast("int")
    rows = rows.withColumns({"own": own, "others": others, "major": F.col("label") == F.col("top")})
    rows = rows.withColumn("mine", F.expr("CAST(pmod(xxhash64(node), CASE WHEN major THEN own ELSE others END) AS INT)"))
    spread = F.expr(f"""CASE WHEN size <= {block} THEN array(named_struct('key', xxhash64(k0), 'side', 2))
        WHEN major THEN transform(sequence(0, others - 1), o -> named_struct('key', xxhash64(k0, 'm', mine, o), 'side', 0))
        ELSE concat(transform(sequence(0, own - 1), m -> named_struct('key', xxhash64(k0, 'm', m, mine), 'side', 1)),
                    transform(sequence(0, others - 1), o -> named_struct('key', xxhash64(k0, 'o', least(o, mine), greatest(o, mine)),
                        'side', CASE WHEN o = mine THEN 2 WHEN mine < o THEN 0 ELSE 1 END))) END""")
    dealt = rows.select("node", "label", "tree", F.explode(spread).alias("at")).join(reps.select("node", "n", "sig"), "node")
    if best:
        dealt = dealt.withColumn("sketch", F.lit(b""))
    else:
        near = rows.select("node").distinct()
        sketches = stored(sets.join(near, "node").select("node", "set").mapInArrow(_sketches, "node long, sketch binary"), "sketches")
        dealt = dealt.join(sketches, "node")
    return (dealt.select("at.key", "node", "label", "n", "at.side", "tree", "sig", "sketch").repartition(parts, "key")
            .sortWithinPartitions("key", "node").mapInArrow(_compare(share, best), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: int = 80,
                    region: int = 64, block: int = 256) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable over links, itself included), ``kept``.

    Two documents are linked if 100 * |intersection| >= ``share`` * |union| of their sets of ``width``-word
    shingles (ASCII lower case; words are runs of anything but ASCII white space; a text with fewer
    words is one shingle). One row per input row.

    NULL, empty or blank text: an empty set, linked with nothing, kept. A NULL id takes no part: its
    component is NULL and it is kept. Rows that repeat an id are one document if their texts agree; if
    not, each text has its own component, unless the id is the smallest of both texts. An empty table
    gives an empty result. Ids may be of any type with an order: rows whose ids are no integers are
    numbered first, one document a row, and the numbers are replaced by the ids at the end.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return _numbered(docs, id_col, text_col, width, share, region, block)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(own.mapInArrow(_signatures(width), f"id {kind}, n long, print binary, sig binary"), "signatures")
    filled = signed.where("n > 0 AND id IS NOT NULL")
    reps = stored(filled.groupBy("print").agg(F.min("id").cast("long").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
    keys = ", ".join(f"k{i} long" for i in range(len(DEPTHS)))
    forest = reps.select("node", "sig").mapInArrow(_forest, f"node long, tree int, {keys}")
    shared = forest.groupBy("k0").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("k0")
    forest = stored(forest.join(shared, "k0"), "forest")
    votes = hubs(forest, region).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("votes"))
    picked = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("hub")).alias("hub"))).alias("top"), F.min("hub").alias("least"))
    pairs = stored(picked.select(F.explode(F.array_distinct(F.array(-F.col("top.hub"), F.col("least")))).alias("a"), F.col("node").alias("b")), "hubs")
    near = forest.select("node").distinct()
    texts = own.join(near, F.col("id") == F.col("node")).select("node", "text")
    sets = stored(texts.mapInArrow(_shingle_sets(width), "node long, set binary").dropDuplicates(["node"]), "sets")
    labels = connected_components(stored(confirmed(pairs, sets, share), "links"))
    members = forest.select("k0", "tree", "node")
    for best in (True, False):
        rest = stored(rest_pairs(members, labels, reps, sets, share, best, block), "rest")
        labels = connected_components(stored(confirmed(rest, sets, share), "links"), labels)
    classes = reps.select("print", "node").join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("component"))
    out = signed.join(classes, "print", "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("id")).cast(kind)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, width: int, share: int, region: int, block: int) -> DataFrame:
    """``near_duplicates`` over stored row numbers; the smallest id of a component names it."""
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                  .withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    found = stored(near_duplicates(rows, "row", "text", width, share, region, block), "classes")
    named = found.join(rows.select("row", "id").where("row IS NOT NULL"), "row", "left")
    least = named.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("id").alias("least"))
    return named.join(least, "component_id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"),
        F.coalesce(F.col("id") == F.col("least"), F.lit(True)).alias("kept"))
