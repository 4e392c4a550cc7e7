"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Documents are dealt into blocks by a hash of id and text (one shuffle of the texts). Rows that agree
   in both and together would fill a block stay where they are: all their windows repeat, so they
   are answered in place, and one stand-in with their words takes part in the blocks.
2. Each block hashes all its windows: prefix sums of the words' hashes times powers of an odd base
   give every window's polynomial hash modulo 2**64, for two bases. The first hash and half of the
   second are a window's fingerprint of 96 bits. Equal fingerprints inside the block are combined before
   anything is shuffled, so a passage that a third of all documents share leaves each block
   once; the sorted distinct ones go out as one packed row per range of fingerprints ("bucket").
3. A bucket finds the fingerprints that more than one block holds and answers each block with one bit per
   fingerprint, in the order they came.
4. Each block recomputes its windows (the shuffled texts are reused), marks those that start twice
   or more anywhere, merges them into maximal removal intervals and cuts these out.

Blocks hold about ``block_bytes`` of text and buckets about ``bucket_bytes`` of fingerprints whatever the
size of the input; blocks times buckets rows travel, so both sizes should grow together with inputs of
many TB. With w distinct windows, w*w/2**97 false matches are expected: about 2e-3 for the 1.6e13 windows
of 100 TB. Words enter by 64-bit hashes; two words that share one can only be mistaken for each other
between windows that agree in all other words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loyalscope.llm.common import mix, raw_texts, shuffle_partitions, stored, text_bytes, word_hashes, word_memo

# The odd bases of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bits of a fingerprint that its place in the sorted order gives, and the bits of its first hash that travel as they are.
PLACE_BITS = 20
REST_BITS = 64 - PLACE_BITS


def window_hashes(h: np.ndarray, width: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Polynomial hash of every run of ``width`` word hashes (wrapping 64-bit arithmetic)."""
    up, down = powers
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down[: len(h)], out=prefix[1:])
    n = len(h) - width + 1
    return mix((prefix[width:] - prefix[:n]) * up[:n])


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1), b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def fingerprints(hashes: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of all documents, given their words' hashes: the first hash, and 32 bits of the second."""
    longest, both = max(map(len, hashes), default=0), []
    for base, kind in zip(BASES, (np.uint64, np.uint32)):
        powers = power_tables(base, longest)
        seeded = hashes if kind is np.uint64 else [mix(h + np.uint64(base)) for h in hashes]
        windows = [window_hashes(h, width, powers) for h in seeded if len(h) >= width]
        both.append(np.concatenate([w if kind is np.uint64 else (w >> np.uint64(32)).astype(kind) for w in windows] or [np.zeros(0, kind)]))
    return both[0], both[1]


def sorted_order(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending order of (first, second), and where a new value begins in that order."""
    order = np.argsort(first)

    def steps(x):
        x = x[order]
        return x[1:] != x[:-1]

    if (~steps(first) & steps(second)).any():          # one first hash, two windows: rare, but told apart
        order = np.lexsort((second, first))
    return order, np.append(np.ones(min(len(order), 1), bool), steps(first) | steps(second))


def bucket_edges(buckets: int) -> list[int]:
    return [(i << 64) // buckets for i in range(buckets + 1)]


def _places(low: int, high: int) -> tuple[int, int]:
    """The first and the number of the leading ``PLACE_BITS`` that values from ``low`` to below ``high`` have."""
    return low >> REST_BITS, ((high - 1) >> REST_BITS) - (low >> REST_BITS) + 1


def packed(first: np.ndarray, second: np.ndarray, low: int, high: int) -> bytes:
    """Sorted fingerprints of one bucket in nine and a half bytes each, and their leading bits: a set bit per fingerprint, a clear one per place."""
    least, places = _places(low, high)
    n = len(first)
    marks = np.zeros(n + places, bool)
    marks[(first >> np.uint64(REST_BITS)).astype(np.int64) - least + np.arange(n)] = True
    nibble = np.append((first >> np.uint64(40)).astype(np.uint8) & 15, np.zeros(n % 2, np.uint8))
    return b"".join(x.tobytes() for x in (np.array([n], np.uint64), first.astype(np.uint32), second, (first >> np.uint64(32)).astype(np.uint8),
                                          nibble[::2] << 4 | nibble[1::2], np.packbits(marks)))


def unpacked(raw: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    least, places = _places(low, high)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    half = (n + 1) // 2
    end, second = np.frombuffer(raw, np.uint32, 2 * n, 8).reshape(2, n)
    middle = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.uint64)
    pairs = np.frombuffer(raw, np.uint8, half, 8 + 9 * n)
    nibble = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n].astype(np.uint64)
    marks = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 9 * n + half), count=n + places)
    top = (np.flatnonzero(marks) - np.arange(n) + least).astype(np.uint64)
    return top << np.uint64(REST_BITS) | nibble << np.uint64(40) | middle << np.uint64(32) | end, second


class Block:
    """The windows of one block's documents, in the documents' order, and their distinct fingerprints."""

    def __init__(self, texts, width: int, keep_words: bool = True):
        memo, self.words, hashes = word_memo(), [], []
        for raw in texts:
            words = raw.split()
            hashes.append(word_hashes(words, memo))
            memo.trim()
            if keep_words:
                self.words.append(words)
        self.starts = np.cumsum([0, *(max(len(h) - width + 1, 0) for h in hashes)])
        first, second = fingerprints(hashes, width)
        order, new = sorted_order(first, second)
        rank = np.cumsum(new) - 1
        self.group = np.empty(len(order), np.int64)    # which distinct fingerprint each window has
        self.group[order] = rank
        self.first, self.second, self.counts = first[order[new]], second[order[new]], np.bincount(rank)

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket's range begins and ends among the distinct fingerprints."""
        return np.append(np.searchsorted(self.first, np.array(bucket_edges(buckets)[:-1], np.uint64)), len(self.first))


def removed_intervals(repeated: np.ndarray, width: int) -> np.ndarray:
    """Maximal [start, end) word ranges covered by the windows that start where ``repeated``."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    first = np.append(True, at[1:] > at[:-1] + width)
    last = np.append(first[1:], True)
    return np.stack([at[first], at[last] + width], axis=1)


def _send(width: int, buckets: int):
    def send(key, table):
        block = Block(raw_texts(table.column(1)), width, keep_words=False)
        cuts, edges = block.cuts(buckets), bucket_edges(buckets)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        parts = [packed(block.first[cuts[b]:cuts[b + 1]], block.second[cuts[b]:cuts[b + 1]], edges[b], edges[b + 1]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int32()),
                         "prints": pa.array(parts, pa.binary())})
    return send


def _count(buckets: int):
    """Which fingerprints of a bucket come from two or more blocks: one bit per fingerprint and block."""
    def count(key, table):
        low, high = bucket_edges(buckets)[key[0].as_py():][:2]
        parts = [unpacked(x, low, high) for x in table.column("prints").to_pylist()]
        ends = np.cumsum([len(first) for first, _ in parts])
        first, second = map(np.concatenate, zip(*parts))
        del parts
        order, new = sorted_order(first, second)
        shared = np.empty(len(order), bool)
        shared[order] = ~(new & np.append(new[1:], True))
        bits = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
    return count


def _cut(own: list, texts: list[list[bytes]], intervals: list[np.ndarray], schema: pa.Schema) -> pa.Table:
    """The input's own columns and, for each text's words, what its intervals remove and leave."""
    n_words, n_removed, kept, spans = [], [], [], []
    for words, cut in zip(texts, intervals):
        n_words.append(len(words))
        n_removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
        spans.append([{"start": int(a), "end": int(b)} for a, b in cut])
        at, rest = 0, []
        for a, b in cut:
            rest += words[at:a]
            at = b
        kept.append(b" ".join(rest + words[at:]).decode())
    new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
           pa.array(spans, schema.field("removed").type)]
    return pa.Table.from_arrays(own + new, schema=pa.schema(
        [pa.field(schema.field(i).name, a.type) for i, a in enumerate(own)] + list(schema)[len(own):]))


def _remove(width: int, buckets: int, columns: int, schema: pa.Schema):
    def remove(key, docs, answers):
        block = Block(raw_texts(docs.column(1)), width)
        cuts = block.cuts(buckets)
        repeated = block.counts > 1
        for b, raw in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            n = int(cuts[b + 1] - cuts[b])
            repeated[cuts[b]:cuts[b + 1]] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        stand_in = docs.column(columns).to_numpy()
        for i in np.flatnonzero(stand_in):
            repeated[block.group[block.starts[i]:block.starts[i + 1]]] = True
        hit, rows = repeated[block.group], np.flatnonzero(~stand_in)
        own = [docs.column(i).combine_chunks().take(pa.array(rows)) for i in range(columns)]
        return _cut(own, [block.words[i] for i in rows],
                    [removed_intervals(hit[block.starts[i]:block.starts[i + 1]], width) for i in rows], schema)
    return remove


def _remove_whole(width: int, schema: pa.Schema):
    """Rows whose windows all repeat."""
    def remove(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [raw.split() for raw in raw_texts(rows.column(1))]
                cut = [removed_intervals(np.ones(max(len(words) - width + 1, 0), bool), width) for words in texts]
                yield from _cut(list(rows.columns), texts, cut, schema).to_batches()
    return remove


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35,
                    keep: tuple[str, ...] = (), block_bytes: int = 4 << 20,
                    bucket_bytes: int = 16 << 20) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts anywhere else.

    One row per input row: ``id_col``, ``text_col`` (unchanged), the ``keep`` columns, ``n_words``,
    ``n_removed``, ``kept_text`` (kept words joined by one space) and ``removed`` (maximal
    ``[start, end)`` word ranges). Words are runs of anything but ASCII white space.

    NULL or empty text: no words, ``kept_text`` is empty. Texts shorter than a window stay whole.
    Repeated rows are documents of their own, so their windows repeat, however many there are. NULL ids
    are kept as they are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts, total = shuffle_partitions(spark), text_bytes(docs, text_col)
    blocks = max(parts, -(-total // block_bytes))
    buckets = max(parts, -(-total * 5 // (2 * bucket_bytes)))     # about 9.7 bytes per 4 to 6 of text
    own, same = [id_col, text_col, *keep], ["_same", "_same_too"]
    rows = docs.select(*own, F.xxhash64(id_col, text_col).alias("_same"),
                       F.xxhash64(F.isnull(text_col), text_col, id_col).alias("_same_too"))
    # Equal rows of a quarter of a block and more; two 64-bit hashes, so that no other row is taken for one.
    copies = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes"))
    hot = stored(copies.where((F.col("n") > 1) & (F.col("bytes") >= block_bytes // 4)).select(*same), "hot_rows")
    hot_rows = rows.join(hot, same, "left_semi")
    stand_ins = stored(hot_rows.select(id_col, text_col, *same).dropDuplicates(same), "stand_ins")
    dealt = (rows.join(hot, same, "left_anti").withColumn("_stand_in", F.lit(False))
             .unionByName(stand_ins.withColumn("_stand_in", F.lit(True)), allowMissingColumns=True)
             .select(*own, "_stand_in", F.pmod("_same", F.lit(blocks)).cast("int").alias("_block"))
             .repartition(blocks, "_block"))
    sent = dealt.groupBy("_block").applyInArrow(_send(width, buckets), "bucket int, block int, prints binary")
    answers = sent.groupBy("bucket").applyInArrow(_count(buckets), "block int, bucket int, bits binary")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in own] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("removed", span)])
    arrow = to_arrow_schema(schema)
    cold = (dealt.groupBy("_block").cogroup(answers.groupBy("block"))
            .applyInArrow(_remove(width, buckets, len(own), arrow), schema))
    return cold.unionByName(hot_rows.select(*own).mapInArrow(_remove_whole(width, arrow), schema))
