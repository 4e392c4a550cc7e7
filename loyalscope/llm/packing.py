"""Best-fit packing: documents cut into token pieces, pieces packed into sequences of fixed capacity.

Bulk-synchronous best fit. Pieces of equal length are interchangeable, so documents and gaps are kept
as *classes*: ``(length, first rank, count)`` for pieces and ``(gap, first sequence, count)`` for open
sequences. There are at most ``capacity`` lengths whatever the number of documents, and a length that
a third of all documents share is one class. A round

1. range-sorts the classes of pieces and gaps by size over the tasks of a Spark job,
2. sweeps every range from the longest piece down, each class taking its successor, the smallest gap
   that holds it; of several pieces that want the same gap class the first ranks get it,
3. sweeps what is left over coarser ranges, at last one (a few thousand rows at most),
4. updates the gaps and opens as many sequences as the tokens left over need at least, with the
   longest pieces left, and repeats until nothing is left.

The rounds only make a plan of rank intervals. Pieces get their rank within their length from counts by
(partition, length), so no task sees all pieces of a length, and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import zlib
from operator import add

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalscope.llm.common import Memo, raw_texts, stored, worker_cache

#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY = 64 << 20
#: Words whose ids one worker keeps, and bytes of text it works on at once.
ID_CACHE, CHUNK = 800_000, 4 << 20
#: Letters, or ASCII digits and punctuation but apostrophes: the tokenizer cuts between the two.
UNITS = re.compile(r"[^\W\d_]+|[!-&(-@\[-`{-~]+").findall
#: Lower-case Latin letters; of every line, its Latin letters, the ASCII punctuation (no apostrophe) that follows, and the rest.
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
WORDS = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)(.*)$", re.M).findall
PLAN_COLUMNS = ["length", "rank_lo", "count", "seq_lo", "offset"]


def read_vocabulary(path: str) -> bytes:
    """A tokenizer file as bytes, of a checked size (it is broadcast)."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return data


class WordTokenizer:
    """Ids of a text, word by word: this vocabulary never merges across ASCII white space.

    A word of letters and ASCII punctuation is cut further where the tokenizer always cuts it, so that
    "The", "the," and "the." need one lookup of "the". Apostrophes (contractions), combining marks and
    other symbols keep a word whole.

    Most new words are Latin letters and then ASCII punctuation. These are cut and lower-cased in bulk,
    and as the tokenizer's normalizer leaves them alone then, their letters are encoded without it.
    """

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.plain.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)         # ids that end a pre-token
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.units = Memo(None, ID_CACHE), Memo(None, ID_CACHE)

    @staticmethod
    def cut(word: str) -> list[str]:
        if word.isalpha():
            return [word.lower() if word.isascii() else word]
        units = UNITS(word)
        return [u.lower() if u.isascii() else u for u in units] if sum(map(len, units)) == len(word) else [word]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units: one call for all that are lower-case Latin letters, else one by one."""
        plain, of = [u for u in units if LETTERS(u)], {}
        if plain:
            ids = np.array(self.plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * ends).tolist()
                of = dict(zip(plain, map(raw.__getitem__, map(slice, [0, *at], at))))
        rest = [u for u in units if u not in of]
        coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        of.update((u, np.array(c.ids, "<u4").tobytes()) for u, c in zip(rest, coded))
        self.units.update(of)
        return of

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        self.words.trim()
        self.units.trim()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, size = np.frombuffer(b"".join(words), "<u4"), np.fromiter(map(len, words), np.int64, len(words)) >> 2
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        raw = ids[np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[at] - (ends - n), n)].tobytes()
        cuts = (4 * np.append(0, ends)[split.offsets.to_numpy()]).tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def ids_of(self, distinct: list[str]) -> list[bytes]:
        """Ids of each of some distinct words."""
        words = self.words.kept(distinct)
        new = [w for w, ids in words.items() if ids is None]
        if new:
            heads, tails, rests = zip(*WORDS("\n".join(new)))
            heads = "\n".join(heads).lower().split("\n")
            whole = {i: self.cut(new[i]) for i, rest in enumerate(rests) if rest}
            units = self.units.kept(list({"", *heads, *tails}.union(*whole.values())))
            units.update(self.learn([u for u, ids in units.items() if ids is None]))
            coded = list(map(add, map(units.__getitem__, heads), map(units.__getitem__, tails)))
            for i, us in whole.items():
                coded[i] = b"".join(map(units.__getitem__, us))
            words.update(zip(new, coded))
            self.words.update(zip(new, coded))
        return list(words.values())


def in_chunks(texts, limit: int = CHUNK):
    """Lists of consecutive texts of about ``limit`` bytes."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


def _cut(vocabulary, capacity: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        coder = worker_cache("packing", hashlib.sha256(vocabulary.value).digest(),
                             lambda: WordTokenizer(vocabulary.value))
        seen: dict[int, int] = {}
        pid = TaskContext.get().partitionId()
        for batch in batches:
            ids_of, rows = batch.column(0).to_pylist(), []
            at = 0
            for chunk in in_chunks(raw_texts(batch.column(1))):
                for ids in coder.encode(chunk):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo:lo + 4 * capacity]
                        n = len(part) // 4
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((ids_of[at], piece, lo // 4, n, zlib.crc32(part), part if with_ids else None, pid, seen[n]))
                    at += 1
            columns = list(zip(*rows)) or [()] * 8
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids", "pid", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return cut


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int, id_col: str, text_col: str,
                 with_ids: bool) -> DataFrame:
    """One row per piece, with its partition and its place among that partition's equals."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        _cut(vocabulary, capacity, end_id, with_ids),
        f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, pid int, nth long")


def sweep(pieces, gaps, capacity: int):
    """Best fit from the longest piece down over classes: (placed, pieces left, gaps left)."""
    by_size: dict[int, list] = {}
    for gap, seq, count in gaps:
        by_size.setdefault(gap, []).append((seq, count))
    sizes, placed, left = sorted(by_size), [], []
    for length, rank, count in sorted(pieces, reverse=True):
        while count:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                left.append((length, rank, count))
                break
            gap = sizes[i]
            seq, free = by_size[gap].pop()
            n = min(free, count)
            if free > n:
                by_size[gap].append((seq + n, free - n))
            elif not by_size[gap]:
                del by_size[gap], sizes[i]
            placed.append((length, rank, n, seq, capacity - gap))
            if gap > length:
                if gap - length not in by_size:
                    by_size[gap - length] = []
                    bisect.insort(sizes, gap - length)
                by_size[gap - length].append((seq, n))
            rank, count = rank + n, count - n
    return placed, left, [(g, *x) for g, xs in by_size.items() for x in xs]


def _sweep_range(capacity: int):
    def run(frames):
        rows = pd.concat(list(frames) or [pd.DataFrame(columns=["kind", "size", "lo", "count"])])
        of = {k: list(zip(g["size"], g["lo"], g["count"])) for k, g in rows.groupby("kind")}
        placed, left, gaps = sweep(of.get("piece", []), of.get("gap", []), capacity)
        out = [("placed", *x) for x in placed] + [("piece", *x, 0, 0) for x in left] + [("gap", *x, 0, 0) for x in gaps]
        yield pd.DataFrame(out, columns=["kind", *PLAN_COLUMNS])
    return run


def packing_plan(spark, histogram: dict[int, int], capacity: int, ranges: tuple[int, ...] = (8, 1)) -> pd.DataFrame:
    """Rank intervals of every length with their sequences and offsets, by rounds of range sweeps."""
    pieces = [(length, 0, n) for length, n in histogram.items()]
    gaps, plan, next_seq = [], [], 0
    while pieces:
        for parts in ranges if gaps else ():
            rows = [("piece", *x) for x in pieces] + [("gap", *x) for x in gaps]
            classes = spark.createDataFrame(rows, "kind string, size long, lo long, count long")
            dealt = classes.repartitionByRange(parts, "size") if parts > 1 else classes.coalesce(1)
            swept = (dealt.sortWithinPartitions(F.desc("size")).mapInPandas(_sweep_range(capacity), "kind string, length long, rank_lo long, count long, seq_lo long, offset long")
                     .collect())
            plan += [tuple(r)[1:] for r in swept if r.kind == "placed"]
            pieces = [tuple(r)[1:4] for r in swept if r.kind == "piece"]
            gaps = [tuple(r)[1:4] for r in swept if r.kind == "gap"]
        # The longest pieces left open the sequences that their tokens need at least.
        need, pieces = -(-sum(length * n for length, _, n in pieces) // capacity), sorted(pieces)
        while need and pieces:
            length, rank, count = pieces.pop()
            n = min(need, count)
            plan.append((length, rank, n, next_seq, 0))
            if length < capacity:
                gaps.append((capacity - length, next_seq, n))
            if count > n:
                pieces.append((length, rank + n, count - n))
            need, next_seq = need - n, next_seq + n
        smallest = min((p[0] for p in pieces), default=capacity)
        gaps = [g for g in gaps if g[0] >= smallest]
    return pd.DataFrame(plan, columns=PLAN_COLUMNS).sort_values(["length", "rank_lo"], ignore_index=True).astype("int64")


def _place(plan):
    def place(frames):
        table = plan.value
        keys = (table["length"].to_numpy() << 44) + table["rank_lo"].to_numpy()
        for rows in frames:
            at = np.searchsorted(keys, (rows["length"].to_numpy() << 44) + rows["rank"].to_numpy(), side="right") - 1
            rows["sequence_id"] = table["seq_lo"].to_numpy()[at] + rows["rank"].to_numpy() - table["rank_lo"].to_numpy()[at]
            rows["offset"] = table["offset"].to_numpy()[at]
            yield rows.drop(columns="rank")
    return place


def pack(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = 4096, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and its offset there.

    A document is its ids and then ``end_id``; only documents longer than ``capacity`` are cut, into
    pieces of ``capacity`` and a shorter last one. Columns: ``id_col``, ``piece``, ``start`` (ids of
    the document before the piece), ``length``, ``ids_crc32``, ``ids`` (little-endian unsigned 32-bit,
    NULL unless ``with_ids``), ``sequence_id`` (from 0) and ``offset`` (gapless from 0 in a sequence).

    NULL or empty text: one piece that is just ``end_id``. NULL ids and repeated rows are packed as
    documents of their own. An empty table gives an empty result. Equal lengths are ties; any of
    them may come first. The plan is bounded by the number of lengths, not by the documents.
    """
    spark = docs.sparkSession
    path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")
    pieces = stored(token_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(packing_plan(spark, histogram, capacity))
    ranked = pieces.join(bases, ["pid", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInPandas(_place(plan), f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, "
                                              "sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
