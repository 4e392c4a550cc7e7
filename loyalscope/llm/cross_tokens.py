"""Cross-tokenizer alignment: token pairs of two tokenizers that share bytes, with corpus-wide counts by minimal perfect hash.

1. Rows are cut into blocks of about ``block_bytes`` of text. A block's texts fall into units, single words mostly, at places
   where both tokenizers always cut, so every distinct unit is encoded once; a block is stored as its units' ids and its
   texts as unit numbers, in as few bytes as they take and in a row group of its own. (Texts that either tokenizer does not
   give back byte by byte have no units.)
2. First pass: a block aligns its units, the distinct pairs (A id, B id) of every document are counted, and the block's pairs leave
   in one packed row per shard (by A id).
3. A shard's distinct pairs, merged level by level, get a minimal perfect hash: in every level each key names a slot, keys alone in
   their slot stay, the others go on to the next level; the rank of a slot is the index. Keys are stored by index.
4. Branches of about ``fan`` blocks add their counts into dense vectors indexed by the hash; vectors are added up level by level, as
   a tree, to one per shard, which also knows each A id's highest count.
5. Second pass: a shard answers every block's pairs, in their order, by hash, the stored key verified; blocks align their
   documents again and add up what the links' counts say.

Nothing that grows with the corpus reaches the driver or a broadcast; no task sees more than ``fan`` rows of a shard.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.common import Memo, mix, shuffle_partitions, single_spaced, stored, worker_cache
from loyalscope.llm.packing import read_vocabulary

#: Units whose ids one worker keeps, and bytes of new units that are encoded at once.
UNITS, CHUNK = 150_000, 1 << 13
#: Units of documents whose pairs are counted at once.
PART = 100_000
# White space in the widest sense, and the piece vocabulary's mark for a space: units are never cut beside these.
WHITE = r"\s\u180e\u200b-\u200d\u2060\ufeff\u2581"
CUT = re.compile(rf"(?<=[^{WHITE}])(?=[ \n][^{WHITE}])")
PLAIN = re.compile(rf"\n?[^{WHITE}]+")
#: Binary columns of a stored block, each ``packed``.
ARRAYS = ("lengths", "units", "na", "nb", "a", "b")
#: A stored block is a row group of its own, so that a reader or writer holds one block's columns at a time, not a file's.
ONE_ROW = {"parquet.block.row.count.limit": "1", "parquet.page.row.count.limit": "1"}
#: Levels of a minimal perfect hash; what is left then is searched in order.
LEVELS = 40


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by one sort (``np.unique`` hashes integers, which takes several times as long here)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32 in as few bytes each (the first byte says how many) as the largest takes."""
    width = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([width]) + x.astype("<u4").view("u1").reshape(-1, 4)[:, :width].tobytes()


def unpacked(raw) -> np.ndarray:
    """The numbers of ``packed``, in four bytes each."""
    width, raw = raw[0], np.frombuffer(raw, "u1", offset=1)
    out = np.zeros((len(raw) // width, 4), "u1")
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u4").ravel()


def units_of(text: str) -> list[str]:
    """The units of a space and a text. One that begins with a line break or a space is meant as it stands, any other after a space."""
    if single_spaced(text):
        return text.replace("\n", " \n").split(" ")
    return [u if u[0] == "\n" or u[1:2] in ("", " ", "\n") else u[1:] for u in CUT.split(" " + text)]


class Pair:
    """Both tokenizers: ids of units and bytes of ids."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        of = byte_characters()
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(of.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.memo = Memo(None, UNITS)

    def a_ids(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def one(self, unit: str) -> tuple[bytes, bytes] | None:
        """Ids of a unit; None if either side gives back other bytes."""
        whole = unit if unit[0] in " \n" else " " + unit
        a, b = self.a_ids(whole), self.b.encode(whole[1:]) if whole[0] == " " else self.b.encode(whole)[1:]
        raw = whole.encode()
        same = all(b"".join(map(t.__getitem__, ids)) == raw for t, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if same else None

    def many(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of plain units, encoded as one text and cut again."""
        whole = " a " + " ".join(units)                             # a word goes first, as the piece side adds a space
        whole = whole.replace(" \n", "\n")
        raw = whole.encode()
        ends = np.cumsum([2, *(len(u.encode()) + (u[0] != "\n") for u in units)])
        sides = []
        for ids, size, table in ((self.a_ids(whole), self.a_size, self.a_bytes), (self.b.encode(whole[1:]), self.b_size, self.b_bytes)):
            coded = np.array(ids, "<u4")
            at = np.cumsum(size[coded])
            cut = np.searchsorted(at, ends)
            if at[-1] != ends[-1] or (at[cut] != ends).any() or b"".join(map(table.__getitem__, ids)) != raw:
                return list(map(self.one, units))
            coded, cut = coded.tobytes(), (4 * (cut + 1)).tolist()
            sides.append([coded[x:y] for x, y in zip(cut, cut[1:])])
        return list(zip(*sides))

    def learn(self, units: list[str], often) -> list[tuple[bytes, bytes] | None]:
        """Ids of distinct units, from memory where they are known; those marked as seen ``often`` are kept."""
        out = list(map(self.memo.known, units))
        new = [i for i, x in enumerate(out) if x is None]
        plain: list[int] = []
        size = 0
        for i in new:
            if PLAIN.fullmatch(units[i]):
                plain.append(i)
                size += len(units[i])
            else:
                out[i] = self.one(units[i])
            if plain and (size > CHUNK or i == new[-1]):
                for j, ids in zip(plain, self.many([units[j] for j in plain])):
                    out[j] = ids
                    if ids and often[j] and len(units[j]) <= self.memo.longest:
                        self.memo[units[j]] = ids
                self.memo.trim()
                plain, size = [], 0
        return out


class Vocabulary:
    """What alignment needs to know of both: bytes per id, and decimal ids before "," "|" (A) and "," ";" (B), to spell groups."""

    def __init__(self, a_size: np.ndarray, b_size: np.ndarray):
        self.a_size, self.b_size = a_size, b_size
        self.spelled = [f"{i}{mark}".encode() for size, marks in ((len(a_size), ",|"), (len(b_size), ",;")) for mark in marks for i in range(size)]
        self.spelled_size = np.array([len(x) for x in self.spelled], np.int64)


def _pair(models) -> Pair:
    a, b = models.value
    return worker_cache("alignment", hashlib.sha256(a + b).digest(), lambda: Pair(a, b))


def _vocabulary(sizes) -> Vocabulary:
    a, b = (np.frombuffer(x, np.int64) for x in sizes.value)
    return worker_cache("alignment pass", hashlib.sha256(a.tobytes() + b.tobytes()).digest(), lambda: Vocabulary(a, b))


class Numbering(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, x):
        v = self[x] = len(self)
        return v


def _encode(models, block_bytes: int, kind: pa.DataType):
    """A row per block: row ids, units per text, unit numbers, and by unit the number of ids of A and B and these ids."""
    def block_row(pair: Pair, number: int, ids: list, texts: list):
        numbers = Numbering()
        of = [list(map(numbers.__getitem__, units_of(t))) if t else [] for t in texts]
        units = np.fromiter(chain.from_iterable(of), np.int64)
        coded = pair.learn(list(numbers), (np.bincount(units, minlength=len(numbers)) > 1).tolist())
        bad = {u for u, x in enumerate(coded) if x is None}
        if bad:
            of = [[] if not bad.isdisjoint(us) else us for us in of]
            units = np.fromiter(chain.from_iterable(of), np.int64)
            coded = [x or (b"", b"") for x in coded]
        a, b = (zip(*coded) if coded else ((), ()))
        arrays = [np.array(list(map(len, of)), "<u4"), units,
                  np.array(list(map(len, a)), "<u4") // 4, np.array(list(map(len, b)), "<u4") // 4,
                  np.frombuffer(b"".join(a), "<u4"), np.frombuffer(b"".join(b), "<u4")]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(kind)), *(pa.array([packed(x)], pa.binary()) for x in arrays)],
                                          names=["block", "ids", *ARRAYS])

    def run(batches):
        pair, number = _pair(models), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = raw.as_py() or ""
                ids.append(i)
                texts.append(text)
                size += 64 + len(text)
                if size >= block_bytes:
                    yield block_row(pair, number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block_row(pair, number, ids, texts)
    return run


class Block:
    """A stored block, aligned. Links (A token, B token) are in the order of A tokens; ``codes`` are its distinct pairs by shard."""

    def __init__(self, row: dict, pair: Vocabulary, shards: int):
        self.lengths, self.units, na, nb, a, b = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("lengths", "units", "na", "nb", "a", "b"))
        self.na, self.nb, self.a, self.b = na, nb, a, b
        a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        a_start = a_end - pair.a_size[a]
        # tokens that end where one of the other side ends close a group; units close groups too
        first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end, "left")
        self.a_cut = b_end[last] == a_end if len(a) else np.zeros(0, bool)
        at = np.searchsorted(a_end, b_end, "left")
        self.b_cut = a_end[at] == b_end if len(b) else np.zeros(0, bool)
        links = last - first + 1
        link_a = np.repeat(np.arange(len(a)), links)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(links) - links, links) + first[link_a]
        codes, self.link_code = np.unique(a[link_a].astype(np.uint64) << np.uint64(32) | b[link_b].astype(np.uint64), return_inverse=True)
        shard = shard_of(codes, shards)
        order = np.argsort(shard, kind="stable")
        self.codes, self.shard = codes[order], shard[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.link_code = back[self.link_code]
        self.link_unit = np.repeat(np.repeat(np.arange(len(na)), na), links)

    def document_counts(self) -> np.ndarray:
        """How many documents hold each of ``codes``."""
        k, u = max(len(self.codes), 1), max(len(self.na), 1)
        own = distinct(self.link_unit * k + self.link_code)                     # distinct pairs of every unit
        unit, code = own // k, own % k
        per_unit = np.bincount(unit, minlength=u)
        first = np.cumsum(per_unit) - per_unit
        edges = np.concatenate([[0], np.cumsum(self.lengths)])
        counts, lo = np.zeros(len(self.codes), np.int64), 0
        while lo < len(self.lengths):                                           # some documents at a time
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PART, "right")) - 1)
            doc = np.repeat(np.arange(hi - lo), self.lengths[lo:hi])
            doc, held = np.divmod(distinct(doc * u + self.units[edges[lo]:edges[hi]]), u)
            n = per_unit[held]
            at = np.arange(n.sum()) + np.repeat(first[held] - (np.cumsum(n) - n), n)
            counts += np.bincount(distinct(np.repeat(doc, n) * k + code[at]) % k, minlength=k)[:len(counts)]
            lo = hi
        return counts

    def by_unit(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of links by unit."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        edge = np.searchsorted(self.link_unit, np.arange(len(self.na) + 1))
        return total[edge[1:]] - total[edge[:-1]]

    def by_document(self, of_unit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_unit[self.units], dtype=np.int64)])
        edge = np.concatenate([[0], np.cumsum(self.lengths)])
        return total[edge[1:]] - total[edge[:-1]]

    def groups(self) -> np.ndarray:
        """Groups by unit."""
        total = np.concatenate([[0], np.cumsum(self.a_cut)])
        edge = np.concatenate([[0], np.cumsum(self.na)])
        return total[edge[1:]] - total[edge[:-1]]

    def spelled(self, pair: Vocabulary) -> list[bytes]:
        """Every unit's groups as text, each with its ";"."""
        na, nb = len(pair.a_size), len(pair.b_size)
        token = np.concatenate([self.a + na * self.a_cut, 2 * na + self.b + nb * self.b_cut])
        group = np.concatenate([np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut])
        order = np.argsort(2 * group + np.repeat([0, 1], [len(self.a), len(self.b)]), kind="stable")
        whole = b"".join(map(pair.spelled.__getitem__, token[order].tolist()))
        size = np.concatenate([[0], np.cumsum(pair.spelled_size[token[order]])])
        cut = size[np.concatenate([[0], np.cumsum(self.na + self.nb)])].tolist()
        return [whole[x:y] for x, y in zip(cut, cut[1:])]


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of an A id are in one shard."""
    return (mix(codes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _arrays(table, i: int) -> dict:
    """A stored block's arrays."""
    return {n: unpacked(table.column(n)[i].as_buffer()) for n in ARRAYS}


def _blocks(batches, pair, shards):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("block")[i].as_py(), Block(_arrays(batch, i), pair, shards)


def _request(sizes, shards: int):
    """(shard, block, codes, counts): a block's distinct pairs and in how many of its documents they are."""
    def run(batches):
        for number, block in _blocks(batches, _vocabulary(sizes), shards):
            counts = block.document_counts()
            full, start = np.unique(block.shard, return_index=True)
            edges = [*start.tolist(), len(block.codes)]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int64()), pa.array(np.full(len(full), number)),
                pa.array([block.codes[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary()),
                pa.array([counts[x:y].astype(np.int64).tobytes() for x, y in zip(edges, edges[1:])], pa.binary())],
                names=["shard", "block", "codes", "counts"])
    return run


class MinimalHash:
    """Minimal perfect hash of distinct 64-bit keys: a bit array per level, the rank of a key's bit is its index."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        self.bits, self.sizes, self.keys = bits, sizes, keys
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        rest, bits, sizes, placed = keys, [], [], []
        for level in range(LEVELS):
            if not len(rest):
                break
            size = len(rest) + 1
            at = cls.slots(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            stay = alone[at]
            placed.append(rest[stay][np.argsort(at[stay])])
            rest = rest[~stay]
        bits.append(np.ones(len(rest), bool))
        sizes.append(len(rest))
        return cls(np.concatenate(bits), np.array(sizes, np.int64), np.concatenate([*placed, np.sort(rest)]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Indices of keys; a key that was not hashed is an error."""
        out, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, size in enumerate(self.sizes[:-1]):
            slot = self.starts[level] + self.slots(keys[rest], level, int(size))
            hit = self.bits[slot]
            out[rest[hit]] = self.rank[slot[hit]]
            rest = rest[~hit]
        if len(rest):
            last = self.rank[self.starts[-2]]
            out[rest] = last + np.minimum(np.searchsorted(self.keys[last:], keys[rest]), max(len(self.keys) - last - 1, 0))
        if (self.keys[np.minimum(out, len(self.keys) - 1)] != keys).any():
            raise ValueError("a pair that the first pass did not see")
        return out

    def packed(self) -> dict:
        return {"bits": pa.array([np.packbits(self.bits).tobytes()], pa.binary()), "sizes": pa.array([self.sizes.tobytes()], pa.binary()),
                "keys": pa.array([self.keys.tobytes()], pa.binary())}

    @classmethod
    def of(cls, table) -> MinimalHash:
        bits, sizes, keys = (table.column(c)[0].as_py() for c in ("bits", "sizes", "keys"))
        sizes = np.frombuffer(sizes, np.int64)
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool), sizes, np.frombuffer(keys, np.uint64))


def _merged(key, table):
    codes = distinct(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]))
    return pa.table({"shard": [key[0].as_py()], "branch": [key[1].as_py()], "codes": pa.array([codes.tobytes()], pa.binary())})


def _hashed(key, table):
    codes = distinct(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]))
    return pa.table({"shard": [key[0].as_py()], **MinimalHash.build(codes).packed()})


def _dense(key, requests, hashes):
    """A branch's counts as a dense vector."""
    index = MinimalHash.of(hashes)
    vector = np.zeros(len(index.keys), np.int64)
    for codes, counts in zip(requests.column("codes").to_pylist(), requests.column("counts").to_pylist()):
        vector[index.find(np.frombuffer(codes, np.uint64))] += np.frombuffer(counts, np.int64)      # a row's codes are distinct
    return pa.table({"shard": [key[0].as_py()], "branch": [key[1].as_py()], "vector": pa.array([vector.tobytes()], pa.binary())})


def _added(key, table):
    vector = sum(np.frombuffer(x, np.int64) for x in table.column("vector").to_pylist())
    return pa.table({"shard": [key[0].as_py()], "branch": [key[1].as_py()], "vector": pa.array([vector.tobytes()], pa.binary())})


def _answer(key, requests, hashes):
    """(block, shard, counts, best) of the requested pairs, in their order; ``best``: none of the A id's pairs counts more."""
    index, counts = MinimalHash.of(hashes), np.frombuffer(hashes.column("vector")[0].as_py(), np.int64)
    _, own = np.unique(index.keys >> np.uint64(32), return_inverse=True)
    most = np.zeros(own.max(initial=-1) + 1, np.int64)
    np.maximum.at(most, own, counts)
    best = counts == most[own]
    found = [index.find(np.frombuffer(x, np.uint64)) for x in requests.column("codes").to_pylist()]
    return pa.table({"block": requests.column("block"), "shard": requests.column("shard"),
                     "counts": pa.array([counts[f].tobytes() for f in found], pa.binary()),
                     "best": pa.array([best[f].tobytes() for f in found], pa.binary())})


def _align(sizes, shards: int, kind: pa.DataType, id_name: str):
    def run(key, blocks, answers):
        pair = _vocabulary(sizes)
        block = Block(_arrays(blocks, 0), pair, shards)
        order = np.argsort(answers.column("shard").to_numpy())
        counts, best = (np.concatenate([np.frombuffer(x, kind) for x in answers.column(c).take(pa.array(order)).to_pylist()] or [np.zeros(0, kind)])
                        for c, kind in (("counts", np.int64), ("best", bool)))
        ones = np.ones(len(block.link_code), np.int64)
        numbers = [block.by_document(x) for x in (block.na, block.nb, block.groups(), block.by_unit(ones), block.by_unit(best[block.link_code]),
                                                  block.by_unit(counts[block.link_code]))]
        spelled, units, at, sums = block.spelled(pair), block.units.tolist(), 0, []
        for n in block.lengths.tolist():
            sums.append(hashlib.sha256(b"".join(map(spelled.__getitem__, units[at:at + n]))[:-1]).hexdigest() if n else "")
            at += n
        return pa.Table.from_arrays([pa.array(blocks.column("ids")[0].as_py(), kind), *(pa.array(x, pa.int64()) for x in numbers), pa.array(sums, pa.string())],
                                    names=[id_name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = 4 << 20, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """Per row ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``; and the pairs' table.

    ``a_path`` is a byte-level vocabulary file (its text is a space and the text), ``b_path`` a piece model that adds a
    space itself. Tokens are linked if their byte ranges overlap; places where tokens of both end cut the text into groups. The
    count of an id pair is the number of rows that hold it linked; ``n_best`` are a row's links whose count is the highest of
    their A id, ``count_sum`` adds up the counts of all its links. The second result has one row per distinct pair: ``a``, ``b``, ``count``, ``best``.

    Texts that are NULL or empty, or that either tokenizer does not give back byte by byte, have no tokens: zeros, and '' as
    ``groups_sha256``. NULL ids and repeated rows are rows of their own. Empty in, empty out. A text longer than a block is a block.
    """
    spark = docs.sparkSession
    files = (read_vocabulary(a_path or public_tokenizers.path("byte_bpe_50k.json")), read_vocabulary(b_path or public_tokenizers.path("piece_bpe_32k.model")))
    pair = Pair(*files)
    models = spark.sparkContext.broadcast(files)
    sizes = spark.sparkContext.broadcast((pair.a_size.tobytes(), pair.b_size.tobytes()))
    from pyspark.sql.pandas.types import to_arrow_type
    kind, sql_kind = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()
    shards = max(shuffle_partitions(spark), 16)
    binaries = ", ".join(f"{c} binary" for c in ARRAYS)
    blocks = stored(docs.select(id_col, text_col).mapInArrow(_encode(models, block_bytes, kind), f"block long, ids array<{sql_kind}>, {binaries}"), "blocks",
                    options=ONE_ROW)
    requests = stored(blocks.drop("ids").mapInArrow(_request(sizes, shards), "shard long, block long, codes binary, counts binary"), "requests")
    levels = [blocks.count()]
    while levels[-1] > 1 or len(levels) < 2:
        levels.append(-(-levels[-1] // fan))
    branches = max(levels[1], 1)
    requests = requests.withColumn("branch", F.pmod(F.xxhash64("block"), F.lit(branches)))

    def up(branch: str = "branch") -> Column:
        return F.floor(F.col(branch) / fan).alias("branch")

    merged = requests.groupBy("shard", "branch").applyInArrow(_merged, "shard long, branch long, codes binary")
    for _ in levels[2:]:
        merged = merged.select("shard", up(), "codes").groupBy("shard", "branch").applyInArrow(_merged, "shard long, branch long, codes binary")
    hashes = stored(merged.groupBy("shard").applyInArrow(_hashed, "shard long, bits binary, sizes binary, keys binary"), "hashes")

    def spread(table: DataFrame) -> DataFrame:
        return table.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))))

    vectors = (requests.groupBy("shard", "branch").cogroup(spread(hashes).groupBy("shard", "branch"))
               .applyInArrow(_dense, "shard long, branch long, vector binary"))
    for _ in levels[2:]:
        vectors = vectors.select("shard", up(), "vector").groupBy("shard", "branch").applyInArrow(_added, "shard long, branch long, vector binary")
    counted = stored(hashes.join(vectors.select("shard", "vector"), "shard"), "counted")
    answers = (requests.groupBy("shard", "branch").cogroup(spread(counted).groupBy("shard", "branch"))
               .applyInArrow(_answer, "block long, shard long, counts binary, best binary"))
    numbers = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    aligned = (blocks.groupBy("block").cogroup(answers.groupBy("block"))
               .applyInArrow(_align(sizes, shards, kind, id_col), f"`{id_col}` {sql_kind}, {numbers}, groups_sha256 string"))
    return aligned, counted.select("keys", "vector").mapInArrow(_pairs, "a long, b long, count long, best boolean")


def _pairs(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            keys, counts = np.frombuffer(batch.column(0)[i].as_py(), np.uint64), np.frombuffer(batch.column(1)[i].as_py(), np.int64)
            a = (keys >> np.uint64(32)).astype(np.int64)
            _, own = np.unique(a, return_inverse=True)
            most = np.zeros(own.max(initial=-1) + 1, np.int64)
            np.maximum.at(most, own, counts)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts),
                                              pa.array(counts == most[own])], names=["a", "b", "count", "best"])
