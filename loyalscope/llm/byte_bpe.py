"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by the tokenizer's pattern. Tier one resolves a pre-token that is a
token itself with one probe of a minimal perfect hash (hash and displace: no empty slot, one
displacement per bucket, the stored key decides whether it is a hit). Tier two merges the rest: the
bytes form a linked list, a heap holds the mergeable neighbours by rank, leftmost first. Results are
kept by pre-token and by white-space-delimited run in bounded per-worker memos of two generations.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from loyalscope.llm.common import Memo, single_spaced, worker_cache
from loyalscope.llm.packing import read_vocabulary

#: Entries of a worker's memos.
WORD_CACHE, PIECE_CACHE = 100_000, 600_000
#: Rows that a worker holds results of.
ROWS = 1_000
# Unicode white space.
SPACE = "\t-\r \x85\xa0  -     　"
# Code points that became letters or numbers after Unicode 16, which tiktoken follows.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de "
    "1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 "
    "3d000-3fc3f")


# Runs that need no general split: letters up to U+024F, then ASCII punctuation without apostrophes.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
MASK32 = (1 << 32) - 1
#: Ranks are below 2 ** SHIFT.
SHIFT = 24


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank, from a file of base64 tokens and ranks."""
    pairs = [line.split() for line in data.splitlines() if line]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``find`` gives a key's index or -1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            members[xxhash.xxh3_64_intdigest(k) % self.buckets].append(i)
        self.shift, slots = [0] * self.buckets, [-1] * n
        free = iter(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) > 1:
                d = 1
                while True:
                    at = [xxhash.xxh3_64_intdigest(keys[i], d) % n for i in members[b]]
                    if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                        break
                    d += 1
            elif members[b]:                      # a single key takes any free slot, named outright
                at = [next(s for s in free if slots[s] < 0)]
                d = -1 - at[0]
            else:
                continue
            self.shift[b] = d
            for s, i in zip(at, members[b]):
                slots[s] = i
        self.index, self.keys = slots, [keys[i] for i in slots]

    def find(self, key: bytes) -> int:
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        s = -1 - d if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.index[s] if self.keys[s] == key else -1


def split_pattern(pattern: str) -> regex.Pattern:
    """The tokenizer's pattern with the letters and numbers of Unicode 16."""
    newer = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
    for kind in ("L", "N"):
        pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", "<other>").replace(
            rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{newer}]]").replace("<other>", rf"[^\s\p{{L}}\p{{N}}]")
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"), regex.V1)


class Coder:
    """Encodes texts with one vocabulary; built once per worker."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.tokens = parse_ranks(vocabulary)
        self.ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.whole = PerfectHash(list(self.ranks))
        self.rank_at = list(self.ranks.values())
        self.byte_ids = [self.ranks[bytes([c])] for c in range(256)]
        # every token that is two tokens side by side, by these
        self.pairs = {self.ranks[t[:k]] << SHIFT | self.ranks[t[k:]]: i for t, i in self.ranks.items() for k in range(1, len(t))
                      if t[:k] in self.ranks and t[k:] in self.ranks}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.split = split_pattern(pattern).findall
        self.runs = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.by_word = Memo(self.word_ids, WORD_CACHE)
        self.by_piece = Memo(self.piece_ids, PIECE_CACHE)

    def encode(self, text: str) -> bytes:
        if single_spaced(text):
            first, *rest = text.replace("\n", " \n").split(" ")
            ids = self.run_ids(first) + b"".join(map(self.by_word.__getitem__, rest))
        else:
            ids = b"".join(map(self.run_ids, self.runs(text)))
        self.by_word.trim()
        self.by_piece.trim()
        return ids

    def word_ids(self, word: str) -> bytes:
        """Ids of a word after a space, or as it stands if it begins with a line break."""
        return self.by_piece["\n"] + self.run_ids(word[1:]) if word[0] == "\n" else self.run_ids(" " + word)

    def run_ids(self, run: str) -> bytes:
        simple = SIMPLE(run)
        if simple is None:
            return b"".join([self.by_piece[p] for p in self.split(run)])
        word, rest = simple.groups()
        return self.by_piece[word] + self.by_piece[rest] if rest else self.by_piece[word]

    def piece_ids(self, piece: str) -> bytes:
        raw = piece.encode()
        i = self.whole.find(raw)
        return self.packed[self.rank_at[i]] if i >= 0 else b"".join(map(self.packed.__getitem__, self.merge(raw)))

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties. The bytes are a linked list: node i has token ``ids[i]`` and ends at ``after[i]``,
        ``pair[i]`` is its rank with the next node or -1."""
        n, rank = len(raw), self.pairs.get
        ids = [self.byte_ids[c] for c in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(x << SHIFT | y, -1) for x, y in zip(ids, ids[1:])]
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, merged = entry & MASK32, entry >> 32
            if pair[i] != merged:                          # a neighbour has changed meanwhile
                continue
            j = after[i]
            end = after[i] = after[j]
            ids[i], ids[j], pair[j] = merged, -1, -1
            if end < n:
                before[end] = i
                pair[i] = r = rank(merged << SHIFT | ids[end], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                pair[p] = r = rank(ids[p] << SHIFT | merged, -1)
                if r >= 0:
                    push(heap, r << 32 | p)
        return [x for x in ids if x >= 0]


def _coder(vocabulary, pattern: str) -> Coder:
    data = vocabulary.value
    return worker_cache("byte bpe", (pattern, hashlib.sha256(data).digest()), lambda: Coder(data, pattern))


def _over(columns: int, make):
    """A mapInArrow function that appends ``make(batch)`` to the first ``columns`` columns."""
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                own = [batch.column(i) for i in range(columns)]
                name, new = make(batch)
                yield pa.RecordBatch.from_arrays([*own, new], names=[*batch.schema.names[:columns], name])
    return run


def encode(docs: DataFrame, vocabulary_path: str | None = None, pattern: str = public_tokenizers.PATTERN,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (token ids as little-endian unsigned 32-bit integers) per row.

    Strings of special tokens are ordinary text. NULL or empty text: no ids. NULL ids and repeated
    rows pass through. Texts of any length are encoded whole.
    """
    data = read_vocabulary(vocabulary_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(data)

    def ids(batch):
        coder = _coder(vocabulary, pattern)
        return "ids", pa.array([coder.encode(t or "") for t in batch.column(1).to_pylist()], pa.binary())

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_over(1, ids), f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded``, the bytes of the ``ids`` (an unknown id fails the job; NULL ids: empty)."""
    data = read_vocabulary(vocabulary_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    vocabulary = encoded.sparkSession.sparkContext.broadcast(data)

    def decoded(batch):
        tokens = worker_cache("byte bpe", hashlib.sha256(vocabulary.value).digest(),
                              lambda: parse_ranks(vocabulary.value))
        return "decoded", pa.array([b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                                    for x in batch.column(1).to_pylist()], pa.binary())

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(_over(2, decoded), f"`{id_col}` {kind}, ids binary, decoded binary")
