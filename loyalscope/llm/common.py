"""Helpers shared by the operators: word hashing, per-worker caches, training rows."""

from __future__ import annotations

import pickle
import re
import sys
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalscope.session import stored  # noqa: F401  (the operators take it from here)

MASK64 = (1 << 64) - 1
#: Words whose hash one Python worker keeps; the cache starts anew beyond it.
WORD_CACHE = 200_000


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, to size blocks (one pass over the text column)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).cast("long")).head()[0]


def worker_cache(owner: str, key, build: Callable):
    """``build()`` once per Python worker process and key. Workers outlive their tasks: a new ``owner`` empties the cache of the last one."""
    store = sys.__dict__.setdefault("_loyalscope_worker_cache", {})
    if (found := store.get((owner, key))) is None:
        if any(other != owner for other, _ in store):
            store.clear()
        found = store[owner, key] = build()
    return found


def shipped(spark: SparkSession, value):
    """A broadcast of ``value`` by value, so that workers need no copy of this package; read it with ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast):
    """The value of a ``shipped`` broadcast, unpickled once per task."""
    if not hasattr(broadcast, "loaded"):
        broadcast.loaded = pickle.loads(broadcast.value)
    return broadcast.loaded


class Memo(dict):
    """``memo[x]`` computes ``f(x)`` once. ``trim`` bounds its size between documents in two generations: about ``limit`` / 2 new
    entries push the older ones out, unless these were used meanwhile. Keys longer than ``longest`` are not kept."""

    def __init__(self, f: Callable | None, limit: int, longest: int = 64):
        super().__init__()
        self.f, self.limit, self.longest, self.old = f, limit, longest, {}

    def __missing__(self, x):
        v = self.old.get(x)
        if v is None:
            v = self.f(x)
        if not hasattr(x, "__len__") or len(x) <= self.longest:
            self[x] = v
        return v

    def known(self, x):
        """The kept value or None; nothing is computed."""
        v = self.get(x)
        if v is None and (v := self.old.get(x)) is not None:
            self[x] = v
        return v

    def kept(self, xs: list) -> dict:
        """The kept value or None of each of ``xs``; nothing is computed."""
        out = dict(zip(xs, map(self.get, xs)))
        if self.old:
            rest = [x for x, v in out.items() if v is None]
            found = {x: v for x, v in zip(rest, map(self.old.get, rest)) if v is not None}
            self.update(found)
            out.update(found)
        return out

    def trim(self) -> None:
        if 2 * len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def word_memo() -> Memo:
    """64-bit hashes of byte words, kept per worker."""
    return worker_cache("words", "words", lambda: Memo(xxhash.xxh3_64_intdigest, WORD_CACHE))


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (every output bit depends on every input bit)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# White space (and what may be taken for it) other than a single space or line break.
_DOUBLE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff]")


def single_spaced(text: str) -> bool:
    """Whether the text is not empty and its only white space is single spaces and line breaks inside."""
    return (bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _DOUBLE)
            and (text.isascii() or not _WIDE.search(text)))


def raw_texts(column) -> Iterable[bytes]:
    """UTF-8 bytes of an Arrow string column, some rows at a time; NULL counts as empty."""
    for lo in range(0, len(column), 256):
        yield from (x or b"" for x in column.slice(lo, 256).cast("large_binary").to_pylist())


def training_row(id_col: str = "doc_id"):
    """Rows whose labels may be learned from: crc32 of the id's text modulo 3 is not 1."""
    return ~F.coalesce(held_out(id_col), F.lit(False))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
