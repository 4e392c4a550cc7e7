"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over a document's distinct terms.
The factors let two terms weigh more together than alone (an insult with a mention of a group).
Terms are 64-bit hashes of lower-case words without outer punctuation and of their first letters, so
inflected and compounded forms of a word share a term.

Fit: term counts by class over a bounded sample of labelled rows are made in Spark. Terms that speak for
or against toxicity and then the most frequent ones, telling alone or not, become the model's, and only their
indices reach the driver. Scoring is one pass over the texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.common import Memo, raw_texts, received, shipped, stored, worker_cache
from loyalscope.llm.samples import labelled_rows

#: Lengths of the word beginnings that are terms of their own.
STEMS = (4, 5)
# Words: runs of letters (or anything beyond ASCII) and apostrophes.
WORD = re.compile(rb"[a-z\x80-\xff']+")


def word_terms(word: bytes) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    text = word.decode()
    return (xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(text[:n].encode(), seed=n) for n in STEMS if len(text) >= n))


def words_of(raw: bytes) -> list[bytes]:
    return WORD.findall(raw.lower())


def _document_terms(batches):
    memo = worker_cache("toxicity", "terms", lambda: Memo(word_terms, 200_000))
    for batch in batches:
        terms = []
        for raw in raw_texts(batch.column(1)):
            found = set().union(*map(memo.__getitem__, set(words_of(raw))))
            terms.append(np.fromiter(found, np.uint64, len(found)).view(np.int64))
            memo.trim()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([t.tolist() for t in terms], pa.list_(pa.int64()))], names=["id", "y", "terms"])


class FactorizationMachine:
    """Binary terms; ``factors`` numbers per term; mini-batch Adagrad on the logistic loss."""

    def __init__(self, terms: np.ndarray, factors: int = 4, seed: int = 0):
        self.terms = terms                                   # 64-bit hashes, in the order of the weights
        self.bias = 0.0
        self.linear = np.zeros(len(terms))
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (len(terms), factors))

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self._one(r) for r in rows])

    def _one(self, r: np.ndarray) -> float:
        v = self.factors[r]
        s = v.sum(axis=0)
        return self.bias + self.linear[r].sum() + 0.5 * float((s * s).sum() - (v * v).sum())

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 20, rate: float = 0.15, l2: float = 1e-4,
            batch: int = 64, seed: int = 0) -> FactorizationMachine:
        rng = np.random.default_rng(seed)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        g_linear, g_factors, g_bias = (np.full(a.shape, 1e-2) for a in (self.linear, self.factors, np.zeros(1)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                part = order[lo:lo + batch]
                lengths = np.array([len(rows[i]) for i in part])
                at = np.concatenate([rows[i] for i in part]) if lengths.sum() else np.zeros(0, np.int64)
                of = np.repeat(np.arange(len(part)), lengths)
                v = self.factors[at]
                sums = np.zeros((len(part), v.shape[1]))
                np.add.at(sums, of, v)
                squares = np.bincount(of, (v * v).sum(axis=1), len(part))
                raw = self.bias + np.bincount(of, self.linear[at], len(part)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / np.sqrt(len(part))
                used, back = np.unique(at, return_inverse=True)
                d_linear = np.bincount(back, error[of], len(used)) + l2 * self.linear[used]
                d_factors = np.zeros((len(used), v.shape[1]))
                np.add.at(d_factors, back, error[of, None] * (sums[of] - v))
                d_factors += l2 * self.factors[used]
                g_linear[used] += d_linear ** 2
                g_factors[used] += d_factors ** 2
                g_bias += error.sum() ** 2
                self.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
                self.factors[used] -= rate / 4 * d_factors / np.sqrt(g_factors[used])
                self.bias -= rate * float(error.sum() / np.sqrt(g_bias[0]))
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = 12_000, max_terms: int = 4_096, min_docs: int = 4,
        min_z: float = 4.0, factors: int = 4) -> FactorizationMachine:
    """Fit on at most ``fit_rows`` labelled rows with crc32(id) % 3 != 1; at most ``max_terms`` terms.

    A term must stand in ``min_docs`` documents. Terms whose share of label-1 documents lies ``min_z`` standard
    deviations off the overall share, on either side, come first, then the others by the number of documents, as
    a term that says nothing alone may beside another. Pairs of terms beyond ``max_terms`` are not seen. Without both labels the model has no terms and scores the label share.
    """
    spark = docs.sparkSession
    sample = stored(labelled_rows(docs, labels, label, fit_rows, id_col, text_col).select("id", "text", "y")
                    .mapInArrow(_document_terms, f"id {docs.schema[id_col].dataType.simpleString()}, y int, terms array<long>"), "terms")
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).head()
    share = (positive + 0.5) / (n + 1)
    counts = (sample.select("y", F.explode("terms").alias("term")).groupBy("term")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where(F.col("n") >= min_docs))
    z = (F.col("k") - F.col("n") * F.lit(share)) / F.sqrt(F.col("n") * F.lit(share * (1 - share)))
    telling = F.when(F.abs(z) >= min_z, F.abs(z))
    best = [r.term for r in counts.orderBy(telling.desc_nulls_last(), F.desc("n"), "term").limit(max_terms).collect()]
    model = FactorizationMachine(np.array(best, np.int64), factors)
    if not 0 < positive < n:
        model.terms, model.linear, model.factors = model.terms[:0], model.linear[:0], model.factors[:0]
        model.bias = float(np.log(share / (1 - share)))
        return model
    chosen = spark.sparkContext.broadcast({t: i for i, t in enumerate(best)})      # at most max_terms
    rows = sample.select("id", "y", "terms").mapInPandas(_indices(chosen), "id string, y int, at array<int>").collect()
    rows.sort(key=lambda r: (r.id or "", r.y, r["at"]))
    return model.fit([np.array(r["at"], np.int64) for r in rows], np.array([r.y for r in rows], float))


def _indices(chosen):
    def run(frames):
        index = chosen.value
        for f in frames:
            at = [sorted(index[t] for t in terms if t in index) for terms in f["terms"]]
            yield pd.DataFrame({"id": f["id"].astype(str), "y": f["y"], "at": at})
    return run


def _score(model):
    def run(batches):
        machine = received(model)
        index = {int(t): i for i, t in enumerate(machine.terms.view(np.uint64))}
        memo = Memo(lambda w: tuple(index[t] for t in word_terms(w) if t in index), 300_000)
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(1)):
                found = set().union(*map(memo.__getitem__, words_of(raw)))
                rows.append(np.fromiter(sorted(found), np.int64, len(found)))
                memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(rows), pa.float64())], names=["id", "score"])
    return run


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) per row; whole texts; NULL or empty text scores the bias alone.

    Repeated rows and NULL ids pass through; a text's score does not depend on other columns.
    """
    sent = shipped(docs.sparkSession, model)                                       # at most max_terms terms
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_score(sent), f"id {kind}, score double").withColumnRenamed("id", id_col)
