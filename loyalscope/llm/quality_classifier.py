"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the documents labelled 1; everything else is unlabelled web text whose labels
are not read. With class prior p the risk is p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]): where the
second term turns negative (l is the sigmoid loss) the step goes the other way, so the model cannot explain the positives
inside the unlabelled text away. f is additive: every document statistic is cut at quantiles of the
unlabelled sample and each bin has a weight.

p comes from positives and unlabelled text alone: a model that tells the positives of all folds but one from the unlabelled rows of these folds
scores the fold left out. A document's fold depends on its id alone, so no model scores a row that it has learned as a positive. Above any threshold lie a share a of the held-back positives and a share b of the unlabelled rows, and b >= p a, as
the unlabelled positives are scored like the held-back ones; so b / a where its upper bound is least (the threshold above
which hardly anything but positives is left) estimates p.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalscope.llm.common import raw_texts, received, shipped
from loyalscope.llm.samples import labelled_rows, unlabelled_rows

#: Parts of the rows that take turns in being held back for the prior.
FOLDS = 5
SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)
FEATURES = (
    "log_words", "word_length", "upper", "digits", "pipes", "symbols", "bangs", "periods", "commas", "non_ascii",
    "distinct", "top_word", "repeated_next", "dup_lines", "line_words", "longest_word", "short_words", "same_pairs")


def statistics(raw: bytes) -> list[float]:
    """The document statistics of one whole text, in the order of ``FEATURES``."""
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = max(len(words), 1)
    upper, lower = by[65:91].sum(), by[97:123].sum()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = list(map(len, words)) or [0]
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(words)), sum(lengths) / n, upper / max(upper + lower, 1), by[48:58].sum() / n, by[124] / n,
        by[SYMBOLS].sum() / n, by[33] / n, by[46] / n, by[44] / n, by[128:].sum() / max(len(raw), 1),
        len(counts) / n ** 0.8, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), np.log1p(max(lengths)),
        sum(x < 3 for x in lengths) / n, 1 - pairs / max(len(words) - 1, 1)]


def _statistics_of(extra: int):
    def run(batches):
        for batch in batches:
            values = [statistics(raw) for raw in raw_texts(batch.column(1))]
            own = [batch.column(i) for i in (0, *range(2, 2 + extra))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values, pa.list_(pa.float64()))], names=[str(i) for i in range(len(own) + 1)])
    return run


class PUModel:
    """Additive model over binned statistics."""

    def __init__(self, edges: list[np.ndarray], prior: float):
        self.edges, self.prior = edges, prior
        self.offsets = np.cumsum([0, *(len(e) + 1 for e in edges)])
        self.weights, self.bias = np.zeros(self.offsets[-1]), 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") + self.offsets[j] for j, e in enumerate(self.edges)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[bins].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))

    def tell_apart(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.03, l2: float = 1e-3) -> PUModel:
        """Logistic loss, both samples weighing the same (Adam on all rows)."""
        bins = np.concatenate([self.bins(positive), self.bins(unlabelled)])
        y = np.repeat([1.0, 0.0], [len(positive), len(unlabelled)])
        weight = 0.5 / np.where(y == 1, len(positive), len(unlabelled))
        size = self.offsets[-1] + 1
        theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        for t in range(1, steps + 1):
            self.weights, self.bias = theta[:-1], float(theta[-1])
            d = weight * (1 / (1 + np.exp(-np.clip(self.raw(bins), -30, 30))) - y)
            g = np.append(np.bincount(bins.ravel(), np.repeat(d, bins.shape[1]), size - 1), d.sum()) + l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.weights, self.bias = theta[:-1], float(theta[-1])
        return self

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, rate: float = 0.02, l2: float = 2e-5) -> PUModel:
        """Adam on the whole sample; the negative part's gradient flips while its estimate is below 0."""
        p, bp, bu = self.prior, self.bins(positive), self.bins(unlabelled)
        size = self.offsets[-1] + 1
        theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)

        def gradient(bins, d):
            return np.append(np.bincount(bins.ravel(), np.repeat(d, bins.shape[1]), size - 1), d.sum())

        for t in range(1, steps + 1):
            self.weights, self.bias = theta[:-1], float(theta[-1])
            sp, su = (1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) for x in (bp, bu))
            steep_p, steep_u = p * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            g_negative = gradient(bu, steep_u) - gradient(bp, steep_p)
            g = g_negative - gradient(bp, steep_p) if su.mean() >= p * sp.mean() else -g_negative
            g += l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.weights, self.bias = theta[:-1], float(theta[-1])
        return self


def fold_of(doc_id, folds: int = FOLDS) -> int:
    """The fold of a document: one for all its rows, labelled or not."""
    return zlib.crc32(f"fold {doc_id}".encode()) % folds


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, positive_fold: np.ndarray, unlabelled_fold: np.ndarray,
                    edges: list[np.ndarray]) -> float:
    """The share of positives among the unlabelled rows; each fold is scored by a model of the other folds."""
    held, mixed = [], []
    for fold in range(FOLDS):
        ours, theirs = positive_fold == fold, unlabelled_fold == fold
        if ours.all() or theirs.all():
            return 0.5
        teller = PUModel(edges, 0.5).tell_apart(positive[~ours], unlabelled[~theirs])
        held.append(teller.raw(teller.bins(positive[ours])))
        mixed.append(teller.raw(teller.bins(unlabelled[theirs])))
    held, mixed = np.sort(np.concatenate(held)), np.sort(np.concatenate(mixed))
    at = np.unique(held)
    a, b = (1 - np.searchsorted(x, at) / len(x) for x in (held, mixed))
    doubt = (np.log(20) / 2) ** 0.5 * (len(held) ** -0.5 + len(mixed) ** -0.5)
    return float(np.clip((b / a)[np.argmin((b + doubt) / a)], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = 12_000, bins: int = 24) -> PUModel:
    """Fit on at most ``fit_rows`` trusted positives and ``fit_rows`` unlabelled rows, crc32(id) % 3 != 1.

    No label but 1 is read; the class prior is estimated from the positives and the unlabelled rows. Without positives or
    texts the model is constant and scores 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    trusted = labelled_rows(docs, labels.where(F.col(label) == 1), label, fit_rows, id_col, text_col)
    mixed = unlabelled_rows(docs, fit_rows, id_col, text_col).withColumn("y", F.lit(-1))
    rows = (trusted.unionByName(mixed).select("id", "text", "y")
            .mapInArrow(_statistics_of(1), f"id {kind}, y int, x array<double>").collect())
    rows.sort(key=lambda r: (r.y, str(r.id), r.x))
    positive = np.array([r.x for r in rows if r.y == 1]).reshape(-1, len(FEATURES))
    unlabelled = np.array([r.x for r in rows if r.y != 1]).reshape(-1, len(FEATURES))
    if not len(positive) or not len(unlabelled):
        return PUModel([np.zeros(0)] * len(FEATURES), 0.5)
    at = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.concatenate([np.quantile(unlabelled[:, j], at), np.quantile(unlabelled[:, j], [0.01, 0.99])]))
             for j in range(len(FEATURES))]
    folds = np.array([fold_of(r.id) for r in rows])
    is_positive = np.array([r.y == 1 for r in rows])
    prior = estimated_prior(positive, unlabelled, folds[is_positive], folds[~is_positive], edges)
    return PUModel(edges, prior).fit(positive, unlabelled)


def scorer(spark: SparkSession, model: PUModel):
    """A column function: text to score (0 to 1, the probability of label 1)."""
    sent = shipped(spark, model)                                             # a few hundred weights

    def score_texts(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(raw) for raw in raw_texts(texts)]).reshape(-1, len(FEATURES))
        return pa.array(received(sent).score(x), pa.float64())

    return F.arrow_udf(score_texts, "double")


def score(docs: DataFrame, model: PUModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` per row, over whole texts.

    NULL and empty texts are scored by their statistics like any other text. Repeated rows and NULL
    ids pass through; other columns are never read.
    """
    return docs.select(id_col, scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
