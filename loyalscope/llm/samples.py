"""Bounded samples for fitting classifiers: fixed numbers of rows, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.common import training_row


def hashed_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``keys``, one row per keys (all, if fewer), without one task that reads more
    than a few times that.

    A cut-off on the hash, taken from the row count, leaves about ``2 * most`` rows wherever they lie; only these are
    ranked. Should the hashes be so uneven that fewer than ``most`` pass, the cut-off is doubled.
    """
    total, share = rows.count(), 0.0
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    passed = hashed
    while total > 4 * most and share < 1:
        share = 2 * share or 2 * most / total
        passed = hashed.where(F.col("_hash") < int(min(share, 1) * (1 << 64)) - (1 << 63)) if share < 1 else hashed
        if passed.dropDuplicates(list(keys)).limit(most).count() == most:
            break
    return passed.dropDuplicates(list(keys)).orderBy("_hash", *keys).limit(most).drop("_hash")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, ``y`` of at most ``rows`` labelled training ids (of several labels of an id, the largest)."""
    known = (labels.where(training_row(id_col) & F.col(label).isin(0, 1))
             .groupBy(F.col(id_col).alias("_sample_id")).agg(F.max(label).cast("int").alias("_y")))
    sample = F.broadcast(hashed_sample(known, rows, "_sample_id"))     # bounded by ``rows``
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(sample, F.col("id") == F.col("_sample_id")).select("id", "text", F.col("_y").alias("y")))


def unlabelled_rows(docs: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` of at most ``rows`` training ids, whether labelled or not; no label is read."""
    ids = docs.where(training_row(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_sample_id")).distinct()
    sample = F.broadcast(hashed_sample(ids, rows, "_sample_id"))       # bounded by ``rows``
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(sample, F.col("id") == F.col("_sample_id")).select("id", "text"))
