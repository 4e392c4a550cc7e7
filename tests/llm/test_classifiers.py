from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyalscope.llm import quality_classifier, toxicity
from loyalscope.llm.common import held_out
from loyalscope.llm.toxicity import FactorizationMachine
from tests.llm.helpers import make_docs

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def auc_of(scored, labels, label):
    rows = scored.join(labels, "doc_id").where(held_out()).select("score", label).toPandas().dropna()
    rank, n1 = rows["score"].rank(), int((rows[label] == 1).sum())
    return (rank[rows[label] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1)), rows


def test_held_out_toxicity(tables):
    docs, labels = tables
    auc, rows = auc_of(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic")
    assert auc > 0.93 and ((rows.score >= 0.7) == (rows.toxic == 1)).mean() > 0.97
    assert ((rows.score >= 0.7) & (rows.toxic == 0)).mean() < 0.005


def test_held_out_quality(tables):
    docs, labels = tables
    auc, rows = auc_of(quality_classifier.score(docs, quality_classifier.fit(docs, labels)), labels, "quality")
    assert auc > 0.99 and ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.97
    assert (rows.score[rows.quality == 1] >= 0.5).mean() > 0.98


def test_factorization_machine_learns_a_pair_that_no_linear_weights_can():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3_000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([0] * a + [1] * b + [2 + int(rng.integers(0, 4))][: 1], np.int64))
        y.append(float(a != b))                     # exclusive or: additive weights cannot separate it
    model = FactorizationMachine(np.arange(6), 4).fit(rows, np.array(y), epochs=60)
    assert ((model.score(rows) >= 0.5) == np.array(y)).mean() > 0.95


def test_fit_on_texts_learns_a_pair_of_words_that_say_nothing_alone(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(4_000):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["heron"] * a + ["maple"] * b + [f"{'abcd'[j]}word" for j in rng.integers(0, 4, 2)]))
        labels.append((i, 1, int(a != b)))
    docs, known = make_docs(spark, texts), spark.createDataFrame(labels, LABELS)
    _, rows = auc_of(toxicity.score(docs, toxicity.fit(docs, known)), known, "toxic")
    assert len(rows) > 1_000 and ((rows.score >= 0.5) == (rows.toxic == 1)).mean() > 0.95


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_edges(spark, module, label):
    docs = make_docs(spark, [None, "", " \n", "x" * 100_000, "a b c", "a b c", (None, "a b c")])
    docs = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "y")
    for labels in ([], [(0, 1, 1), (1, None, None), (None, 0, 0)], [(i, i % 2, i % 2) for i in range(6)] * 2):
        model = module.fit(docs, spark.createDataFrame(labels, LABELS))
        rows = module.score(docs, model).collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (4, 5, None)}) == 1
        assert module.score(docs.limit(0), model).collect() == []
    assert module.fit(docs.limit(0), spark.createDataFrame([], LABELS)) is not None


def test_labels_of_held_out_rows_are_never_read(spark, tables):
    docs, labels = tables
    docs, flipped = docs.where("doc_id < 1500"), labels.withColumn(
        "quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_prior_from_positives_and_unlabelled_rows(spark, tables):
    """Within 0.05 of the labels' share, though no negative is labelled."""
    docs, labels = tables
    true = labels.agg(F.avg("quality")).head()[0]
    a, b = (quality_classifier.fit(docs, x) for x in (labels, labels.where("quality = 1")))
    assert abs(a.prior - true) < 0.05 and a.prior == b.prior and np.array_equal(a.weights, b.weights)
