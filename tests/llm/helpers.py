from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def make_docs(spark, texts, first_id=0, lang="en"):
    """texts: strings, or (doc_id, text) pairs."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (first_id + i, t)
        rows.append((doc_id, text, lang, "src0", None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCS)


def real_docs(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
