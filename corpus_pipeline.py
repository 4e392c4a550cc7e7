"""A corpus pipeline of five stages: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and gives back a DataFrame that is written as Parquet and read
again as the next stage's ``docs``; all but the last give back the columns of ``documents`` and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalscope.llm import quality_classifier, secrets
from loyalscope.llm.common import stored
from loyalscope.llm.minhash_forest import near_duplicates
from loyalscope.llm.packing import pack
from loyalscope.llm.queries import table
from loyalscope.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The documents' columns with a new text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.5 go."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.scorer(spark, model)(F.col("text")) >= 0.5).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) one row stays, that of the smallest id; one without an id comes last.

    The rows are numbered once and grouped by number, so rows that share an id, or have none, are documents of their own.
    Rows without words all stay.
    """
    rows = stored(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows, id_col="_row", width=5, share=80).where("n_shingles > 0").select("_row", "component_id")
    named = groups.join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")).alias("first")
    several = named.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("first._row").alias("stays"))
    gone = groups.join(several, "component_id").where("_row <> stays").select("_row")
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that repeat anywhere are cut out; other texts stay as they are."""
    cut = substring_dedup(docs, keep=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return _with_text(cut.withColumn("_kept", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))), F.col("_kept"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark."""
    ratios = secrets.fit(secrets.labelled_samples(docs))
    return _with_text(secrets.redact(docs, ratios, keep=("lang", "source", "n_chars")), F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages),
          ("secrets", redacted), ("packing", packed)]

#: No SQL: fitted models, a tokenizer and a packing that is not unique; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
