"""Words that detractors use (X7): per word, how many detractor and other documents contain it.

Documents are first joined with their labels (a small label table is broadcast, so the texts are
not shuffled, and unlabelled texts are never tokenised). Each text is then tokenised in its own row
(lower case, split on every run of non-letters) and only its distinct words are kept, so repeats
inside one text never leave the row and every whole text is read. After the explode the per-word
counts are combined map-side before the shuffle: a frequent word costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.measures import exact_ratio, pct

# Fixed value: a word is a maximal run of Unicode letters.
NON_LETTERS = r"[^\p{L}]+"


def document_words(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column but ``text_col``, plus ``words``: the distinct lower-case words of the text."""
    tokens = F.split(F.lower(F.col(text_col)), NON_LETTERS)
    keep = [c for c in documents.columns if c != text_col]
    return documents.select(*keep, F.array_distinct(F.array_remove(tokens, "")).alias("words"))


def detractor_words(documents: DataFrame, labels: DataFrame, is_detractor: str = "toxic",
                    min_docs: int = 1) -> DataFrame:
    """Every word of the labelled documents: document counts by tier and the lift.

    ``lift = (detractor docs with the word / detractor docs) / (docs with the word / docs)``, two
    decimals; above 1 the word is over-represented among detractors. ``min_docs`` above 1 leaves rare
    words out, if a caller wants that.

    The two totals come from one aggregate over the joined ids, a single row by construction.
    """
    labelled = documents.select("doc_id", "text").join(
        labels.select("doc_id", (F.col(is_detractor) == 1).alias("is_det")), "doc_id")
    totals = (documents.select("doc_id").join(labels.select("doc_id", (F.col(is_detractor) == 1).alias("is_det")), "doc_id")
              .agg(F.count(F.lit(1)).alias("all_docs"), F.count_if("is_det").alias("all_det")))
    per_word = (document_words(labelled).select("is_det", F.explode("words").alias("word")).groupBy("word")
                .agg(F.count(F.lit(1)).alias("docs"), F.count_if("is_det").alias("detractor_docs")))
    if min_docs > 1:
        per_word = per_word.where(F.col("docs") >= min_docs)
    n, det = F.col("docs"), F.col("detractor_docs")
    return per_word.crossJoin(F.broadcast(totals)).select(
        "word",
        det.alias("detractor_docs"),
        (n - det).alias("other_docs"),
        pct(det, n).alias("detractor_doc_pct"),
        exact_ratio(det * F.col("all_docs"), n * F.col("all_det"), 2).alias("lift"),
    )
