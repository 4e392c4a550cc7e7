"""The registered queries of this package: ``opN_<name>`` over the whole generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalscope.llm import byte_bpe, quality_classifier, secrets, toxicity
from loyalscope.llm.common import held_out
from loyalscope.llm.cross_tokens import align_tokens
from loyalscope.llm.gnat import hard_negatives
from loyalscope.llm.licenses import scan_licenses
from loyalscope.llm.minhash_forest import near_duplicates
from loyalscope.llm.packing import pack
from loyalscope.llm.quality_rules import quality_rules
from loyalscope.llm.rp_forest import nearest
from loyalscope.llm.substring_dedup import substring_dedup
from loyalscope.llm.vector_dedup import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def _scored(spark: SparkSession, sf_dir: str, method, label: str, threshold: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = method.fit(docs, table(spark, sf_dir, "labels"), label)
    return method.score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 0.7)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality_classifier, "quality", 0.5)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit(secrets.labelled_samples(docs)))
    base = [kind for kind, *_ in secrets.BASE]

    def listed(spans: str):
        return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")

    return found.select(
        "doc_id", *(F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in base),
        F.sha2(listed(f"filter(spans, s -> s.rank < {len(base)})").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    words = F.col("base.word")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.label", "found.label")), ",").alias("labels"),
        # the chance that any detection holds: a base phrase counts as certain
        F.when(F.size("base") > 0, 1.0).otherwise(F.aggregate("found.confidence", F.lit(1.0), lambda a, c: a * (1 - c), lambda a: 1 - a)).alias("score"))


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op11_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), lambda i: i % 100 == 0)


def op12_int8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_license_scan": op7_license_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_rp_forest": op9_rp_forest,
    "op10_quality_rules": op10_quality_rules,
    "op11_gnat_hard_negatives": op11_gnat_hard_negatives,
    "op12_int8_near_dedup": op12_int8_near_dedup,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: DuckDB SQL for the results that SQL can state in full; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS i FROM w)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win SEMI JOIN twice USING (s)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(len(ws), least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_of AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_of LEFT JOIN n USING (doc_id)""",
}
