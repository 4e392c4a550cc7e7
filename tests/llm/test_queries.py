from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from loyalscope.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=str)


def test_one_query_of_every_number():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    df = QUERIES[name](spark, DIR)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


#: Columns that the queries promise, with their types.
SCHEMAS = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_rp_forest": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                          "base_failed boolean, kept boolean",
    "op11_gnat_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_int8_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op13_cross_tokenizer": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema_and_whole_table(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == SCHEMAS[name]
    ids = {r[0] for r in df.select(df.columns[0]).distinct().collect()}
    number = int(re.match(r"op(\d+)_", name)[1])
    table, key = ("embeddings", "vec_id") if number in (9, 11, 12) else ("documents", "doc_id")
    want = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(key)
    asked = {9: "vec_id % 20 = 0", 11: "vec_id % 100 = 0"}.get(number, "true")
    assert ids == {r[0] for r in want.where(asked).collect()}
    assert not any(r is None for row in df.drop("first_word", "last_word").collect() for r in row)
