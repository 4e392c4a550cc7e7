from __future__ import annotations

import subprocess
import sys
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import make_docs
from tests.llm.test_minhash_forest import brute as near_brute
from tests.llm.test_secrets import brute as secret_brute
from tests.llm.test_substring_dedup import brute as passage_brute

DIR = "/root/testdata/sf0.01"
REPO = Path(__file__).resolve().parents[2]


def rows(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before = rows(docs)
    good = corpus_pipeline.stored(corpus_pipeline.quality(spark, docs, DIR), "t")
    kept = rows(good)
    assert all(before[d] == r for d, r in kept.items())
    assert sum(d in kept for d, q in labels.items() if q == 1) > 0.95 * sum(q == 1 for q in labels.values())
    assert sum(d in kept for d, q in labels.items() if q == 0) < 0.2 * sum(q == 0 for q in labels.values())

    single = corpus_pipeline.stored(corpus_pipeline.near_dedup(spark, good, DIR), "t")
    want = near_brute({d: r.text for d, r in kept.items()}, 5)
    assert set(rows(single)) == {d for d, x in want.items() if x[2]}

    unique = corpus_pipeline.stored(corpus_pipeline.repeated_passages(spark, single, DIR), "t")
    texts = {d: r.text for d, r in rows(single).items()}
    cut = passage_brute(list(texts.values()), 35)
    assert {d: r.text for d, r in rows(unique).items()} == {d: x[2] if x[1] else t for (d, t), x in zip(texts.items(), cut)}
    assert any(x[1] for x in cut)

    clean = corpus_pipeline.stored(corpus_pipeline.redacted(spark, unique, DIR), "t")
    after = rows(clean)
    marked = 0
    for d, r in rows(unique).items():
        assert not secret_brute(after[d].text) and after[d].n_chars == len(after[d].text)
        marked += "[SECRET]" in after[d].text
        assert bool(secret_brute(r.text)) <= ("[SECRET]" in after[d].text)
    assert 0 < marked < 0.2 * len(after)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = corpus_pipeline.packed(spark, clean, DIR).collect()
    whole = {d: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for d, r in after.items()}
    assert {(p.doc_id, p.piece): p.ids_crc32 for p in pieces} == {
        (d, i): zlib.crc32(np.array(x[s:s + 4096], "<u4").tobytes()) for d, x in whole.items() for i, s in enumerate(range(0, len(x), 4096))}


def test_edges(spark):
    docs = make_docs(spark, [None, "", "one two three", "one two three", (None, "one two three"), "password = abcdefgh"])
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.repeated_passages, corpus_pipeline.redacted):
        assert stage(spark, docs.limit(0), DIR).collect() == []
        assert corpus_pipeline.COLUMNS == stage(spark, docs, DIR).columns
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()) == ["0", "1", "2", "5"]
    assert {r.doc_id: r.text for r in corpus_pipeline.redacted(spark, docs, DIR).collect()}[5] == "[SECRET]"
    assert len(corpus_pipeline.packed(spark, docs, DIR).collect()) == 6


def test_copies_under_one_id_or_none_come_out_once_with_their_words(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    near = c.replace("c59", "other")
    docs = make_docs(spark, [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (None, near), (3, d), (3, e), (3, e + " more"),
                             (4, a), (5, None), (None, ""), (None, "")])
    single = corpus_pipeline.stored(corpus_pipeline.near_dedup(spark, docs, DIR), "t")
    assert sorted((str(r.doc_id) for r in single.collect())) == ["1", "2", "3", "3", "5", "None", "None", "None"]
    assert {r.text for r in single.collect() if r.text} == {a, b, d, *(r.text for r in single.collect() if r.text and r.text[:2] in ("c0", "e0"))}
    left = corpus_pipeline.repeated_passages(spark, single, DIR)
    assert left.columns == corpus_pipeline.COLUMNS
    got = [(r.doc_id, r.text) for r in left.collect() if r.text]
    assert len(got) == 5 and {(1, a), (2, b), (3, d)} < set(got)
    assert {t for i, t in got if i is None} < {c, near} and {t for i, t in got if i == 3} - {d} < {e, e + " more"}
    assert sorted(str(r.doc_id) for r in left.collect() if not r.text) == ["5", "None", "None"]


def test_a_third_of_all_rows_equal_under_no_id(spark):
    hot, docs = " ".join(f"hot{i}" for i in range(50)), []
    for i in range(200):
        docs += [(None, hot), (i, " ".join(f"w{i}x{j}" for j in range(50))), (1000 + i, f"short {i}")]
    single = corpus_pipeline.near_dedup(spark, make_docs(spark, docs), DIR).collect()
    assert len(single) == 401 and sum(r.text == hot for r in single) == 1


def test_the_other_queries_work_without_the_subpackage(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("loyalscope", "tests", ".git", "corpus_pipeline.py"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "loyalscope").mkdir()
    for p in (REPO / "loyalscope").iterdir():
        if p.name != "llm":
            (tmp_path / "loyalscope" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    script = tmp_path / "run.py"
    script.write_text(f"import sys; sys.path.insert(0, {str(tmp_path)!r}); sys.dont_write_bytecode = True\n{code}\n")
    entry = tmp_path / "__spark_entry__.py"
    text = entry.read_text()
    entry.unlink()
    entry.write_text(text)
    subprocess.run([sys.executable, str(script)], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
