from __future__ import annotations

import hashlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loyalscope.llm import cross_tokens
from loyalscope.llm.cross_tokens import Block, MinimalHash, Pair, Vocabulary, align_tokens, byte_characters, distinct, units_of
from tests.llm.helpers import make_docs, real_docs

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OF = byte_characters()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """(id, bytes) of both sides from the libraries on the whole text, or nothing."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    a = [(i, bytes(OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    return (a, b) if all(b"".join(t for _, t in x) == raw for x in (a, b)) else ([], [])


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows):
    linked, docs, seen = [], [], Counter()
    for _, text in rows:
        a, b = map(spans, tokens(text))
        links = [(i, j) for i, s, e in a for j, x, y in b if s < y and x < e] if len(a) < 400 else swept(a, b)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, lo = [], 0
        for end in ends:
            groups.append(tuple(",".join(str(i) for i, s, e in side if lo <= s < end) for side in (a, b)) if len(a) < 400 else None)
            lo = end
        docs.append((a, b, links, groups))
        seen.update(set(links))
    best = {}
    for (i, _), n in seen.items():
        best[i] = max(best.get(i, 0), n)
    for (doc_id, _), (a, b, links, groups) in zip(rows, docs):
        digest = None if None in groups else hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if a else ""
        linked.append((doc_id, len(a), len(b), len(groups), len(links), sum(seen[x] == best[x[0]] for x in links), sum(seen[x] for x in links), digest))
    return linked


def swept(a, b):
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def check(df, rows):
    assert df.columns == COLUMNS
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_given_documents(spark):
    docs = real_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(align_tokens(docs)[0], rows)
    check(align_tokens(docs, block_bytes=2_000, fan=3)[0], rows)          # many blocks, several levels of the tree


ODD = [None, "", " ", "  ", "a", "a  b", "\n", "a\nb c\n\nd", "\n\n a", " lead", "trail ", "tab\tx \t y", "c\r\nd;\r\ne", "x y z", "▁", "a ▁b", "p▁q r",
       "<s> </s> <unk> <|endoftext|> <0x0A>", "don't I'll we've 's", "été ﬁn", "你好 世界", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ok",
       "a\0b c", "x​ y﻿ z", "　wide　", "1234567 8.9 10,000", "z" * 3000, "ab " * 700, "a\u0085b  c", "a \x1cb\x1d c", "᠎x y"]


def test_odd_texts_nulls_and_repeated_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "a b"), (None, "a b"), (3, "a  b"), (3, "the same"), (3, "the same")]
    docs = make_docs(spark, rows)
    check(align_tokens(docs)[0], rows)
    check(align_tokens(docs, block_bytes=100, fan=2)[0], rows)
    assert align_tokens(docs.limit(0))[0].collect() == []
    other = docs.selectExpr("CAST(doc_id AS STRING) AS block", "text AS ids", "lang AS a", "source AS codes")
    got = align_tokens(other, id_col="block", text_col="ids")[0]
    assert sorted(tuple(r)[1:7] for r in got.collect()) == sorted(r[1:7] for r in brute(rows))


def test_pairs_table(spark):
    rows = [(0, "the cat"), (1, "the hat"), (2, None)]
    seen = Counter(x for _, t in rows for x in set(swept(*map(spans, tokens(t))) if t else []))
    got = {(r.a, r.b): (r["count"], r.best) for r in align_tokens(make_docs(spark, rows))[1].collect()}
    assert got == {x: (n, n == max(m for y, m in seen.items() if y[0] == x[0])) for x, n in seen.items()}


def test_units_are_encoded_as_in_the_whole_text():
    pair = Pair(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    units = ["the", "\nNext", "don't", "été", "zzzq"]
    assert pair.many(units) == list(map(pair.one, units))
    assert pair.learn(units, [True] * 5) == list(map(pair.one, units)) == pair.learn(units, [True] * 5)
    for text in filter(None, ODD):
        whole = "".join(u if u[0] in " \n" else " " + u for u in units_of(text))
        assert whole == " " + text and all(units_of(text))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n).astype(np.uint64))
    index = MinimalHash.build(keys)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    assert (index.keys[index.find(keys)] == keys).all()
    if n:
        with pytest.raises(ValueError):
            index.find(np.array([1 << 62], np.uint64))


def test_documents_are_counted_by_sorting(monkeypatch):
    """``np.unique`` without places hashes integers one by one; the counts need none of it."""
    pair = Pair(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    texts = ["the cat", "the hat the", "", "zzzq hat", "the cat"]
    coded = [pair.learn(units_of(t), [True] * len(units_of(t))) if t else [] for t in texts]
    units = [x for c in coded for x in c]
    row = {"lengths": [len(c) for c in coded], "units": range(len(units)), "na": [len(a) // 4 for a, _ in units], "nb": [len(b) // 4 for _, b in units]}
    row = {k: np.array(v, "<u4").tobytes() for k, v in row.items()} | {"a": b"".join(a for a, _ in units), "b": b"".join(b for _, b in units)}
    block = Block(row, Vocabulary(pair.a_size, pair.b_size), 2)
    monkeypatch.setattr(np, "unique", None)
    got = dict(zip(block.codes.tolist(), block.document_counts().tolist()))
    monkeypatch.undo()
    assert got == {a << 32 | b: n for (a, b), n in Counter(x for t in texts for x in set(swept(*map(spans, tokens(t))) if t else [])).items()}
    for x in ([], [3], [2, 2, 1, 5, 2]):
        assert distinct(np.array(x, np.uint64)).tolist() == sorted(set(x))


def test_stored_blocks_are_packed_and_read_one_by_one(spark, monkeypatch):
    """A file's blocks are no single row group, which a task would hold whole, and numbers take the bytes they need."""
    kept, stored = {}, cross_tokens.stored
    monkeypatch.setattr(cross_tokens, "stored", lambda df, name, **more: kept.setdefault(name, stored(df, name, **more)))
    rows = [(i, f"the cat w{i}") for i in range(300)] + [(None, None), (300, "")]
    check(align_tokens(make_docs(spark, rows).coalesce(1), block_bytes=500)[0], rows)
    metas = [pq.read_metadata(urlparse(f).path) for f in kept["blocks"].inputFiles()]
    groups = [m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)]
    assert len(groups) > 20 and set(groups) == {1}
    for r in kept["blocks"].collect():
        assert len(r.units) <= 1 + 4 * 8 and len(r.na) <= 1 + 4 * 8 and len(r.a) <= 1 + 2 * sum(r.na[1:])


@pytest.mark.parametrize("x", [[], [0], [255], [256, 1], [70_000, 3], [1 << 24, 5], [(1 << 32) - 1]])
def test_packed_numbers(x):
    raw = cross_tokens.packed(np.array(x, np.int64))
    assert cross_tokens.unpacked(raw).tolist() == x and len(raw) == 1 + len(x) * max((max(x, default=0).bit_length() + 7) // 8, 1)
