from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loyalscope.llm.common import Memo
from loyalscope.llm.packing import WordTokenizer, pack, packing_plan, read_vocabulary
from tests.llm.helpers import make_docs, real_docs


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer, capacity):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    want = {(d, p): (s, len(x[s:s + capacity]), zlib.crc32(np.array(x[s:s + capacity], "<u4").tobytes()))
            for d, x in ids.items() for p, s in enumerate(range(0, len(x), capacity))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and s[0][0] == 0
        assert sum(s[-1]) <= capacity
    return len(sequences), -(-sum(map(len, ids.values())) // capacity)


def test_real_documents(spark, tokenizer):
    docs = real_docs(spark, "sf0.01")
    used, least = check(pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer, 4096)
    assert used <= least * 1.02 + 1


def test_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "é é x́ ǅ \x1c\x0b ſ İ", "<|endoftext|> 's don't 12 ½", "a" * 30_000, "x\x00y", "﻿z \U0001f600"]
    texts += ["tie tie"] * 40
    docs = make_docs(spark, texts).withColumnRenamed("lang", "piece").withColumnRenamed("source", "rank")
    check(pack(docs, capacity=50).collect(), dict(enumerate(texts)), tokenizer, 50)


def test_ids_empty_table_null_ids_and_repeated_rows(spark, tokenizer):
    docs = make_docs(spark, [(None, "one two"), (None, "one two"), (3, "x"), (3, "x")])
    rows = pack(docs, with_ids=True).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert pack(docs.limit(0)).collect() == []


def test_plan_is_tight(spark):
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, 4096)
    sizes, n = np.unique(lengths, return_counts=True)
    plan = packing_plan(spark, dict(zip(sizes.tolist(), n.tolist())), 4096)
    assert plan["count"].sum() == 20_000
    used = plan["seq_lo"].add(plan["count"]).max()
    alone = int((lengths > 2048).sum())
    assert used <= 1.01 * max(alone, lengths.sum() / 4096)


def test_words_are_encoded_as_in_the_whole_text_and_once(tokenizer):
    words = ["The", "the,", "the.", "don't", "'s", "été.", "ÉTÉ", "Straße", "ß", "ÿ", "Ÿ", "µ", "ªº", "Æon", "İx", "ŉ", "ΣΑΣ", "ſ", "x́y", "12.", "a1b", "a.b", "a×b÷c", ".", "...",
             "--the", "it's.", "<|endoftext|>", "</w>", "a</w>b", "你好,", "ﬁn", "x\x1cy", "\x85z", "\xa0q", "\u3000", "a\x00b", "\U0001f600", "ZZZqqq", "the" * 30]
    texts = ["", " ", *words, " ".join(words), "\n\t " + "  ".join(words) + "\r\n", "\x0b\x0c"]
    coder = WordTokenizer(read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    coder.words, coder.units = Memo(None, 4), Memo(None, 4)          # every call pushes the last one's words into the older generation
    assert coder.encode([t.encode() for t in texts]) == want
    learned, learn = [], coder.learn
    coder.learn = lambda units: learned.extend(units) or learn(units)
    assert coder.encode([t.encode() for t in reversed(texts)]) == want[::-1]
    assert not learned
