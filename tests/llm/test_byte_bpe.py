from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from loyalscope.llm.byte_bpe import SPACE, Coder, PerfectHash, decode, encode, parse_ranks
from loyalscope.llm.packing import read_vocabulary
from tests.llm.helpers import make_docs, real_docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(parse_ranks(read_vocabulary(PATH)))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(rows, texts, library):
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_real_documents(spark, library):
    docs = real_docs(spark)
    same(decode(encode(docs)).collect(), {r.doc_id: r.text for r in docs.collect()}, library)


def test_odd_texts(spark, library):
    rnd = random.Random(3)
    texts = [None, "", " ", "\n\n a", "  two  spaces \r\n\t x", "don't 's 'S we'll", "<|endoftext|>", "\x00\x1c\x1f\x85\xa0b",
             "é é 漢字かな 한글 \U0001f600\U0001f9d1‍\U0001f680 ½ ٣", "a" * 50_000, "ab " * 20_000]
    pool = [chr(c) for c in (32, 32, 10, 9, 39, 115, 65, 0x301, 0x3000, 0x4e00, 0x10ee7, 0x323e7, 0x11de1, 0x661, 0x1f600, 0x200d)]
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) for _ in range(300)]
    docs = make_docs(spark, texts).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    same(decode(encode(docs)).collect(), dict(enumerate(texts)), library)
    assert encode(docs.limit(0)).collect() == []
    rows = decode(encode(make_docs(spark, [(None, "a b"), (None, "a b")]))).collect()
    assert [bytes(r.decoded) for r in rows] == [b"a b"] * 2


def test_every_code_point_splits_as_the_library_does(library):
    coder = Coder(read_vocabulary(PATH), public_tokenizers.PATTERN)
    for lo in range(0, 0x110000, 64):
        for text in ("".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000),):
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(lo)
    spaces = regex.compile(r"\s")
    listed = regex.compile(f"[{SPACE}]")
    assert all(bool(spaces.match(chr(c))) == bool(listed.match(chr(c))) for c in range(0x110000))


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key{i}".encode() for i in range(5_000)]
    h = PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(5_000)) and sorted(h.index) == list(range(5_000))
    assert all(h.find(f"other{i}".encode()) == -1 for i in range(5_000))
