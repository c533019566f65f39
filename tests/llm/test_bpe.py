"""BPE encoding against the tokenizers library, and the round trip."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonemill.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


def run(encoder, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, count = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    ends = np.cumsum(count)
    parts = [ids[e - c:e].tolist() for e, c in zip(ends, count)]
    return parts, bpe.decode_parts(encoder, ids, ends - count, ends)


TEXTS = ["", " ", "a", "It's we'll they've I'm 'stuff ''s x's's 's", "  two  spaces \n\n lines\t\ttabs \n", "été Größe ñandú 漢字 😀👍🏽 Ⅷ ½ ٣",
         "aaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!", "x<|endoftext|>y <|endoftext|><|endoftext|>", "<|endoftext", "|>", "a b c\u0085d\x1ce", "\n's \t't", "1234567890" * 30,
         "don't" + " " * 30 + "stop", "   ", "foo   ", "é‍﻿", "'ll'll're 'L 'S"]


def test_fixed_texts(encoder, library):
    got, back = run(encoder, TEXTS)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert back == TEXTS


def test_every_code_point_class(encoder, library):
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x30000)] if chr(c).isprintable() or c < 0x3000]
    random.Random(1).shuffle(chars)
    texts = ["".join(f"a{c}1{c}{c} {c}" for c in chars[i:i + 200]) for i in range(0, 20000, 200)]
    got, back = run(encoder, texts)
    for t, ids in zip(texts, got):
        assert ids == library.encode(t, add_special_tokens=False).ids
    assert back == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aest'lrvdm SÄñé1 \n\t.,!<|> 漢😀")), max_size=40), min_size=1, max_size=6))
def test_random_texts(encoder, library, texts):
    got, back = run(encoder, texts)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert back == texts


def test_cache_reset(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_FRAGMENTS", 10)
    for t in TEXTS * 2:
        assert run(encoder, [t])[0][0] == library.encode(t, add_special_tokens=False).ids


def test_query_edge_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world", None), (3, "Hello  world", None), (4, "long " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.encode(df, decode=True)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(want, "<u4").tobytes() and r.n_tokens == len(want) and r.decoded == (r.text or "")
    assert bpe.encode(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted(r.decoded for r in back) == sorted(r.text or "" for r in back)


def test_whole_table_against_library(spark, library):
    from tonemill.llm.queries import LLM_QUERIES
    from tonemill.llm.ragged import table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = LLM_QUERIES["op1_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
