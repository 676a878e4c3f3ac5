import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ronda.llm import bpe
from ronda.llm.queries import WORD_TOKENIZER, llm_queries


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


PIECES = [*"abéÉİΣß½²_0 \n", "aa", "the", "ing", "'s", "'RE", "!!!", "</w>", "<|endoftext|>", "日本", "é", "\U0001f44d"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_same_ids_as_the_library(library, encoder, text):
    ids, counts = encoder.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert counts.tolist() == [len(ids)]


def test_repeated_letters_and_long_words(library, encoder):
    random.seed(1)
    texts = ["a" * k for k in range(50)] + ["ha" * 40, "!" * 50]
    texts += ["".join(random.choice("abcdeilnorst") for _ in range(random.randint(1, 60))) for _ in range(300)]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    for text in ("one two three four five six seven", "eight nine one two ten eleven twelve", "three one"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point(library, encoder):
    """As a letter, a digit or a mark beside others, in either case, whatever version of Unicode knows it."""
    texts = [f"a{c}b {c}{c} 1{c}!{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        ids, counts = encoder.encode(part)
        expected = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        got = np.split(ids, np.cumsum(counts)[:-1])
        wrong = [hex(ord(t[1])) for t, a, b in zip(part, got, expected, strict=True) if a.tolist() != b]
        assert wrong == []


def test_new_marks_compose_as_in_the_library(library, encoder):
    texts = ["x\U000105d2\u0307y", "\U00011382\U000113c9 \u1c89\u0301", "<|endoftext|>\ua7cb<|endoftext|>É"]
    ids, _ = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_odd_documents(spark, odd, library):
    rows = odd.select("doc_id", "text").collect()
    expected = sorted((repr(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in rows)
    found = bpe.encoded(odd, WORD_TOKENIZER)
    assert found.columns == ["doc_id", "ids"]
    assert sorted((repr(r.doc_id), list(r.ids)) for r in found.collect()) == expected
    both = bpe.decoded(found, WORD_TOKENIZER).collect()
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in both)
    once = bpe.round_trip(odd, WORD_TOKENIZER).collect()
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in once) == sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in both)
    assert bpe.digests(odd.limit(0), WORD_TOKENIZER).count() == 0


def test_query_against_the_library(spark, sf_dir, library):
    found = {r.doc_id: r for r in llm_queries()["op1_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
