"""Encoding against the library that publishes the vocabulary."""

import pytest
from hypothesis import given, settings, strategies as s
from tokenizers import Tokenizer

from matchweft.llm.bpe import TOKENIZER_DIR, Encoder, Merges, encode_corpus, token_counts

AWKWARD = [None, "", " ", "\n\n  x", "<|endoftext|> and <|startoftext|>", "don't WE'LL", "é́ ß 漢字かな 한국어 🙂👩‍🚀", "a" * 5000, "ab" * 3000 + " " * 400, "x​y﻿\x00\t\r\n", "1234567 89.0", "'s''s", " 　z"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Merges(f"{TOKENIZER_DIR}/byte_bpe_50k.json"))


def test_corpus_equals_the_library(spark, sf, library):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == library([r["text"] for r in rows])
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_awkward_texts(spark, library):
    rows = [(i if i != 3 else None, t, [1]) for i, t in enumerate(AWKWARD)] * 2
    got = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")).collect()
    want = library(AWKWARD)
    assert len(got) == len(rows)
    assert all(r["ids"] == want[3 if r["doc_id"] is None else r["doc_id"]] for r in got)
    assert got[0]["ids"] == [] and got[1]["ids"] == []
    assert encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>").limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(s.lists(s.text(max_size=60), max_size=5))
def test_any_text(encoder, library, texts):
    assert encoder.encode(texts) == library(texts)


def test_known_words_stay_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr("matchweft.llm.bpe.KEPT_WORDS", 3)
    texts = ["one two three four", "five six one", "two seven"]
    assert encoder.encode(texts) == library(texts)
