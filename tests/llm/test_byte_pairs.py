"""Byte-level BPE against the public library and against plain merging."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_text_operators import ODD, by_id, docs
from tidemark.llm import byte_pairs, queries

PATTERN = public_tokenizers.PATTERN
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PATH = public_tokenizers.path(FILES[0])


def library(known):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def ids_of(known, text):
    return np.frombuffer(known.encode(text), "<i4").tolist()


@pytest.mark.parametrize("name", FILES)
def test_random_texts_match_the_library(name):
    known = byte_pairs.vocabulary(public_tokenizers.path(name), PATTERN)
    own, rng = library(known), random.Random(5)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", "=", "==", "1", "12", "é", "日本", "'s", "ß", "\x1c", "😀", "tion", "<|endoftext|>", " "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        word = "".join(rng.choice("abeinorst") for _ in range(rng.randint(1, 80)))
        assert ids_of(known, text) == own.encode_ordinary(text)
        assert ids_of(known, word) == own.encode_ordinary(word)


@pytest.mark.parametrize("word", ["a" * 70_001, " " * 40_001, "ab" * 20_000, "=" * 33_333, "é" * 20_000])
def test_long_pretokens_need_several_searches(word):
    known = byte_pairs.vocabulary(PATH, PATTERN)
    assert ids_of(known, word) == library(known).encode_ordinary(word)


def test_long_texts_are_cut_into_runs(monkeypatch):
    known = byte_pairs.vocabulary(PATH, PATTERN)
    text = " ".join(f"word{i} {'x' * (i % 90)}" for i in range(4000))
    monkeypatch.setattr(byte_pairs, "LONG_TEXT", 1000)
    monkeypatch.setattr(byte_pairs, "RUN", 777)
    assert ids_of(known, text) == library(known).encode_ordinary(text)


def test_bounded_memory_of_pairs_and_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED_PAIRS", 20)
    monkeypatch.setattr(byte_pairs, "REMEMBERED_WORDS", 15)
    known = byte_pairs.BytePairs(dict(byte_pairs.vocabulary(PATH, PATTERN).ranks), PATTERN)
    text = " ".join(f"unlikelihood{i}ness" for i in range(200))
    assert ids_of(known, text) == library(known).encode_ordinary(text)
    assert len(known.pairs) <= 21 and len(known.words) <= 400


def test_tokens_that_merging_never_gives_are_not_used():
    # "abc" cannot arise: neither "ab" nor "bc" exists.
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"cd": 257}
    known = byte_pairs.BytePairs(ranks, PATTERN)
    assert ids_of(known, "abcd") == [97, 98, 257] == tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("abcd")


def test_the_right_end_may_need_shorter_tokens():
    # Greedy takes "ab", but "bc" merges first.
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257}
    known = byte_pairs.BytePairs(ranks, PATTERN)
    assert ids_of(known, "abc") == [97, 256] and ids_of(known, "abab") == [257, 257] and ids_of(known, "ababc") == [257, 97, 256]


def test_query_on_odd_texts(spark, tmp_path):
    docs(spark, ODD, ids=[*range(len(ODD) - 1), None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op12_byte_pairs(spark, str(tmp_path)))
    own = library(byte_pairs.vocabulary(PATH, PATTERN))
    for i, text in zip([*range(len(ODD) - 1), None], ODD, strict=True):
        ids = own.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, None, None)], "doc_id long, text string, ids string, decoded int")
    coded = byte_pairs.encode(rows, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"] and coded.count() == 3
    assert sorted((bytes(r.decoded) for r in byte_pairs.decode(coded, PATH, PATTERN).collect())) == [b"", b"a b", b"a b"]
    ids = spark.createDataFrame([([97, 60_000],), ([97, None],), (None,), ([],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in byte_pairs.decode(ids, PATH, PATTERN).collect()] == [None, None, b"", b""]
    assert byte_pairs.decode(byte_pairs.encode(rows.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0
