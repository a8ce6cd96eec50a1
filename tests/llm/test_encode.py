from __future__ import annotations

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import encode as M
from factloom.llm.encode import PATTERN, encode, encoder, halves, vocabulary_path

own = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def direct():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(own.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=own.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["the", "'ll", "'re", "'", "'r", "e", "  ", " ", "\n", "\n\n", "\t", "123", "4", "日本語", "ไทย", "é", "🙂", "!!", "...", "aaaaaaa", "ab" * 30, "<|endoftext|>", "don't", "देव", "x" * 50]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=5), max_size=60), st.sampled_from([3, 7, 16, 40]))
def test_tree_is_exact(direct, parts, leaf):
    before, M.LEAF = M.LEAF, 16
    try:
        t = "".join(parts)
        assert encoder(vocabulary_path()).encode(t, leaf) == direct.encode_ordinary(t)
    finally:
        M.LEAF = before


@pytest.mark.parametrize("text", ["a" * 60_000, "日本語の文章です。" * 5_000, " " * 30_000 + "x", "0x1fec10xd6fbc" * 4_000])
def test_unsplit_texts(direct, text):
    assert encoder(vocabulary_path()).encode(text) == direct.encode_ordinary(text)


def test_halves():
    assert "".join(halves("abcdefghij", 3)) == "abcdefghij" and max(map(len, halves("abcdefghij", 3))) <= 3
    assert PATTERN


def test_table(spark, direct):
    texts = {1: "plain text", 2: None, 3: "", 4: "word " * 9_000, 5: "漢" * 20_000, 6: "<|endoftext|>", 7: " \n "}
    df = spark.createDataFrame([(i, t, "x", i) for i, t in texts.items()], "doc_id bigint, text string, ids string, n_tokens bigint")
    got = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text").collect()}
    assert got == {i: direct.encode_ordinary(t or "") for i, t in texts.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in encode(df.drop("n_tokens"), "doc_id", "text", counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_several_rounds(spark, direct):
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(n)) for n in (1, 40, 400, 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {x["id"]: x["ids"] for x in encode(df, "id", "text", leaf=5).collect()}  # over a thousand leaves: three rounds
    assert got == {i: direct.encode_ordinary(t) for i, t in enumerate(texts)}
