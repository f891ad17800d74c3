import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airledger.llm.tokenizer import PATTERN, VOCABULARIES, Encoder, count_tokens, encode_column, merge, read_ranks

PATH = os.path.join(VOCABULARIES, "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def expected(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged_plainly(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_like_the_public_library(ranks, expected, text):
    assert Encoder(ranks).encode(text) == expected.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40))
def test_tree_like_plain_merging(ranks, piece):
    assert merge(piece, ranks) == (merged_plainly(piece, ranks) if piece else [])


@pytest.mark.parametrize("text", ["a" * 30_000, "測" * 8_000, "<|endoftext|>", "\n" * 2_000 + "x", "it's 'll 12,345 ½"])
def test_long_and_special(ranks, expected, text):
    ids = Encoder(ranks).encode(text)
    assert ids == expected.encode_ordinary(text)
    assert expected.decode(ids) == text


def test_table(spark, tiny, expected):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "two words", "z"), (4, "two words", "z")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_column(df, "doc_id", "text", PATH).collect()}
    two = expected.encode_ordinary("two words")
    assert got == {1: [], 2: [], 3: two, 4: two}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "doc_id", "text", PATH).collect()} == {1: 0, 2: 0, 3: len(two), 4: len(two)}
    assert encode_column(df.limit(0), "doc_id", "text", PATH).collect() == []


def test_corpus(spark, tiny, expected):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = {r["doc_id"]: expected.encode_ordinary(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in encode_column(docs, "doc_id", "text", PATH).collect()} == want
