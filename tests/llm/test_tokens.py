"""The encoder against the library that reads the same vocabulary."""

import random

import pytest

from tracewright.llm import tokens

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_random_texts(library):
    r = random.Random(2)
    parts = ["a", "b", " ", "the", "ing", "<|endoftext|>", "é", "日本", "\n", "  ", "0", "12", "'s", "zz", "\x00", "🙂", "qu", "́", "ZZZZ", "…"]
    e = tokens.encoder()
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert e.encode(s) == library(s), s
        assert e.decode(e.encode(s)) == s


def test_long_piece(library):
    for s in ("a" * 20_000, "ab" * 9_000, " " * 5_000, "-" * 4_001):
        assert tokens.encoder().encode(s) == library(s)


def test_column(spark, library):
    rows = [(1, "Hello there", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_column(df, "doc_id", "text").collect())
    h = library("Hello there")
    assert got == [(1, h), (1, h), (2, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.encode_column(df, "doc_id", "text", only_count=True).collect()) == [(1, len(h)), (1, len(h)), (2, 0), (3, 0)]
    assert tokens.encode_column(df.where("false"), "doc_id", "text").collect() == []
