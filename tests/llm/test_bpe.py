import random

import pytest
import tiktoken

from tidewright.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello world, hello  world's end",
    "  leading and trailing  \n\n\t ",
    "ЁЖИК и 日本語のテキスト🚀⚠️ naïve café",
    "<|endoftext|> is ordinary",
    "aaaaaaaaaaaaaaaa" * 40,
    "x" * 5000,
    "thethethe" * 300,
    "1234567890" * 60,
    "é" * 700,
    "\x00​﻿",
]


def test_texts_as_in_the_library(ranks, library):
    words = bpe._Words(ranks)
    for text in TEXTS:
        ids = bpe.encode_text(text, words)
        assert ids == library.encode_ordinary(text)
        assert library.decode(ids) == text


def test_random_texts(ranks, library):
    rng, words = random.Random(1), bpe._Words(ranks)
    letters = "abcdeth  inou\n'stéñ日本🚀0123.,-"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 400)))
        assert bpe.encode_text(text, words) == library.encode_ordinary(text)


def test_long_words_merge_as_short_ones(ranks, monkeypatch):
    rng = random.Random(2)
    samples = [bytes(rng.choice(b"abcdeth inou") for _ in range(rng.randrange(257, 900))) for _ in range(60)]
    heap = [bpe._merge_long(w, ranks) for w in samples]
    monkeypatch.setattr(bpe, "SHORT", 10**9)
    assert heap == [bpe.merge_word(w, ranks) for w in samples]


def test_full_memory_forgets(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    words = bpe._Words(ranks)
    text = "one two three four five six seven"
    assert bpe.encode_text(text, words) == library.encode_ordinary(text) and len(words) <= 3


def test_corpus(spark, library):
    data = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (101, "", "x"), (102, "again", "x"), (102, "again", "x"), (None, "no key", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t) if t else []) for i, t, _ in data), key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_counts(spark, library):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None, ""]], "text string")
    counts = df.select("text", bpe.token_count(df.text, bpe.broadcast_ranks(spark)).alias("n")).collect()
    assert all(r.n == (len(library.encode_ordinary(r.text)) if r.text else 0) for r in counts)
