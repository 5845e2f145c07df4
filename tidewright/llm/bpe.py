"""Byte-pair encoding of a corpus with the vocabulary of a public tokenizer.

A text is split by the tokenizer's pattern; the bytes of each word are merged by a contiguous rank array: part
boundaries and the ranks of adjacent pairs are held in two arrays, the least rank is looked for, its boundary
deleted and the ranks beside it refreshed, until no pair has a rank. Words of more than ``SHORT`` bytes keep the
same order of merges with a heap, as scanning would take time in the square of their length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import ship_package

#: The folder of the public tokenizers' files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a word up to which the arrays are scanned.
SHORT = 256
#: Words that a worker remembers at most, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and their ranks from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    rank_of = ranks.get
    cuts = list(range(len(word) + 1))
    beside = [rank_of(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while beside:
        least = min(beside)
        if least == _NEVER:
            break
        at = beside.index(least)
        del cuts[at + 1], beside[at]
        if at < len(beside):
            beside[at] = rank_of(word[cuts[at] : cuts[at + 2]], _NEVER)
        if at:
            beside[at - 1] = rank_of(word[cuts[at - 1] : cuts[at + 1]], _NEVER)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, least rank first and leftmost of equals, by a heap over linked parts."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (r := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, end[b]))

    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != stop:
            continue  # one of the parts has changed since
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    ids, a = [], 0
    while a < n:
        ids.append(ranks[word[a : end[a]]])
        a = end[a]
    return ids


class _Words(dict):
    """Ids of words met before; forgets all of them when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        ids = merge_word(word.encode(), self.ranks)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    return regex.compile(pattern).findall


def encode_text(text: str | None, words: _Words, pattern: str = PATTERN) -> list[int]:
    """Ids of one text; none for NULL and for the empty text."""
    return list(chain.from_iterable(map(words.__getitem__, _splitter(pattern)(text)))) if text else []


def broadcast_ranks(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """The vocabulary, of a fixed size of about 50,000 entries, for all workers; only the driver reads the file."""
    return ship_package(spark).sparkContext.broadcast(read_ranks(f"{folder}/{vocabulary}.tiktoken"))


_kept: list[_Words] = []


def _words(ranks: Broadcast) -> _Words:
    """The words that this worker remembers for a vocabulary, from task to task."""
    if not _kept or _kept[0].ranks is not ranks.value:
        _kept[:] = [_Words(ranks.value)]
    return _kept[0]


def token_ids(text: Column, ranks: Broadcast, pattern: str = PATTERN) -> Column:
    """``array<int>`` of token ids, without special tokens; an empty array for NULL and for the empty text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _words(ranks)
        for batch in batches:
            yield pd.Series([encode_text(t, words, pattern) for t in batch], dtype=object)

    return ids(text)


def token_count(text: Column, ranks: Broadcast, pattern: str = PATTERN) -> Column:
    """Number of token ids; 0 for NULL and for the empty text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, split = _words(ranks), _splitter(pattern)
        for batch in batches:
            yield pd.Series([sum(map(len, map(words.__getitem__, split(t)))) if t else 0 for t in batch], dtype="int64")

    return count(text)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` of every document, whole texts, one row per row of the input.

    Defined results: NULL and empty texts have no ids (an empty list); strings that look like special tokens are
    ordinary text; repeated rows stay repeated; other columns are ignored, whatever their names.
    """
    ranks = broadcast_ranks(documents.sparkSession, vocabulary, folder)
    return documents.select(F.col(key), token_ids(F.col(text), ranks).alias("ids"))
