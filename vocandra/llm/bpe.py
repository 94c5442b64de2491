"""Encoding of the whole corpus with a public tokenizer (problem 8).

Byte-level BPE: a text is split by the tokenizer's pattern, and each piece's bytes are merged, always the leftmost of
the adjacent pairs of lowest rank. A segment tree over the ranks of adjacent pairs gives that pair at its root; a merge
updates three leaves, so a piece of n bytes costs O(n log n) however long it is. Each distinct piece is merged once
per task and remembered; the memory is emptied at ``REMEMBERED`` pieces, which only costs time.

Defined results: null and empty texts give an empty list; blanks are text; strings of special tokens are ordinary
text; rows that come again are encoded again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
REMEMBERED = 300_000
#: Pieces up to this many bytes are remembered.
REMEMBERED_BYTES = 64

# Fixed value: the pattern by which the vocabulary's texts are split into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 60


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    part = [piece[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    # A leaf is the pair that starts at its place, as rank * n + place: the least is the leftmost of lowest rank.
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(part[i] + part[i + 1])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while tree[1] < NONE:
        i = tree[1] % n
        j = right[i]
        part[i] += part[j]
        part[j] = b""
        after = right[j]
        right[i] = after
        put(j, NONE)
        if after < n:
            left[after] = i
            rank = ranks.get(part[i] + part[after])
            put(i, NONE if rank is None else rank * n + i)
        else:
            put(i, NONE)
        before = left[i]
        if before >= 0:
            rank = ranks.get(part[before] + part[i])
            put(before, NONE if rank is None else rank * n + before)
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = right[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not isinstance(text, str) or not text:
            return out
        known = self.known
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "replace")
                ids = merge(data, self.ranks)
                if len(data) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of all documents. ``path``: the vocabulary's file, read by the driver; its size is fixed."""
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(path or vocabulary_path()))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encoder.encode(t) for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(encode, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens)."""
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(path or vocabulary_path()))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(ranks.value)
        for texts in batches:
            yield pd.Series([len(encoder.encode(t)) for t in texts], dtype="int32")

    return documents.select("doc_id", F.pandas_udf(count, "int")("text").alias("tokens"))
