"""Encoding of whole texts with a public byte-level BPE vocabulary by prefix-sharing trie traversal.

A text is cut into words by the vocabulary's pattern. The distinct words of a batch go into a trie of bytes, which
is walked depth first. The state of a node is the last token of the encoding of its prefix: a token t that ends
the prefix is the last one iff it is itself encoded as one token and BPE would not merge across the boundary to
the token before it (the last token of the prefix without t). Exactly one token meets this, so one state per node
is enough, prefixes shared by many words are worked out once, and a word's ids are read off backwards.

Defined results: null and empty texts give an empty list; strings of special tokens in a text are ordinary text;
rows are kept as they are, also repeated ones. Batches hold a bounded number of rows and the cache of words a
bounded number of entries, whatever the size of the corpus.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import table

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The pattern that splits texts into words for both byte-level vocabularies (fixed value of the vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 200_000


class TrieEncoder:
    """Encodes sets of words; keeps the ids of the words it has met, up to ``cached`` of them."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {b: a for a, b in self.rank.items()}
        self.words = regex.compile(WORDS)
        self.cached, self.known = cached, {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # for a token, its parts by its last merge
        self.parts: dict[int, tuple[int, int] | None] = {}
        # tokens by reversed bytes, to find all tokens that end a prefix
        self.ends: dict = {}
        for piece, number in self.rank.items():
            node = self.ends
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = number

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain BPE, used for single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_whole(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merge(self.bytes_of[token]) == [self.bytes_of[token]]
        return self.whole[token]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for a single byte."""
        if token not in self.parts:
            piece, found = self.bytes_of[token], None
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                best = min(((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2:
                found = (self.rank[parts[0]], self.rank[parts[1]])
            self.parts[token] = found
        return self.parts[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the boundary between the two tokens: no merge across it comes before theirs are done."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit = left, right, 1 << 60
        rank, text = self.rank, self.bytes_of
        while True:
            joined = rank.get(text[a] + text[b])
            if joined is not None and joined < limit:
                known = False
                break
            # undo the merge that came last; among merges of one rank BPE takes the leftmost first, so a merge across
            # the boundary of the same rank as the right token's came before it, as the left token's came before that
            whose = "a" if a > b else "b"
            parts = self.split(a if whose == "a" else b)
            if parts is None:  # a single byte: only the other side can be undone
                whose = "b" if whose == "a" else "a"
                parts = self.split(a if whose == "a" else b)
                if parts is None:
                    known = True
                    break
            if whose == "a":
                limit, a = a, parts[1]
            else:
                limit, b = b + 1, parts[0]
        self.fits[(left, right)] = known
        return known

    def last(self, prefix: bytes, size: int, states: list[int]) -> int:
        """The last token of the encoding of ``prefix[:size]``; states[i] is that of the first i bytes."""
        node, at = self.ends, size
        while at:
            node = node.get(prefix[at - 1])
            if node is None:
                break
            at -= 1
            token = node.get(-1)
            if token is not None and self.is_whole(token) and (not at or self.stays(states[at], token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def learn(self, words: set[str]) -> None:
        """Insert the words into a trie and walk it depth first."""
        # a depth-first walk of the trie visits the words in sorted order; the stack of states is cut back to the shared prefix
        states, before = [-1], b""
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = len(os.path.commonprefix((before, word)))
            del states[shared + 1 :]
            for size in range(shared + 1, len(word) + 1):
                states.append(self.last(word, size, states))
            before, ids, at = word, [], len(word)
            while at:
                ids.append(states[at])
                at -= len(self.bytes_of[states[at]])
            ids.reverse()
            self.known[text] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        needed = {w for words in cut for w in words}
        if len(self.known) + len(needed) > self.cached:
            self.known = {}
        self.learn(needed - self.known.keys())
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encoded(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``df`` with the token ids of ``text_col``; no shuffle, all other columns are left as they are."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = encoder(path)
        for batch in batches:
            yield pd.Series(tokens.encode([t if isinstance(t, str) else None for t in batch]))

    return df.withColumn(out_col, ids(F.col(text_col)))


def counted(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``df`` with the number of tokens of ``text_col``, 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = encoder(path)
        for batch in batches:
            yield pd.Series([len(x) for x in tokens.encode([t if isinstance(t, str) else None for t in batch])], dtype="int64")

    return df.withColumn(out_col, count(F.col(text_col)))


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encoded(table(spark, directory, "documents").select("doc_id", "text")).select("doc_id", "ids")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
