"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A word's symbols form a linked list; the adjacent pairs that have a merge rank wait in a heap; the lowest rank (leftmost
on ties) is popped and merged until none is left. A word's count is its initial symbols minus its merges. Counts of words are
cached in each worker, in a cache of bounded size; text goes through in Arrow batches, whole, row by row.

The vocabulary file (JSON of the tokenizers library, word ends and lower case) is a path; each worker reads it once.
Defined results: null and empty texts have 0 tokens; repeated rows are separate; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table
from .merging import merged

LIMIT = 2048
#: str.split() takes these for white space, the vocabulary's patterns may not.
ODD = re.compile("[\x1c-\x1f]")
#: Words kept in a worker's cache at most; it is emptied when full.
CACHE = 1 << 20
#: A word of more symbols than this is not cached.
CACHED_SYMBOLS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the characters from 256 on, in order of byte."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class MergeCounter(dict):
    """word -> number of tokens, worked out on first use."""

    def __init__(self, ranks: dict[tuple[str, str], int], suffix: str):
        super().__init__()
        self.ranks, self.suffix, self.symbols = ranks, suffix, byte_symbols()

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= CACHED_SYMBOLS:
            self[word] = n
        return n

    def count(self, word: str) -> int:
        s = [self.symbols[b] for b in word.encode()]
        s[-1] += self.suffix
        return len(merged(s, self.ranks.get))  # initial symbols minus merges


class ChunkCounter(dict):
    """Run of characters between white space -> number of tokens, worked out on first use."""

    def __init__(self, counter: TokenCounter):
        super().__init__()
        self.count = counter.chunk

    def __missing__(self, chunk: str) -> int:
        n = self.count(chunk)
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= CACHED_SYMBOLS:
            self[chunk] = n
        return n


class TokenCounter:
    """Counts as the library gives them for a vocabulary of this kind: special strings in texts are single tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or d["model"]["type"] != "BPE" or d["model"]["unk_token"] is not None:
            raise ValueError(f"{path}: not a vocabulary of lower-case words with byte-level merges")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.words = MergeCounter({m: i for i, m in enumerate(merges)}, d["model"]["end_of_word_suffix"] or "")
        self.pieces = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [x["content"] for x in d["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

        self.chunks = ChunkCounter(self)

    def chunk(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule in the library
        return sum(map(self.words.__getitem__, self.pieces.findall(text.lower())))

    def plain(self, text: str) -> int:
        """No piece spans white space, and nothing composes with a space before it: chunks between spaces count alone."""
        if ODD.search(text):
            return self.chunk(text)
        return sum(map(self.chunks.__getitem__, text.split()))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [counter(path)(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_counting(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
