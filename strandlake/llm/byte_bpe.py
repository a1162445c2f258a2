"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch become one code-point array. Each code point gets a symbol (its class, with the one character of lookahead that
the pattern needs); each symbol is a transition function on eight states; prefix compositions of those functions are found by an
associative scan (blocks in parallel, then the blocks' totals, again by the same scan), so the state before every character
is known without any regular expression. State and symbol say where a piece starts. Pieces feed pair merging by rank, cached
by piece in each worker.

Byte offsets of the pieces are retained: with the lengths of the merged symbols they give each id the byte at which its symbol
starts. Decoding puts each symbol at its offset, checks that symbols meet exactly, and can decode any stretch of bytes alone.

Defined results: null and empty texts have no ids; repeated rows are separate; an empty table gives an empty result; other
columns are not read. Text batches are cut to SLICE bytes (or one longer text), whole texts always.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, table, text_bytes
from .merging import merged

SLICE = 1 << 20
#: Pieces in a worker's cache at most, and the longest piece that is cached.
CACHE, CACHED_BYTES = 1 << 20, 64

# Symbols: letter; letter that ends a one-letter suffix; letter that begins a two-letter suffix; number; other; apostrophe;
# space before a solid character; other white space before one; white space before white space or the end; end of a text.
LET, ONE, TWO, NUM, OTH, APO, SPA, LAST, WHT, END = range(10)
# States: a piece must start next; in letters; in numbers; in others; after an apostrophe that starts a piece; within a
# two-letter suffix; after an attached space; in white space.
FRESH, LETTERS, NUMBERS, OTHERS, QUOTE, SUFFIX, SPACED, WHITES = range(8)
N_STATES = 8

# The white-space characters of the pattern, its one-letter suffixes, and its two-letter suffixes.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if symbol in (LET, ONE, TWO):
        if state == SUFFIX:
            return FRESH, False
        if state == QUOTE and symbol == ONE:
            return FRESH, False
        if state == QUOTE and symbol == TWO:
            return SUFFIX, False
        return LETTERS, state not in (LETTERS, SPACED)
    if symbol == NUM:
        return NUMBERS, state not in (NUMBERS, SPACED)
    if symbol in (OTH, APO):
        inside = state in (OTHERS, QUOTE, SPACED)
        return (OTHERS if inside or symbol == OTH else QUOTE), not inside
    if symbol == SPA:
        return SPACED, True
    if symbol == WHT:
        return WHITES, state != WHITES
    return FRESH, True


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Functions of the symbols, composition table, application table, piece starts, identity: the closed set of compositions."""
    base = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(10)]
    known = {tuple(range(N_STATES)): 0}
    for f in base:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:  # right multiplication by the symbols reaches every composition
        f = todo.pop()
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = sorted(known, key=known.get)
    n = len(functions)
    assert n <= 256
    composed = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    starts = np.array([[_step(s, c)[1] for c in range(10)] for s in range(N_STATES)])
    return np.array([known[f] for f in base], np.uint8), composed.ravel(), np.array(functions, np.uint8).ravel(), starts.ravel(), n


def _scan(f: np.ndarray, composed: np.ndarray, n: int) -> np.ndarray:
    """Inclusive prefix compositions of function ids (0 is the identity)."""
    size = len(f)
    if size <= 64:
        out = np.empty(size, np.uint8)
        acc = 0
        for i, x in enumerate(f.tolist()):
            acc = int(composed[acc * n + x])
            out[i] = acc
        return out
    long = 32
    blocks = -(-size // long)
    grid = np.zeros(blocks * long, np.uint8)
    grid[:size] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, long).T)
    for i in range(1, long):
        grid[i] = composed[grid[i - 1].astype(np.int32) * n + grid[i]]
    ahead = np.zeros(blocks, np.uint8)
    ahead[1:] = _scan(grid[-1], composed, n)[:-1]
    full = composed[ahead.astype(np.int32)[None, :] * n + grid]
    return np.ascontiguousarray(full.T).ravel()[:size]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Symbol of each code point without lookahead; white space is WHT, or SPA for the space itself."""
    kind = np.full(0x110000, OTH, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = LET
        elif k == "N":
            kind[c] = NUM
    kind[list(WHITE)] = WHT
    kind[0x20] = SPA
    kind[ord("'")] = APO
    kind[[ord(c) for c in ONE_LETTER]] = ONE
    return kind


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts that are each followed by one end mark (positions `ends`)."""
    symbol_function, composed, applied, starts, n = _machine()
    symbol = _classes()[points]
    symbol[ends] = END
    white = (symbol == WHT) | (symbol == SPA)
    following = np.empty(len(points), bool)  # a solid character of the same text comes next
    following[-1] = False
    following[:-1] = ~white[1:] & (symbol[1:] != END)
    solid_next = white & following
    symbol[solid_next & (symbol == WHT)] = LAST
    symbol[white & ~following] = WHT
    for a, b in TWO_LETTERS:
        at = np.flatnonzero(points[:-1] == ord(a))
        at = at[points[at + 1] == ord(b)]
        symbol[at[symbol[at + 1] != END]] = TWO
    prefix = _scan(symbol_function[symbol], composed, n)
    state = np.empty(len(points), np.int32)
    state[0] = FRESH
    state[1:] = applied[prefix[:-1].astype(np.int32) * N_STATES + FRESH]
    return starts[state * 10 + symbol]


class Merger(dict):
    """piece -> its ids as little-endian 32-bit integers, worked out on first use."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.merge(piece), "<i4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-rank adjacent pair first, the leftmost on ties, until no pair has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return [self.ranks[p] for p in merged([piece[i : i + 1] for i in range(len(piece))], lambda pair: self.ranks.get(pair[0] + pair[1]))]


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merged = Merger(ranks)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, r in ranks.items():
            self.bytes_of[r] = piece
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """The pieces of each text, as slices of its UTF-8, and the byte offset of each in its text."""
        rows = len(offsets) - 1
        marked = np.zeros(len(raw) + rows, np.uint8)  # an end mark after each text
        solid = np.ones(len(marked), bool)
        marks = offsets[1:] + np.arange(rows)
        solid[marks] = False
        marked[solid] = raw
        points = np.frombuffer(marked.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (marked & 0xC0) != 0x80  # first bytes of characters
        ends = np.cumsum(lead)[~solid] - 1
        begins = np.flatnonzero(lead)[piece_starts(points, ends)]  # end marks are pieces of their own
        heads = np.concatenate([[0], marks[:-1] + 1])
        first, last = np.searchsorted(begins, heads), np.searchsorted(begins, marks)
        data, at = marked.tobytes(), begins.tolist()
        for head, a, z in zip(heads.tolist(), first.tolist(), last.tolist(), strict=True):
            yield [data[x:y] for x, y in zip(at[a:z], at[a + 1 : z + 1], strict=True)], begins[a:z] - head

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text and the byte offset at which each id's symbol starts."""
        of = self.merged.__getitem__
        for pieces, begins in self.pieces(raw, offsets):
            each = list(map(of, pieces))
            ids = np.frombuffer(b"".join(each), "<i4")
            count = np.fromiter(map(len, each), np.int64, len(each)) >> 2
            ahead = np.cumsum(self.length_of[ids]) - self.length_of[ids]  # bytes of the symbols before
            first = np.cumsum(count) - count
            yield ids, ahead + np.repeat(begins - ahead[first], count)  # counted from the piece's own offset

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of the ids. Retained offsets must be where the symbols before each end, or the ids are not of that text."""
        if offsets is not None:
            length = self.length_of[ids]
            if len(offsets) != len(ids) or (np.cumsum(length) - length != offsets).any():
                raise ValueError("ids and their retained offsets do not belong together")
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode_span(self, ids: np.ndarray, offsets: np.ndarray, start: int, end: int) -> bytes:
        """Bytes [start, end) of the text, from the ids whose symbols touch them alone."""
        a = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
        z = int(np.searchsorted(offsets, end))
        if end <= start or a >= z:
            return b""
        at = int(offsets[a])
        return self.decode(ids[a:z])[max(0, start - at) : end - at]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Row ranges of a column and the (ids, offsets) of their texts: what is held at a time is bounded by SLICE, or one text."""
    raw, offsets = text_bytes(column)
    for i, j in slices(offsets, SLICE):
        yield i, j, list(codec(path).encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _schema(fields, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *more])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str | None = "offsets") -> DataFrame:
    """All columns but the text (and any of the new columns' names), the text's ids as array<int>, and the byte offset of each id's
    symbol as array<int> (left out where offsets_col is None)."""
    made = [ids_col, *([offsets_col] if offsets_col else [])]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    names = [*rest, *made]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, got in _encoded(batch.column(0), path):
                columns = [_lists([x[k] for x in got]) for k in range(len(made))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), *columns], names)

    given = docs.select(F.col(text_col), *rest)
    return given.mapInArrow(run, _schema(given.schema.fields[1:], *(f"`{c}` array<int>" for c in made)))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text", offsets_col: str | None = "offsets") -> DataFrame:
    """All columns but the ids and their offsets, and the text; bytes that are no UTF-8 become U+FFFD. Null ids give a null text.
    Offsets, where the column is there and not null, are checked against the symbols: a mismatch raises."""
    placed = offsets_col is not None and offsets_col in encoded.columns
    used = [ids_col, *([offsets_col] if placed else [])]
    rest = [c for c in encoded.columns if c not in (text_col, *used)]
    names = [*rest, text_col]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                ids, at = batch.column(0)[k].values, batch.column(1)[k].values if placed else None
                texts.append(None if ids is None else c.decode(np.asarray(ids, np.int32), None if at is None else np.asarray(at, np.int64)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(used) :], pa.array(texts, pa.string())], names)

    given = encoded.select(*used, *rest)
    return given.mapInArrow(run, _schema(given.schema.fields[len(used) :], f"`{text_col}` string"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids with their retained offsets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i, j, got in _encoded(batch.column(1), path):
                n, of_ids, of_text = [], [], []
                for ids, at in got:
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    of_text.append(hashlib.sha256(c.decode(ids, at)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, _schema(given.schema.fields[:1], "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
