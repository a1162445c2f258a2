"""Substring deduplication by recompression: repeated 20-word windows are found through globally named symbols.

Words become 64-bit symbols. In ROUNDS rounds runs of one symbol, then pairs of a left and a right symbol (a bit of the name decides),
are replaced by names that are hashes of what they stand for, so every worker gives equal content equal names with no table. For each
symbol its context is kept: the words that alone determine that it was formed. Names go once through a packed exchange that
tells which occur elsewhere. A symbol that occurs once rules out every window that holds its context, since an equal window
would hold an equal symbol; runs of windows that nothing rules out are candidates, and only their 96-bit hashes are compared
exactly: the earliest occurrence of each (smaller id, earlier start) stays, words under the others are removed.

The input is read once and cut into blocks of whole documents, which are written to the shared folder; every pass reads those, so
whatever order the input's rows come in, and whichever executor is lost, a block is the same in all passes. What reducers find returns
to a block as one bit a name. Names that a block holds many times travel once, so a passage of a third of all documents is one
name a block.

Defined results: null, empty or blank texts have no words; null ids come last; rows that share an id count as one document after
another, in the order in which the input was read; an empty table gives an empty result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, byte_codes, lean, mix, powers, slices, span_hashes, table, text_bytes, words_of, written
from .packed import SCHEMA, by_block, cuts, exchange, from_planes, home, in_batches, n_reducers, pack_sorted, planes, runs, to_batch, unpack_sorted

WINDOW = 20
ROUNDS = 3
SLICE = 1 << 20
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
_NAMES, _BITS, _TEXT, _WINDOWS, _STARTS = range(5)
_CODES, _CODES_2 = byte_codes(33, lower=False), byte_codes(34, lower=False)
_LAST = np.iinfo(np.int64).max


class Block:
    """Whole documents in order of id: ids (null: the largest), null flags, UTF-8 bytes, offsets."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.ids, self.null, self.raw, self.offsets = ids, null, raw, offsets

    def packed(self) -> tuple[bytes, bytes, bytes]:
        head = self.ids.tobytes() + self.null.tobytes()
        return head, self.offsets.tobytes(), zstandard.ZstdCompressor(level=1).compress(self.raw.tobytes())

    @classmethod
    def unpacked(cls, a: bytes, b: bytes, c: bytes) -> Block:
        offsets = np.frombuffer(b, np.int64)
        n = len(offsets) - 1
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(c, max_output_size=max(1, int(offsets[-1]))), np.uint8)
        return cls(np.frombuffer(a[: 8 * n], np.int64), np.frombuffer(a[8 * n :], bool), raw, offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends in bytes of all words, first word of each document."""
        parts, firsts, n = [], [np.zeros(1, np.int64)], 0
        for i, j in slices(self.offsets, SLICE):
            at = self.offsets[i]
            s, e, f = words_of(self.raw[at : self.offsets[j]], self.offsets[i : j + 1] - at)
            parts.append((s + at, e + at))
            firsts.append(f[1:] + n)
            n += len(s)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *(p[0] for p in parts)]), np.concatenate([empty, *(p[1] for p in parts)]), np.concatenate(firsts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out, first = [np.zeros(0, np.uint64)], np.searchsorted(starts, self.offsets)
        for i, j in slices(self.offsets, SLICE):
            at, s = self.offsets[i], slice(first[i], first[j])
            out.append(span_hashes(self.raw[at : self.offsets[j]], starts[s] - at, ends[s] - at, codes))
        return np.concatenate(out)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Blocks of a partition of (doc_id, text)."""
    part, made = TaskContext.get().partitionId(), 0
    ids, null, raws, sizes, held = [], [], [], [], 0

    def closed():
        lengths = np.concatenate(sizes)
        flags = np.concatenate(null)
        keys = np.where(flags, _LAST, np.concatenate(ids))
        raw = np.concatenate(raws)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        order = np.lexsort((keys, flags))
        if (order != np.arange(len(order))).any():
            raw = np.concatenate([raw[offsets[k] : offsets[k + 1]] for k in order.tolist()])
            offsets = np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64)
        return (part << 24) | made, Block(keys[order], flags[order], raw, offsets)

    count = 0
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        flags = np.array(batch.column(0).is_null())
        keys = np.array(batch.column(0).fill_null(0))
        i, n = 0, batch.num_rows
        while i < n:
            # rows up to and with the one that fills the block
            j = min(n, int(np.searchsorted(offsets, offsets[i] + (BLOCK_BYTES - held))), i + BLOCK_DOCS - count)
            j = max(j, i + 1)
            ids.append(keys[i:j])
            null.append(flags[i:j])
            raws.append(raw[offsets[i] : offsets[j]])
            sizes.append(np.diff(offsets[i : j + 1]))
            held += int(offsets[j] - offsets[i])
            count += j - i
            i = j
            if held >= BLOCK_BYTES or count >= BLOCK_DOCS:
                yield closed()
                ids, null, raws, sizes, held, count, made = [], [], [], [], 0, 0, made + 1
    if count:
        yield closed()


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols, and the context [lo, hi) of each in words; contexts that reach beyond a document's
    words are given as lo > hi."""
    n = len(h)
    name, lo, hi = h, np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    known = np.ones(n, bool)  # nothing outside the document took part
    for r in range(rounds):
        # runs of one symbol; the neighbours end them, so they belong to the context
        if len(name) < 2:
            break
        same_doc = doc[1:] == doc[:-1]
        starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | ~same_doc]))
        length = np.diff(np.append(starts, len(name)))
        stops = starts + length - 1
        left, right = np.maximum(starts - 1, 0), np.minimum(stops + 1, len(name) - 1)
        inner = (starts > 0) & (doc[left] == doc[starts]) & (stops + 1 < len(name)) & (doc[right] == doc[starts])
        ok = inner & known[left] & known[right] & (np.minimum.reduceat(known, starts))
        new_lo = np.minimum(np.minimum.reduceat(lo, starts), np.where(inner, lo[left], 0))
        new_hi = np.maximum(np.maximum.reduceat(hi, starts), np.where(inner, hi[right], 0))
        run_name = np.where(length > 1, mix(name[starts] ^ (length.astype(np.uint64) * BASE) ^ np.uint64(r + 1)), name[starts])
        name, lo, hi, doc, known = run_name, new_lo, new_hi, doc[starts], ok
        # pairs of a left symbol (bit 0) and a right one (bit 1)
        side = (mix(name ^ np.uint64(0xABCD1234 + r)) & np.uint64(1)).astype(bool)
        m = len(name)
        pair = np.zeros(m, bool)
        pair[:-1] = ~side[:-1] & side[1:] & (doc[1:] == doc[:-1])
        second = np.concatenate([[False], pair[:-1]])
        i = np.flatnonzero(~second)
        p = pair[i]
        # what decides: the partner; for a single left symbol the next one, for a single right symbol the one before
        other = np.where(~side[i], np.minimum(i + 1, m - 1), np.maximum(i - 1, 0))
        there = (other != i) & (doc[other] == doc[i])
        joined = mix(name[i] * np.uint64(0xC2B2AE3D27D4EB4F) + name[other] + np.uint64(r))
        lo, hi, known = np.minimum(lo[i], np.where(there, lo[other], lo[i])), np.maximum(hi[i], np.where(there, hi[other], hi[i])), known[i] & there & known[other]
        name, doc = np.where(p, joined, name[i]), doc[i]
    return name, np.where(known, lo, 1), np.where(known, hi, 0)


def _split_bits(rows: list[tuple], kind: int, at: np.ndarray) -> np.ndarray:
    """One flag for each sorted name of a block, from what its reducers returned."""
    out = np.zeros(int(at[-1]), bool)
    for k, a, b, _ in rows:
        if k == kind:
            p = int.from_bytes(a, "big")
            out[at[p] : at[p + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=int(at[p + 1] - at[p])).astype(bool)
    return out


def _send_text(reducers: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in blocks(batches):
            yield to_batch([(home(block, reducers), _TEXT, block, *b.packed())])

    return run


def _send_names(reducers: int):
    """The distinct names of each written block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block, *packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                b = Block.unpacked(*packed)
                starts, ends, first = b.words()
                names = np.unique(recompress(b.hashes(starts, ends, _CODES), first)[0])
                at = cuts(names, reducers)
                yield from in_batches((p, _NAMES, block, pack_sorted(names[at[p] : at[p + 1]]), b"", b"") for p in np.flatnonzero(np.diff(at)).tolist())

    return run


def _mark_names(reducers: int):
    """For each block, a bit for each of its names: whether another block has it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, source = [], []
        for batch in batches:
            for to, _, block, a, _, _ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                names.append(unpack_sorted(a))
                source.append((to, block))
        if not names:
            return
        sizes = np.cumsum([0, *map(len, names)])
        h = np.concatenate(names)
        del names
        order = np.argsort(h, kind="stable")
        s, length = runs(h[order])
        shared = np.empty(len(h), bool)
        shared[order] = np.repeat(length > 1, length)
        for k, (to, block) in enumerate(source):
            yield to_batch([(home(block, reducers), _BITS, block, to.to_bytes(4, "big"), np.packbits(shared[sizes[k] : sizes[k + 1]]).tobytes(), b"")])

    return run


def candidates(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, shared: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the windows that no single symbol rules out."""
    n = int(first[-1])
    change = np.zeros(n + 1, np.int64)
    alone = ~shared & (hi > lo) & (hi - lo <= WINDOW)
    np.add.at(change, np.maximum(hi[alone] - WINDOW, 0), 1)
    np.add.at(change, lo[alone] + 1, -1)
    free = np.cumsum(change[:-1]) == 0
    inside = np.zeros(n + 1, np.int64)
    long = np.diff(first) >= WINDOW
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - WINDOW + 1, -1)
    return np.flatnonzero(free & (np.cumsum(inside[:-1]) > 0))


def window_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of words that start at `at`."""
    if len(at) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((sums[at + WINDOW] - sums[at]) * down[at])


def _send_windows(reducers: int):
    """Candidate windows of each block, the first of each kind; what the block itself knows goes along to its home."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_block(batches):
            (b,) = [Block.unpacked(*r[1:]) for r in rows if r[0] == _TEXT]
            starts, ends, first = b.words()
            h = b.hashes(starts, ends, _CODES)
            name, lo, hi = recompress(h, first)
            known, where, counts = np.unique(name, return_inverse=True, return_counts=True)
            shared = (counts > 1) | _split_bits(rows, _BITS, cuts(known, reducers))
            at = candidates(name, lo, hi, shared[where], first)
            if len(at) == 0:
                continue
            one = window_hashes(h, at)
            two = (window_hashes(b.hashes(starts, ends, _CODES_2), at) >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((two, one))  # stable: earlier windows first
            one, two, at = one[order], two[order], at[order]
            fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            yield to_batch([(home(block, reducers), _STARTS, block, planes(at[fresh].astype(np.uint32)), planes(at[~fresh].astype(np.uint32)), b"")])
            one, two = one[fresh], two[fresh]
            ids = b.ids[np.searchsorted(first, at[fresh], side="right") - 1]
            cut = cuts(one, reducers)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[p], cut[p + 1])
                yield to_batch([(p, _WINDOWS, block, pack_sorted(one[s]), planes(two[s]), planes(ids[s]))])

    return run


def _mark_windows(reducers: int):
    """For each block, a bit for each window it sent: whether the window starts earlier elsewhere; and the reducer's cut."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, ids, source = [], [], [], []
        for batch in batches:
            for to, kind, block, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == _STARTS:
                    yield to_batch([(home(block, reducers), kind, block, a, b, c)])
                else:
                    one.append(unpack_sorted(a))
                    two.append(from_planes(b, np.uint32))
                    ids.append(from_planes(c, np.int64))
                    source.append((to, block))
        if not one:
            return
        sizes = list(map(len, one))
        bounds = np.cumsum([0, *sizes])
        of = np.repeat(np.array([x[1] for x in source], np.int64), sizes)
        h1, h2, doc = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
        order = np.lexsort((of, doc, h2, h1))
        h1, h2 = h1[order], h2[order]
        later = np.empty(len(order), bool)
        later[order] = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
        for k, (to, block) in enumerate(source):
            yield to_batch([(home(block, reducers), _BITS, block, to.to_bytes(4, "big") + sizes[k].to_bytes(8, "big"), np.packbits(later[bounds[k] : bounds[k + 1]]).tobytes(), b"")])

    return run


def _finish(with_text: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_block(batches):
            (b,) = [Block.unpacked(*r[1:]) for r in rows if r[0] == _TEXT]
            starts, ends, first = b.words()
            covered = np.zeros(len(starts) + 1, np.int64)
            for kind, a, c, _ in rows:
                if kind != _STARTS:
                    continue
                # sent windows are in order of hash; the reducers' parts follow each other in that order
                bits = sorted((int.from_bytes(x[:4], "big"), int.from_bytes(x[4:], "big"), y) for k, x, y, _ in rows if k == _BITS)
                later = np.concatenate([np.unpackbits(np.frombuffer(y, np.uint8), count=n) for _, n, y in bits]).astype(bool)
                at = np.concatenate([from_planes(a, np.uint32)[later], from_planes(c, np.uint32)]).astype(np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + WINDOW, -1)
            gone = np.cumsum(covered[:-1]) > 0
            n = np.diff(first)
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[first[1:]] - sums[first[:-1]]
            data, kept = b.raw.tobytes(), ~gone
            s, e = starts.tolist(), ends.tolist()
            texts = []
            for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                texts.append(b" ".join([data[s[k] : e[k]] for k in (np.flatnonzero(kept[i:j]) + i).tolist()]))
            columns = [pa.array(b.ids, pa.int64(), mask=b.null), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if with_text:
                columns.append(pa.array([t.decode() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept] of every document."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    r = n_reducers(given)
    text = written(given.mapInArrow(_send_text(r), SCHEMA))
    names = exchange(text.mapInArrow(_send_names(r), SCHEMA), r).mapInArrow(_mark_names(r), SCHEMA)
    windows = written(exchange(text.unionByName(names), r).mapInArrow(_send_windows(r), SCHEMA))
    later = exchange(windows, r).mapInArrow(_mark_windows(r), SCHEMA)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return exchange(text.unionByName(later), r).mapInArrow(_finish(with_text), schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
