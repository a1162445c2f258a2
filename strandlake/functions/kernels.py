"""Sequence kernels in numpy, and the Arrow operators that apply them to a column.

Hash arithmetic wraps at 64 bits in numpy and leaves as BIGINT with the same bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base codes A 0, C 1, G 2, T 3, anything else breaks a k-mer.
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i

# Amino acids of genetic code 11 in the order of codons TTT, TTC, TTA, TTG, TCT, ... (bases in the order T C A G).
CODE_11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMINO = "ACDEFGHIKLMNPQRSTVWY"
# Reduced alphabets.
MURPHY_10 = ("LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H")
DAYHOFF_6 = ("C", "AGPST", "DENQ", "HKR", "ILMV", "FWY")

U = np.uint64


def codes(seq: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(seq, np.uint8)]


def kmers(code: np.ndarray, k: int, canonical: bool = False) -> np.ndarray:
    """2-bit codes of all k-mers without a foreign character, in order; the lesser of both strands if canonical."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    ok = np.lib.stride_tricks.sliding_window_view(code, k).max(axis=1) < 4
    forward, reverse = np.zeros(n, U), np.zeros(n, U)
    c = code.astype(U) & U(3)
    for i in range(k):
        forward = (forward << U(2)) | c[i : i + n]
        if canonical:
            reverse |= (U(3) - c[i : i + n]) << U(2 * i)
    return (np.minimum(forward, reverse) if canonical else forward)[ok]


def murmur(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> U(33))
    v = v * U(0xFF51AFD7ED558CCD)
    v ^= v >> U(33)
    v *= U(0xC4CEB9FE1A85EC53)
    return v ^ (v >> U(33))


def splitmix(v: np.ndarray) -> np.ndarray:
    v = v + U(0x9E3779B97F4A7C15)
    v = (v ^ (v >> U(30))) * U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> U(27))) * U(0x94D049BB133111EB)
    return v ^ (v >> U(31))


def high_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper 64 bits of the 128-bit product."""
    m = U(0xFFFFFFFF)
    a0, a1, b0, b1 = a & m, a >> U(32), b & m, b >> U(32)
    low, mid1, mid2 = a0 * b0, a1 * b0, a0 * b1
    carry = (low >> U(32)) + (mid1 & m) + (mid2 & m)
    return a1 * b1 + (mid1 >> U(32)) + (mid2 >> U(32)) + (carry >> U(32))


def wymix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b) ^ high_product(a, b)


def oph_hash(kmer: np.ndarray, seed: int) -> np.ndarray:
    return wymix(kmer ^ U((seed + 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF), kmer ^ U(0xE7037ED1A0B428DB))


def oph_sketch(seq: bytes, k: int, bins: int, seed: int, densify: bool) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation sketch: the least 16-bit value of each bin (65535: empty), and which bins are real."""
    h = oph_hash(kmers(codes(seq), k, canonical=True), seed)
    sig = np.full(bins, 65535, np.int64)
    np.minimum.at(sig, high_product(h, np.full(len(h), bins, U)).astype(np.int64), ((h >> U(32)) & U(0xFFFF)).astype(np.int64))
    real = sig < 65535
    if densify and real.any() and not real.all():
        filled, ok = sig.copy(), real.copy()
        for order, step in ((range(1, bins), -1), (range(bins - 2, -1, -1), 1)):
            for i in order:
                if not ok[i] and ok[i + step]:
                    mixed = splitmix(np.array([filled[i + step] ^ i], U))[0]
                    filled[i], ok[i] = int((mixed >> U(32)) & U(0xFFFF)), True
        sig = filled
    return sig, real


def fnv1a_64(text: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in text:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def fnv1a_64_rows(column: pa.Array) -> np.ndarray:
    """The same for every row of a string column, byte by byte over all rows together; nulls hash as empty."""
    column = column.fill_null("").cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    h, length = np.full(len(column), 0xCBF29CE484222325, U), np.diff(offsets)
    for i in range(int(length.max(initial=0))):
        rows = np.flatnonzero(length > i)
        h[rows] = (h[rows] ^ raw[offsets[rows] + i]) * U(0x100000001B3)
    return h


def with_fnv1a_64(df: DataFrame, column: str, name: str) -> DataFrame:
    """All columns and the hash of a string column as BIGINT with the same bits."""
    rest = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fnv1a_64_rows(batch.column(0)).view(np.int64))], [*rest, name])

    given = df.select(F.col(column).alias("_input"), *rest)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[1:])
    return given.mapInArrow(run, f"{schema}`{name}` bigint")


def xxh3_content(contigs: list[str | None]) -> int:
    """64-bit XXH3 of a genome's content: contigs in upper case, sorted, each followed by a line feed; signed, with the same bits."""
    import xxhash

    text = "".join(c + "\n" for c in sorted((x or "").upper() for x in contigs))
    h = xxhash.xxh3_64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def half_floats(data: bytes) -> np.ndarray:
    """Little-endian 16-bit floats as 32-bit ones."""
    return np.frombuffer(data, "<f2").astype(np.float32)


class MersenneTwister64:
    """The published 64-bit generator of period 2^19937 - 1, for orders that must repeat with a fixed seed."""

    def __init__(self, seed: int):
        m = (1 << 64) - 1
        self.state = [seed & m]
        for i in range(1, 312):
            x = self.state[-1]
            self.state.append((6364136223846793005 * (x ^ (x >> 62)) + i) & m)
        self.at = 312

    def _twist(self) -> None:
        s = self.state
        for i in range(312):
            x = (s[i] & 0xFFFFFFFF80000000) | (s[(i + 1) % 312] & 0x7FFFFFFF)
            s[i] = s[(i + 156) % 312] ^ (x >> 1) ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        self.at = 0

    def __call__(self) -> int:
        if self.at == 312:
            self._twist()
        x = self.state[self.at]
        self.at += 1
        x ^= (x >> 29) & 0x5555555555555555
        x ^= (x << 17) & 0x71D67FFFEDA60000
        x ^= (x << 37) & 0xFFF7EEE000000000
        return x ^ (x >> 43)


def projection_vector(axes: int = 136, seed: int = 0x5EED5EED5EED5EED) -> list[float]:
    """Fixed direction for ordering profiles: uniform 32-bit floats in [-1, 1)."""
    draw = MersenneTwister64(seed)
    unit = [min(np.float32(draw()) / np.float32(2.0**64), np.nextafter(np.float32(1), np.float32(0))) for _ in range(axes)]
    return [float(np.float32(u * np.float32(2) + np.float32(-1))) for u in unit]


def fnv1a_32(text: bytes) -> int:
    h = 0x811C9DC5
    for b in text:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def canonical_order(k: int) -> np.ndarray:
    """Index of the canonical form of each k-mer code, canonical forms numbered by ascending first code."""
    all_codes = np.arange(4**k, dtype=U)
    rc, v = np.zeros(4**k, U), all_codes.copy()
    for _ in range(k):
        rc = (rc << U(2)) | (U(3) - (v & U(3)))
        v >>= U(2)
    _, index = np.unique(np.minimum(all_codes, rc), return_inverse=True)
    return index


_ORDER_4 = canonical_order(4)


def tnf(seq: bytes) -> np.ndarray | None:
    """136 canonical 4-mer shares, scaled to length 1."""
    counts = np.bincount(_ORDER_4[kmers(codes(seq), 4).astype(np.int64)], minlength=136).astype(float)
    size = np.sqrt((counts**2).sum())
    return counts / size if size else None


def rho(seq: bytes) -> np.ndarray | None:
    """16 dinucleotide odds P(xy) / (P(x) P(y)); 1 where the denominator vanishes."""
    c = codes(seq)
    single = np.bincount(c[c < 4], minlength=4).astype(float)
    double = np.bincount(kmers(c, 2).astype(np.int64), minlength=16).astype(float)
    if not single.sum() or not double.sum():
        return None
    p, pp = single / single.sum(), double / double.sum()
    den = np.outer(p, p).ravel()
    return np.where(den <= 1e-10, 1.0, pp / np.where(den <= 1e-10, 1.0, den))


_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
_CODON = np.full(125, ord("X"), np.uint8)
for _n, _aa in enumerate(CODE_11):
    _t = ["TCAG"[(_n >> s) & 3] for s in (4, 2, 0)]
    _CODON["ACGT".index(_t[0]) * 25 + "ACGT".index(_t[1]) * 5 + "ACGT".index(_t[2])] = ord(_aa)


def translate(seq: bytes) -> list[tuple[int, int, bytes]]:
    """(frame, start on that strand, residues) of all stretches between stops or foreign codons; frames 0-2 forward, 3-5 reverse."""
    out = []
    for strand, s in enumerate((seq, seq.translate(_COMPLEMENT)[::-1])):
        c = codes(s).astype(np.int64)
        for f in range(3):
            n = (len(c) - f) // 3
            if n <= 0:
                continue
            t = c[f : f + 3 * n].reshape(n, 3)
            aa = _CODON[t[:, 0] * 25 + t[:, 1] * 5 + t[:, 2]]
            stop = np.flatnonzero((aa == ord("*")) | (aa == ord("X")))
            begin = 0
            for e in [*stop.tolist(), n]:
                if e > begin:
                    out.append((3 * strand + f, f + 3 * begin, aa[begin:e].tobytes()))
                begin = e + 1
    return out


def _alphabet(groups) -> np.ndarray:
    table = np.full(256, 255, np.uint8)
    for i, g in enumerate(groups):
        for a in g:
            table[ord(a)] = i
    return table


ALPHABETS = {"aa20": (_alphabet(AMINO), 5, 8), "murphy10": (_alphabet(MURPHY_10), 4, 8), "dayhoff6": (_alphabet(DAYHOFF_6), 3, 12)}


def protein_kmers(residues: bytes, alphabet: str = "aa20") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the residue k-mers that are not of low complexity (no run of (k+1)/2 equal letters), and where they start."""
    table, bits, k = ALPHABETS[alphabet]
    c = table[np.frombuffer(residues, np.uint8)]
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(c, k)
    run, most = np.ones(n, int), np.ones(n, int)
    for i in range(1, k):
        run = np.where(w[:, i] == w[:, i - 1], run + 1, 1)
        most = np.maximum(most, run)
    packed = np.zeros(n, U)
    for i in range(k):
        packed |= w[:, i].astype(U) << U(bits * i)
    ok = (w.max(axis=1) < 255) & (most < (k + 1) // 2)
    return splitmix(packed[ok]), np.flatnonzero(ok)


def closed_syncmers(residues: bytes, s: int = 4) -> np.ndarray:
    """Dayhoff 12-mers whose first 4-mer is not greater than any other in it."""
    table, bits, k = ALPHABETS["dayhoff6"]
    h, at = protein_kmers(residues, "dayhoff6")
    if not len(at):
        return h
    c = table[np.frombuffer(residues, np.uint8)]
    small = np.zeros(len(c) - s + 1, U)
    for i in range(s):
        small |= c[i : len(c) - s + 1 + i].astype(U) << U(bits * i)
    small = splitmix(small)
    w = np.lib.stride_tricks.sliding_window_view(small, k - s + 1)[at]
    return h[w[:, 0] <= w.min(axis=1)]


def as_long(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def skew_closure(seq: bytes, least: int) -> float | None:
    """1 - |final| / greatest |running| of the cumulative G - C count."""
    if len(seq) < least:
        return None
    b = np.frombuffer(seq, np.uint8)
    run = np.cumsum((b == ord("G")).astype(np.int64) - (b == ord("C")).astype(np.int64))
    most = int(np.abs(run).max()) if len(run) else 0
    return None if most == 0 else 1.0 - abs(int(run[-1])) / most


def with_kernel(df: DataFrame, column: str, kernel: Callable[[bytes], object], name: str, sql_type: str, arrow_type: pa.DataType) -> DataFrame:
    """All columns and the kernel's value of one text column; null in, null out."""
    rest = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else kernel(t.encode()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, arrow_type)], [*rest, name])

    given = df.select(F.col(column).alias("_input"), *rest)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[1:])
    return given.mapInArrow(run, f"{schema}`{name}` {sql_type}")


def longs(df: DataFrame, column: str, kernel: Callable[[bytes], np.ndarray], name: str) -> DataFrame:
    """A kernel that gives an array of 64-bit hashes."""
    return with_kernel(df, column, lambda s: as_long(kernel(s)), name, "array<bigint>", pa.list_(pa.int64()))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct integers, in order; by sorting, which is many times faster than the hash table of np.unique on millions."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def distinct_kmers(texts: pa.Array, k: int, letters: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct canonical k-mers (k up to 12) of runs of rows, of at most `letters` letters or one row: first row, rows, and for each
    k-mer its row in the run and its code, in order of both. Nulls have none."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + letters, side="right")) - 1)
        c = _CODE[raw[offsets[first] : offsets[last]]].astype(np.uint32)
        row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1])).astype(U)
        n = max(0, len(c) - k + 1)
        forward, reverse, good = np.zeros(n, np.uint32), np.zeros(n, np.uint32), row[:n] == row[len(row) - n :]
        for i in range(k):
            part = c[i : i + n]
            good &= part < 4
            forward = (forward << np.uint32(2)) | (part & np.uint32(3))
            reverse |= (np.uint32(3) - (part & np.uint32(3))) << np.uint32(2 * i)
        key = distinct((row[:n][good] << U(2 * k)) | np.minimum(forward, reverse)[good])
        yield first, last - first, (key >> U(2 * k)).astype(np.int64), (key & U((1 << 2 * k) - 1)).astype(np.int64)
        first = last


def doubles(df: DataFrame, column: str, kernel: Callable[[bytes], np.ndarray | None], name: str) -> DataFrame:
    return with_kernel(df, column, lambda s: None if (v := kernel(s)) is None else v.tolist(), name, "array<double>", pa.list_(pa.float64()))


# Seeds of the published nucleotide hash, in the order A, C, G, T; the complement's seeds are these in reverse.
NT_SEEDS = np.array([0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456], np.uint64)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return x if by == 0 else (x << U(by)) | (x >> U(64 - by))


def nt_hashes(seq: bytes, k: int) -> np.ndarray:
    """Canonical nucleotide hashes of all k-mers without a foreign character: the xor of rotated seeds, the lesser of both strands."""
    c = codes(seq)
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    ok = np.lib.stride_tricks.sliding_window_view(c, k).max(axis=1) < 4
    own, other = NT_SEEDS[c & 3], NT_SEEDS[::-1][c & 3]
    forward, reverse = np.zeros(n, U), np.zeros(n, U)
    for i in range(k):
        forward ^= _rotated(own[i : i + n], k - 1 - i)
        reverse ^= _rotated(other[i : i + n], i)
    return np.minimum(forward, reverse)[ok]


def fracminhash(seq: bytes, k: int = 21, c: int = 125) -> np.ndarray:
    """Distinct hashes that c divides."""
    h = np.unique(nt_hashes(seq, k))
    return h[h % U(c) == 0]


def randstrobes(residues: bytes, s: int = 4, nearest: int = 5, farthest: int = 20) -> np.ndarray:
    """Order-2 strobes of residue s-mers: the second one minimises the xor with the first between both distances past it."""
    table, bits, _ = ALPHABETS["aa20"]
    c = table[np.frombuffer(residues, np.uint8)]
    n = len(c) - s + 1
    if n <= s + nearest:
        return np.zeros(0, U)
    small = np.zeros(n, U)
    for i in range(s):
        small |= c[i : i + n].astype(U) << U(bits * i)
    small = splitmix(small)
    firsts = n - s - nearest
    best = np.full(firsts, np.iinfo(np.uint64).max, U)
    chosen = np.zeros(firsts, U)
    for gap in range(s + nearest, s + farthest + 1):
        m = min(firsts, n - gap)
        if m <= 0:
            break
        link = small[:m] ^ small[gap : gap + m]
        better = link < best[:m]
        best[:m] = np.where(better, link, best[:m])
        chosen[:m] = np.where(better, small[gap : gap + m], chosen[:m])
    return splitmix(small[:firsts] ^ (chosen * U(0x9E3779B97F4A7C15)))
