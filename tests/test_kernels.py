"""Kernels against scalar twins and fixed expectations."""

import random

import numpy as np

from strandlake.functions import kernels as k
from strandlake.operators import models as ops

M = (1 << 64) - 1


def scalar_kmers(seq, size, canonical):
    out = []
    for i in range(len(seq) - size + 1):
        w = seq[i : i + size]
        if set(w) <= set("ACGT"):
            f = int("".join(str("ACGT".index(b)) for b in w), 4)
            r = int("".join(str(3 - "ACGT".index(b)) for b in w[::-1]), 4)
            out.append(min(f, r) if canonical else f)
    return out


def scalar_mix(a, b):
    p = a * b
    return (p & M) ^ (p >> 64)


def test_kmers_match_scalar():
    rng = random.Random(5)
    for _ in range(30):
        seq = "".join(rng.choice("ACGTN" if rng.random() < 0.5 else "ACGT") for _ in range(rng.randint(0, 60)))
        for size in (1, 4, 16, 21, 31):
            for canonical in (False, True):
                assert k.kmers(k.codes(seq.encode()), size, canonical).tolist() == scalar_kmers(seq, size, canonical)


def test_hashes():
    assert k.fnv1a_64(b"abc") & M == 16654208175385433931
    v = 12345678901234567890
    assert v * 0xFF51AFD7ED558CCD & M == 10008204666254426666
    a, b = 0xFEDCBA9876543210, 0x123456789ABCDEF1
    assert int(k.wymix(np.array([a], k.U), np.array([b], k.U))[0]) == scalar_mix(a, b)


def test_oph_sketch_matches_scalar():
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    sig, real = k.oph_sketch(seq.encode(), 16, 32, 42, False)
    expected = [65535] * 32
    for c in scalar_kmers(seq, 16, True):
        h = scalar_mix(c ^ ((42 + 0xA0761D6478BD642F) & M), c ^ 0xE7037ED1A0B428DB)
        i = h * 32 >> 64
        expected[i] = min(expected[i], (h >> 32) & 0xFFFF)
    assert sig.tolist() == expected
    filled, _ = k.oph_sketch(seq[:40].encode(), 16, 64, 42, True)
    assert (filled < 65535).sum() >= 60


def test_translate():
    assert k.translate(b"ATGAAATAAATGC")[0] == (0, 0, b"MK")
    frames = {f for f, _, _ in k.translate(b"ATGAAACCCGGG")}
    assert frames == {0, 1, 2, 3, 4, 5}
    assert k.translate(b"") == []


def test_protein_kmers_skip_low_complexity():
    assert len(k.protein_kmers(b"AAAAAAAAAAAA")[0]) == 0
    assert len(k.protein_kmers(b"ACDEFGHIKL")[0]) == 3
    assert len(k.protein_kmers(b"ACDXFGHIKL")[0]) == 0
    assert len(k.closed_syncmers(b"ACDEFGHIKLMNPQRSTVWY" * 4)) > 0


def test_tnf_and_skew():
    assert len(k.tnf(b"ACGT" * 50)) == 136
    assert abs(np.linalg.norm(k.tnf(b"ACGTTGCA" * 50)) - 1) < 1e-12
    assert k.tnf(b"AC") is None
    assert k.skew_closure(b"GGGGCCCC", 1) == 1.0
    assert k.skew_closure(b"GGGG", 1) == 0.0
    assert k.skew_closure(b"GGGG", 10) is None


def test_prevalence_strata(spark):
    members = [(1, g, h) for g, hs in ((10, (1, 2, 3, 4)), (11, (1, 2, 3)), (12, (1, 2))) for h in hs]
    df = spark.createDataFrame(members, "key int, genome_id int, hash long")
    got = {r.hash: (r.run, round(r.prevalence, 6)) for r in ops.prevalence(df, "key").collect()}
    assert got == {1: ("core", 1.0), 2: ("core", 1.0), 3: ("multi", 0.666667), 4: ("singleton", 0.333333)}
    core = ops.prevalence(df, "key").where("run = 'core'")
    q = spark.createDataFrame([(1, 20, 1), (1, 20, 2), (1, 20, 9), (1, 21, 1), (1, 21, 9)], "key int, genome_id int, hash long")
    assert {r.genome_id: r.coverage for r in ops.coverage(q, core, "key").collect()} == {20: 1.0, 21: 0.5}


def test_nt_hashes_match_scalar():
    rng = random.Random(7)
    seq = "".join(rng.choice("ACGTN" if i % 40 == 0 else "ACGT") for i in range(200))
    seeds = [int(x) for x in k.NT_SEEDS]
    rotate = lambda x, by: ((x << by % 64) | (x >> (64 - by % 64))) & M if by % 64 else x
    for size in (4, 21):
        expected = []
        for i in range(len(seq) - size + 1):
            w = seq[i : i + size]
            if "N" not in w:
                c = ["ACGT".index(b) for b in w]
                f = r = 0
                for j, b in enumerate(c):
                    f ^= rotate(seeds[b], size - 1 - j)
                    r ^= rotate(seeds[3 - b], j)
                expected.append(min(f, r))
        assert k.nt_hashes(seq.encode(), size).tolist() == expected
    back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert sorted(k.nt_hashes(seq.encode(), 21).tolist()) == sorted(k.nt_hashes(back.encode(), 21).tolist())
    assert all(h % 5 == 0 for h in k.fracminhash(seq.encode(), 21, 5).tolist())


def test_randstrobes_match_scalar():
    rng = random.Random(3)
    aa = "".join(rng.choice(k.AMINO) for _ in range(60))
    small = [int(k.splitmix(np.array([sum(k.AMINO.index(aa[i + j]) << (5 * j) for j in range(4))], k.U))[0]) for i in range(len(aa) - 3)]
    expected = []
    for i in range(len(small)):
        lo, hi = i + 9, min(i + 24, len(small) - 1)
        if lo <= hi:
            j = min(range(lo, hi + 1), key=lambda j: (small[i] ^ small[j], j))
            expected.append(int(k.splitmix(np.array([small[i] ^ (small[j] * 0x9E3779B97F4A7C15 & M)], k.U))[0]))
    assert k.randstrobes(aa.encode()).tolist() == expected
