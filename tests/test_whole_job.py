"""Operators over all of their rows: no cut that is not the operator's own."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.kernels import fnv1a_32
from strandlake.operators import groups, models, taxonomy
from strandlake.queries import ORACLES, QUERIES

from .oracle import same


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_mixture_takes_all_contigs(spark, tmp_path):
    rng = random.Random(4)
    contig = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    lines = [contig(300, "AAAT") for _ in range(40)] + [contig(100, "GGGC") for _ in range(8)]  # the short ones are the minority
    d = documents(spark, tmp_path, [(1, "\n".join(lines), "en", "a", 0)])
    got = QUERIES["gmm_minor"](spark, d).first()
    assert got.n_contigs == 48 and got.minor == pytest.approx(800 / 12800)
    assert QUERIES["fiedler"](spark, d).first().n_contigs == 32


def test_mixture_minority_spans_two_contigs():
    x = np.array([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 10.0])
    assert groups.mixture_minor(x, np.ones(8)) == 0.0
    assert groups.mixture_minor(np.append(x, 10.01), np.ones(9)) == pytest.approx(2 / 9)


def test_single_copy_core_is_nine_tenths(spark):
    rows = [("f", g, 1, 1) for g in range(10)] + [("f", g, 2, 1 + (g == 3)) for g in range(9)] + [("f", 0, 3, 1)]
    rows += [("f", g, 4, 1 + (g < 2)) for g in range(10)] + [("few", g, 1, 1) for g in range(9)]
    copies = spark.createDataFrame(rows, "family string, genome_id int, hash long, copies int")
    core = models.single_copy(copies, "family").where("is_core")
    assert sorted((r.family, r.hash) for r in core.select("family", "hash").collect()) == [("f", 1)]  # floor(0.1 * 9) = 0 genomes may repeat hash 2
    twice = copies.withColumn("copies", F.when((F.col("hash") == 1) & (F.col("genome_id") == 5), 2).otherwise(F.col("copies")))
    core = models.single_copy(twice, "family").where("is_core")
    assert [tuple(r) for r in models.duplication_ceiling(twice, core, "family").where("family = 'f'").collect()] == [("f", 0.0, 0.0, 0.0)]
    half = twice.withColumn("copies", F.when(F.col("genome_id") >= 4, 2).otherwise(1))
    assert [tuple(r) for r in models.duplication_ceiling(half, core, "family").where("family = 'f'").collect()] == [("f", 1.0, 0.0, 1.0)]


def test_single_copy_ceiling_equals_sql(spark, tmp_path):
    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared, rare = piece(60), piece(40)
    rows = [(i, shared + piece(20) + (shared[:14] if i == 3 else "") + (rare if i < 3 else ""), "en", "a", 0) for i in range(12)]
    d = documents(spark, tmp_path, rows)
    same(spark, d, QUERIES["single_copy_ceiling"], ORACLES["single_copy_ceiling"])
    got = QUERIES["single_copy_ceiling"](spark, d).first()
    assert 0 < got.n_single_copy <= 49 + 11 and got.ceiling is not None  # the rare piece, in a quarter of the genomes, is not core
    assert QUERIES["single_copy_core"](spark, d).first().n_single_copy == got.n_single_copy


def test_coverage_of_the_prevalence_core(spark, tmp_path):
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared, extra = piece(60), piece(60)
    rows = [(i, shared + (extra if i < 2 else ""), "en", "a", 0) for i in range(12)] + [(20 + i, piece(40), "en", "b", 0) for i in range(2)]
    d = documents(spark, tmp_path, rows)
    same(spark, d, QUERIES["core_coverage"], ORACLES["core_coverage"])
    got = {r.genome_id: r for r in QUERIES["core_coverage"](spark, d).collect()}
    assert all(got[i].core_size == 49 and got[i].coverage == 1.0 for i in range(12))  # what two members share is no part of the core
    assert got[20].core_size == 0 and got[20].coverage is None


def test_calibrate_fits_all_rows(spark):
    # 150 000 copies of one row and 50 000 others of the same x: one hash, all in or all out of a sample of 100 000
    n = 200_000
    df = spark.range(n).select(F.lit(1.0).alias("x"), F.when(F.col("id") < 150_000, 1.0).otherwise(0.0).alias("y"), F.lit(0.0).alias("f"))
    out, report = groups.calibrate(df, "x", "y", ["f"])
    assert report["n"] == n and report["rmse"] == pytest.approx(np.sqrt(0.75 * 0.25))
    assert out.agg(F.min("estimate"), F.max("estimate")).first() == pytest.approx((0.75, 0.75), abs=1e-6)


def test_calibrate_equals_one_pass(spark):
    rng = np.random.default_rng(3)
    x, f = rng.integers(0, 400, 3000).astype(float), rng.normal(size=3000)
    y = np.clip(x / 400 + 0.05 * f + 0.2 * rng.normal(size=3000), 0, 1)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), f.tolist())], "x double, y double, f double").repartition(7)
    base = np.interp(x, *groups.isotonic(x, y))
    values = sorted({*x})
    means = np.array([y[x == v].mean() for v in values])
    sizes = np.array([(x == v).sum() for v in values])
    tail = lambda i, j: (means[i : j + 1] * sizes[i : j + 1]).sum() / sizes[i : j + 1].sum()
    at = 200  # max-min formula of the isotonic fit at one value
    expected = max(min(tail(i, j) for j in range(at, len(values))) for i in range(at + 1))
    assert base[x == values[at]] == pytest.approx(expected)
    a = np.column_stack([f, np.ones(len(f))])
    w = np.linalg.solve(a.T @ a + 1e-4 * np.eye(2), a.T @ (y - base))
    _, report = groups.calibrate(df, "x", "y", ["f"])
    assert report["weights"] == pytest.approx(w.tolist())
    assert report["rmse"] == pytest.approx(np.sqrt(np.mean((np.clip(base + a @ w, 0, 1) - y) ** 2)))


def test_synthetic_ranks(spark):
    rows = [("a1", "d__B;g__X;s__X y"), ("a2", "d__B;g__X"), ("a3", "d__B;g__X;s__"), ("a4", None), ("a5", "x__;junk;g__G;d__B"), ("é6", "d__B;g__X")]
    entries = spark.createDataFrame(rows, "accession string, lineage string")
    groups = spark.createDataFrame([("a3", "a3"), ("é6", "é6")], "accession string, representative string")
    filled = taxonomy.filled_lineages(entries, groups)
    leaf = {r.accession: r.nodes[-1].path for r in filled.collect()}
    assert leaf["a1"] == "d__B;g__X;s__X y" and leaf["a2"] == "d__B;g__X;s__[X sp. a2]" and leaf["a4"] == ";s__[ sp. a4]"
    assert leaf["a3"] == f"d__B;g__X;s__[X sp. group{fnv1a_32(b'a3'):08x}]" and leaf["é6"].endswith(f"group{fnv1a_32('é6'.encode()):08x}]")
    nodes = {r.path: r for r in taxonomy.filled_tree(filled).collect()}
    odd = nodes["g__G;d__B;p__[unclassified B]"]
    assert odd.parent_path == "g__G;d__B" and odd.synthetic and "g__G;d__B;k__[unclassified B]" not in nodes
    assert nodes[";p__[unclassified ]"].parent_path == "root" and nodes["root"].parent_path == "root"
    assert nodes["d__B;g__X;s__[X sp. a2]"].per_accession and not nodes["d__B;g__X"].synthetic
    whole = taxonomy.filled_tree(taxonomy.filled_lineages(entries.union(spark.createDataFrame([("a7", "d__B;k__")], entries.schema))))
    chain = {r.path: r.parent_path for r in whole.collect()}
    assert chain["d__B;k__[unclassified B]"] == "d__B;l__[unclassified B]" and chain["d__B;l__[unclassified B]"] == "d__B"
    clash = spark.createDataFrame([("b1", "d__B"), ("b2", "d__B;p__[unclassified B]")], entries.schema)
    assert taxonomy.filled_tree(taxonomy.filled_lineages(clash)).groupBy("path").count().where("count > 1").count() == 0
    assert taxonomy.filled_tree(taxonomy.filled_lineages(entries.limit(0))).count() == 1


def test_redundancy_calibration(spark):
    pool = spark.createDataFrame([("m1", 1), ("m1", 2), ("m1", 9), ("m2", 3), ("m2", 9)], "marker string, hash long")
    members = spark.createDataFrame([(1, 1), (1, 3), (1, 9), (2, 1), (2, 2), (3, 9)], "genome_id long, hash long")
    assert {r.genome_id: r.redundancy for r in models.marker_redundancy(members, pool, "marker").collect()} == {1: 0.75, 2: 1.0}

    rng = random.Random(8)
    rows = [("big", "f", rng.random()) for _ in range(25)] + [("few", "f", rng.random()) for _ in range(4)] + [("lone", None, 0.5), ("flat", "h", 0.0), ("few", "f", None), (None, "f", 0.9)]
    got = {r.genus: r for r in models.redundancy_calibration(spark.createDataFrame(rows, "genus string, family string, x double"), "genus", "family", "x").collect()}

    def spread(names):
        v = sorted(x for g, _, x in rows if g in names and x is not None)
        m = v[len(v) // 2]
        return m, max(sorted(abs(x - m) for x in v)[len(v) // 2], 0.01 * m, 1e-4)

    assert set(got) == {"big", "few", "lone", "flat"}
    for genus, names, n, borrowed in (("big", {"big"}, 25, False), ("few", {"big", "few"}, 4, True), ("lone", {"lone"}, 1, False), ("flat", {"flat"}, 1, True)):
        r = got[genus]
        assert (r.n, r.borrowed) == (n, borrowed) and (r.median, r.mad) == pytest.approx(spread(names))


def test_balanced_model(spark):
    rng = np.random.default_rng(3)
    rows, d, least, top = [], 6, 4, 2
    for k, n in (("a", 7), ("few", 3)):
        rows += [(k, g, rng.random(d).tolist(), (1 + rng.random(16) / 9).tolist(), int(rng.integers(50, 900))) for g in range(n) for _ in range(1 + 5 * g)]
    schema = "k string, g long, x array<double>, r array<double>, bp long"
    df = spark.createDataFrame([*rows, ("a", 1, None, [1.0] * 16, 9), (None, 1, [0.0] * d, [1.0] * 16, 9)], schema)
    got = {r.k: r for r in groups.balanced_model(df, "k", "g", "x", "r", "bp", top=top, least=least, points=5).collect()}
    assert set(got) == {"a", "few"} and not got["few"].valid and got["few"].mean is None and got["few"].t2_quantiles is None
    mine = [r for r in rows if r[0] == "a"]
    genomes = sorted({r[1] for r in mine})
    of = {g: np.array([r[2] for r in mine if r[1] == g]) for g in genomes}
    mean = np.mean([x.mean(axis=0) for x in of.values()], axis=0)
    cov = np.mean([np.mean([np.outer(y - mean, y - mean) for y in x], axis=0) for x in of.values()], axis=0)

    def shrunk(c, n):
        p = len(c)
        alpha = (p + 2) / ((n - 1) * (p + 2) + 2)
        return (1 - alpha) * c + alpha * np.trace(c) / p * np.eye(p)

    w, v = np.linalg.eigh(shrunk(cov, len(genomes)))
    w, v = w[::-1], v[:, ::-1]
    r = got["a"]
    assert (r.n_genomes, r.n_contigs, r.valid) == (7, len(mine), True)
    assert r.mean == pytest.approx(mean) and r.eigenvalues == pytest.approx(w[:top]) and r.residual == pytest.approx(w[top:].mean())
    odds = np.array([np.average([x[3] for x in mine if x[1] == g], axis=0, weights=[x[4] for x in mine if x[1] == g]) for g in genomes])
    precision = np.linalg.inv(shrunk(np.cov(odds.T, bias=True), len(genomes)))
    assert r.rho_mean == pytest.approx(odds.mean(axis=0)) and r.rho_precision == pytest.approx(precision.ravel(), rel=1e-6)
    off = np.array([x[2] for x in mine]) - mean
    y, z = off @ v[:, :top], np.array([x[3] for x in mine]) - odds.mean(axis=0)
    expected = {"t2": np.sqrt((y**2 / w[:top]).sum(axis=1)), "spe": (off**2).sum(axis=1) - (y**2).sum(axis=1), "rho": np.sqrt(((z @ precision) * z).sum(axis=1))}
    for name, x in expected.items():
        x = np.sort(x)
        assert r[f"{name}_quantiles"] == pytest.approx([x[int(q / 4 * (len(x) - 1) + 0.5)] for q in range(5)], rel=1e-6)


def test_closure_has_no_row_limit(spark):
    rng = random.Random(3)
    rows = [("r", None), ("lost", "nowhere"), ("twice", "r"), ("twice", "r"), ("two", "r"), ("two", "lost"), ("under", "two"), ("under2", "twice"), ("a", "b"), ("b", "a")]
    rows += [(f"n{i}", f"n{rng.randrange(i)}" if i else "r") for i in range(60)]
    level, want, depth = [(n, n, 0) for n, _ in rows], [], 9
    for step in range(depth + 1):
        want += level
        level = [(n, p, step + 1) for n, a, _ in level for m, p in rows if a == m and p is not None]
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, 50)  # as 1 000 000 for a tree of some hundred thousand nodes
    try:
        got = taxonomy.closure(spark.createDataFrame(rows, "node string, parent string"), depth)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert sorted(tuple(r) for r in taxonomy.closure(spark.createDataFrame([("r", None)], "node string, parent string")).collect()) == [("r", "r", 0)]
    finally:
        spark.conf.unset(limit)


def test_common_ancestors_have_no_row_limit(spark, tmp_path):
    at = lambda df, name: df.write.parquet(f"{tmp_path}/{name}.parquet")
    at(spark.range(5).selectExpr("cast(id as int) r_regionkey"), "region")
    at(spark.range(25).selectExpr("cast(id as int) n_nationkey", "cast(id % 5 as int) n_regionkey"), "nation")
    at(spark.range(300).selectExpr("id c_custkey", "cast(id * 7 % 25 as int) c_nationkey"), "customer")
    at(spark.range(900).selectExpr("id o_orderkey", "id % 300 o_custkey"), "orders")
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, 500)
    try:
        for name in ("tax_ancestor", "tax_lca"):
            same(spark, str(tmp_path), QUERIES[name], ORACLES[name])
    finally:
        spark.conf.unset(limit)


def test_climbs_to_few_ancestors_are_not_shuffled_by_them(spark):
    rng = random.Random(8)
    rows = [("r", None), ("q", None), ("twice", "r"), ("twice", "r"), ("lost", "nowhere")] + [(f"n{i}", f"n{rng.randrange(i)}" if i else "r") for i in range(80)] + [("under", "q")]
    parent = dict(rows)
    names = [*parent, "unknown"]
    pairs = [(a, rng.choice(names)) for a in names for _ in range(4)] + [("n5", "n5"), ("n7", "n7"), ("n7", "n7")]

    def climb(x):
        while x is not None and x in [*parent, "nowhere"]:
            yield x
            x = parent.get(x)

    want = sorted({(a, b, u) for a, b in pairs if a in parent and b in parent and (u := next((x for x in climb(a) if x in set(climb(b))), None))})
    key = "spark.sql.autoBroadcastJoinThreshold"
    for most in ("256k", "-1"):
        spark.conf.set(key, most)
        try:
            closed = taxonomy.closure(spark.createDataFrame(rows, "node string, parent string"))
            df = taxonomy.lowest_common(closed, spark.createDataFrame(pairs, "a string, b string"))
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert sorted(tuple(r) for r in df.collect()) == want
            assert bool(re.search(r"hashpartitioning\((b#\d+, u#|u#)", plan)) == (most == "-1")
        finally:
            spark.conf.unset(key)


def test_foreign_containment_of_many_keys(spark):
    rng = random.Random(12)
    piece = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pool = [piece(40) for _ in range(30)]
    rows = [(i, f"g{i % 150:03}", "".join(rng.choices(pool, k=3))) for i in range(320)]
    rows += [(1000, "long", "".join(pool) * 2 + "A" * 3000), (1001, "gone", "A" * 3000), (1002, None, pool[0]), (1003, "none", None), (1004, "short", "ACGT"), (1005, "alone", piece(30)), (1006, "ünder", piece(3000)), (1007, "zz", rows[0][2])]
    rows += [(1009, "copy", "".join(pool[5:9]))]
    mers = {}
    for i, _, s in rows:
        forward = {(s or "")[j : j + 5] for j in range(len(s or "") - 4)}
        mers[i] = {min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for m in forward}
    for k in (5, 12):
        if k == 12:
            mers = {i: {min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for m in {(s or "")[j : j + 12] for j in range(len(s or "") - 11)}} for i, _, s in rows}
        of, want = {}, []
        for i, g, _ in rows:
            if g is not None:
                of.setdefault(g, set()).update(mers[i])
        for i, g, _ in rows:
            if g is not None and (hits := [(-len(mers[i] & of[r]), r) for r in of if r != g and mers[i] & of[r]]):
                want.append((i, min(hits)[1], -min(hits)[0], len(mers[i])))
        got = models.foreign_containment(spark.createDataFrame(rows, "genome_id long, genus string, seq string").repartition(3), "genus", k)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_shared_counts_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    draw = lambda n, most: [np.unique(rng.integers(0, most, rng.integers(0, 60))).astype(np.uint32) for _ in range(n)]
    for most in (30, 4000):  # codes that many share, and few
        x, y = draw(150, most), draw(90, most)
        monkeypatch.setattr(models, "AT_ONCE", 1000)
        got = models.shared_counts(np.array([len(s) for s in x]), np.concatenate(x), np.array([len(s) for s in y]), np.concatenate(y))
        assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


def test_shared_kmers_across_blocks(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(40)]
    rows = [(i * 7 % 1201, "g" if i % 9 else "h", "".join(rng.choices(pool, k=2))) for i in range(1201)]
    rows += [(2000, None, pool[0]), (2001, "g", None), (2002, "h", "AC")]
    mers = {i: {min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for m in {(s or "")[j : j + 8] for j in range(len(s or "") - 7)}} for i, _, s in rows}
    of = {}
    for i, g, _ in rows:
        of.setdefault(g, []).append(i)
    want = {(a, b, n, len(mers[a]), len(mers[b])) for g in "gh" for a in of[g] for b in of[g] if a < b and (n := len(mers[a] & mers[b]))}
    got = [tuple(r) for r in models.shared_kmers(spark.createDataFrame(rows, "genome_id long, genus string, seq string").repartition(3), "genus", 8).collect()]
    assert len(got) == len(want) and set(got) == want
