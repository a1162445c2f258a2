"""First pass of the check, votes, models, orders, identities: against plain loops and published values."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import kernels as kx
from strandlake.functions import scoring as sc
from strandlake.functions.taxonomy import ranked_lineage
from strandlake.operators import catalog, check, dataset, groups, models, quality, taxonomy
from strandlake.queries import QUERIES
from strandlake.sources import readers, writers

SF = "/root/testdata/sf0.001"
p90 = lambda v: sorted(v)[-(-9 * len(v) // 10) - 1]
median = lambda v: sorted(v)[len(v) // 2]


def vote(rows):
    candidate, votes = [0] * len(rows[0]), [0] * len(rows[0])
    for r in rows:
        for b, x in enumerate(r):
            if votes[b] == 0:
                candidate[b], votes[b] = x, 1
            else:
                votes[b] += 1 if x == candidate[b] else -1
    return candidate


def test_running_vote(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i % 3}", int(i), rng.integers(0, 3, 8).tolist()) for i in rng.permutation(200)]
    got = defaultdict(dict)
    for r in groups.majority_vote(spark.createDataFrame(rows, "key string, o long, sig array<int>").repartition(5), "key", "o", "sig", 8).collect():
        got[r.key][r.bin] = (r.consensus, r.n)
    for k in ("k0", "k1", "k2"):
        members = [s for _, s in sorted((o, s) for key, o, s in rows if key == k)]
        assert [got[k][b] for b in range(8)] == [(x, len(members)) for x in vote(members)]


def test_nth_values(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x)) for k, n in (("a", 1), ("b", 2), ("c", 1000), ("d", 333)) for x in np.round(rng.normal(0, 50, n), 1)] + [("d", 0.0)] * 40 + [("c", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in models.group_statistics(df, "k", "x").collect()}
    by = defaultdict(list)
    for k, x in rows:
        if x is not None:
            by[k].append(x)
    assert set(got) == set(by)
    for k, v in by.items():
        s, n = sorted(v), len(v)
        assert (got[k].n, got[k].upper_median, got[k].p90_ceil, got[k].p90_floor, got[k].p20_floor) == (n, s[n // 2], s[int(np.ceil(n * 0.9)) - 1], s[min(int(n * 0.9), n - 1)], s[int(n * 0.2)])
        assert got[k].mad == median([abs(x - s[n // 2]) for x in v])
    table = {r.k: r.quantiles for r in models.quantile_table(df, "k", "x").collect()}
    assert all(table[k] == [sorted(v)[int(q / 127 * (len(v) - 1) + 0.5)] for q in range(128)] for k, v in by.items())


def test_similar_against_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in models.similar(df.where("id % 20 = 3"), df, 4).orderBy("query", "rank").collect():
        got[r.query].append(r.id)
    for q in range(3, 300, 20):
        s = np.round(unit[q] @ unit.T, 9)
        assert got[q] == sorted(range(300), key=lambda i: (-s[i], i))[:4]


def test_shrunk_model_and_excess(spark):
    rng = np.random.default_rng(4)
    x = rng.random((60, 6)) + 1
    x[50] += 400
    df = spark.createDataFrame([(i, "a" if i < 55 else "b" if i < 58 else "c", v.tolist()) for i, v in enumerate(x)], "id long, genus string, tnf array<double>").repartition(3)
    got = {r.id: r for r in groups.profile_excess(df, groups.shrunk_model(df, "genus", "tnf"), "genus", "tnf").collect()}
    for lo, hi in ((0, 55), (55, 58), (58, 60)):
        m = x[lo:hi]
        mean, cov, p, n = m.mean(axis=0), np.cov(m.T), 6, hi - lo
        t, t2 = np.trace(cov), np.trace(cov @ cov)
        alpha = min(1, max(0, ((1 - 2 / p) * t2 + t * t) / ((n + 1 - 2 / p) * (t2 - t * t / p))))
        inverse = np.linalg.inv((1 - alpha) * cov + alpha * t / p * np.eye(p))
        for i in range(lo, hi):
            d = np.sqrt((x[i] - mean) @ inverse @ (x[i] - mean))
            assert got[i].excess_build == pytest.approx(max(0, np.linalg.norm(x[i] - mean) / np.linalg.norm(mean) - 1))
            assert got[i].excess is None if n < 3 else got[i].excess == pytest.approx(max(0, (d - 11.63) / 11.63), abs=1e-9)


def test_two_gaussians():
    rng = np.random.default_rng(5)
    near, far = rng.normal(0, 1, (80, 2)), rng.normal(9, 1, (20, 2))
    share, gain, better = groups.two_gaussians(np.concatenate([near, far]), np.ones(100))
    assert better and gain > 0 and share == pytest.approx(0.2, abs=0.01)
    assert groups.two_gaussians(near, np.ones(80))[2] is False and groups.two_gaussians(near[:9], np.ones(9)) is None

    def scalar(points, weights):  # one step at a time, coordinate by coordinate
        n, axes, total = len(points), len(points[0]), sum(weights)
        moments = lambda w: [(m := sum(a * x[k] for a, x in zip(w, points, strict=True)), max(1e-8, sum(a * (x[k] - m) ** 2 for a, x in zip(w, points, strict=True)))) for k in range(axes)]
        log = lambda x, g: sum(-0.5 * (np.log(2 * np.pi * v) + (x[k] - m) ** 2 / v) for k, (m, v) in enumerate(g))
        one = moments([w / total for w in weights])
        l1 = sum(w * log(x, one) for w, x in zip(weights, points, strict=True))
        wide = max(range(axes), key=lambda k: one[k][1])
        move = lambda sign: [(m + (sign * 0.5 * v**0.5 if k == wide else 0), v) for k, (m, v) in enumerate(one)]
        a, b, pa, before = move(1), move(-1), 0.5, -1e30
        for _ in range(50):
            la, lb = [np.log(pa) + log(x, a) for x in points], [np.log(1 - pa) + log(x, b) for x in points]
            both = [np.logaddexp(u, v) for u, v in zip(la, lb, strict=True)]
            r = [np.exp(u - v) for u, v in zip(la, both, strict=True)]
            l2, wa = sum(w * v for w, v in zip(weights, both, strict=True)), sum(w * v for w, v in zip(weights, r, strict=True))
            if min(wa, total - wa) < 0.05 * total:
                before = l2
                break
            a, b, pa = moments([w * v / wa for w, v in zip(weights, r, strict=True)]), moments([w * (1 - v) / (total - wa) for w, v in zip(weights, r, strict=True)]), wa / total
            if l2 - before < 1e-4:
                before = l2
                break
            before = l2
        gain = (-2 * l1 + 2 * axes * np.log(n)) - (-2 * before + (4 * axes + 1) * np.log(n))
        return (min(pa, 1 - pa) if gain > 0 else 0.0), gain

    points, weights = rng.normal(0, 1, (40, 3)) + (rng.random((40, 1)) < 0.3) * 3, rng.random(40) + 0.5
    assert groups.two_gaussians(points, weights)[:2] == pytest.approx(scalar(points.tolist(), weights.tolist()))


def test_contig_split_numbers():
    sig = np.array([[1, 2, 3, 4]] * 8 + [[9, 9, 9, 9]])
    real = np.ones((9, 4), bool)
    assert groups.self_outlier(sig, real, np.ones(9)) == pytest.approx(1 / 9) and groups.self_outlier(sig[:2], real[:2], np.ones(2)) is None
    two = {"own": np.array([1, 2, 3, 4]), "other": np.array([9, 9, 0, 0])}
    assert groups.reference_minority(sig, real, np.arange(1.0, 10), two, "own") == pytest.approx(9 / 45)
    assert groups.reference_minority(sig, real, np.ones(9), {"own": two["own"]}, "own") is None


def test_pass_a_against_loops(spark):
    """Every genome of a test table: sketches, votes, containment, percentiles and scores by plain Python."""
    docs = sorted((r.doc_id, r.lang, r.source, "".join(c for c in r.text.upper() if c in "ACGT")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ks, bins = (8, 12, 16), 64
    sketch = {(i, k): kx.oph_sketch(s.encode(), k, bins, 42, True)[0].tolist() for i, _, _, s in docs for k in ks}
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / bins
    model = {}
    for level, name in (("genus", lambda d: d[1]), ("species", lambda d: f"{d[1]}_{d[2]}")):
        by = defaultdict(list)
        for d in docs:
            by[name(d)].append(d)
        for key, members in by.items():
            consensus = {k: vote([sketch[m[0], k] for m in members]) for k in ks}
            c = {k: [same(sketch[m[0], k], consensus[k]) for m in members] for k in ks}
            bar = 0.5 * max(c[8])
            whole = [x for x in c[8] if x >= bar]
            mad = 1.4826 * median([abs(x - median(whole)) for x in whole])
            model[level, key] = (consensus, p90(whole), median(whole), mad, len(members))
    lengths = defaultdict(list)
    for d in docs:
        lengths[d[1]].append(len(d[3]))
    got = {r.genome_id: r for r in QUERIES["check_pass_a"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, lang, source, seq in docs:
        own, r = model["species", f"{lang}_{source}"], got[i]
        level = "species" if own[4] >= 5 else "genus"
        consensus, top, mid, mad, n = own if level == "species" else model["genus", lang]
        assert r.tier == ("GenusSaturated" if len(lengths[lang]) >= 3 else "GenusSparse")
        if n < 5:
            assert r.level is None
            continue
        assert r.level == level
        c = [same(sketch[i, k], consensus[k]) for k in ks]
        expected = min(1.5, c[0] / top) if top > 0.01 else min(1.5, len(seq) / p90([x for x in lengths[lang] if x]))
        assert r.completeness == pytest.approx(expected)
        if min(c) < 0.01:
            assert r.leakage is None
        else:
            e = np.exp((8 * np.log(c[0]) + 12 * np.log(c[1])) / (64 + 144) * 16)
            assert r.leakage == pytest.approx(max(0, e - c[2]) / max(e, 0.01))
        spread = r.tier == "GenusSaturated" and n >= 10 and mad > 0
        assert r.accessory_z == (pytest.approx((c[0] - mid) / mad) if spread else None)


def test_sketch_slice(spark):
    seq = "".join(np.random.default_rng(6).choice(list("ACGT"), 400))
    df = spark.createDataFrame([(1, seq), (2, "ACGTACGTACGTACGTACGT"), (3, ""), (4, None)], "genome_id long, seq string")
    stored = check.sketches(df, (8, 12), 100)
    for m in (100, 64, 40, 1):
        for r in check.sketch_slice(stored, m).collect():
            sig, real = kx.oph_sketch({1: seq, 2: "ACGT" * 5}.get(r.genome_id, "").encode(), r.k, 100, 42, True)
            assert (list(r.sig), r.n_real) == (sig[:m].tolist(), int(real[:m].sum()))
            assert [(w >> i) & 1 for w in r.real for i in range(64)][:m] == real[:m].astype(int).tolist()
    assert check.sketch_slice(stored, 101).count() == 0
    assert {(r.genome_id, r.k) for r in check.sketch_scan(stored, df.where("genome_id = 2"), (12,)).collect()} == {(2, 12)}


def test_published_generators():
    draw = kx.MersenneTwister64(5489)
    assert [draw() for _ in range(10_000)][-1] == 9981545732273789042  # the standard's check value
    assert len(kx.projection_vector()) == 136 and all(-1 <= x < 1 for x in kx.projection_vector())
    assert kx.half_floats(np.array([1.5, -0.25, 65504], "<f2").tobytes()).tolist() == [1.5, -0.25, 65504.0]


def test_content_digest():
    import xxhash

    expected = xxhash.xxh3_64_intdigest(b"AC\nGT\n")
    assert kx.xxh3_content(["gt", "Ac"]) % (1 << 64) == expected and kx.xxh3_content([]) % (1 << 64) == xxhash.xxh3_64_intdigest(b"")


def test_hashes_of_rows():
    import pyarrow as pa

    words = ["", "a", "abc", None, "größe", "x" * 300]
    assert kx.fnv1a_64_rows(pa.array(words)).view(np.int64).tolist() == [kx.fnv1a_64((w or "").encode()) for w in words]
    assert kx.fnv1a_64_rows(pa.array(words).slice(2, 3)).view(np.int64).tolist() == [kx.fnv1a_64((w or "").encode()) for w in words[2:5]]


def test_concept_ids_meet(spark):
    df = spark.createDataFrame([("d",), ("b",), ("a",), ("c",), ("e",), ("a",)], "path string")
    meet = lambda x: x.withColumn("h", F.when(F.col("path") == "e", 6).otherwise(5).cast("long"))
    top = -(1 << 63)
    got = {r.path: r.concept_id - top for r in taxonomy.concept_ids(df, meet).collect()}
    assert len(set(got.values())) == 5 and got["a"] == 5 and got["e"] == 6 and set(got.values()) == {5, 6, 7, 8, 9}
    zero = lambda x: x.withColumn("h", F.lit(0).cast("long"))
    assert sorted(r.concept_id - top for r in taxonomy.concept_ids(df.limit(2), zero).collect())[0] == 1


def test_ranked_lineages(spark):
    def ten(*steps):
        df = spark.createDataFrame([([{"rank": a, "name": b} for a, b in steps], "ACC")], "l array<struct<rank string, name string>>, a string")
        return df.select(ranked_lineage(F.col("l"), F.col("a"))).first()[0]

    assert ten(("superkingdom", "Eukaryota"), ("clade", "Opisthokonta"), ("kingdom", "Fungi"), ("genus", "G"), ("species", "G s"), ("subspecies", "G s x")) == "d__Eukaryota;l__Opisthokonta;k__Fungi;p__Fungi;c__Fungi;o__Fungi;f__Fungi;g__G;s__G s;S__G s"
    assert ten(("superkingdom", "Viruses"), ("family", "F")) == "d__Viruses;l__Viruses;k__Viruses;p__Viruses;c__Viruses;o__Viruses;f__F;g__F;s__F unclassified;S__F unclassified"
    assert ten(("clade", "x")) == "d__;" + ";".join(f"{r}__ACC" for r in "lkpcofgsS")


def test_model_lookup_prefers_species(spark):
    members = spark.createDataFrame([(1, "g1", "s1"), (2, "g1", "s2"), (3, "g2", "s3")], "genome_id long, genus string, species string")
    row = lambda key, n: (key, 16, [n], float(n), 0.0, 0.0, n)
    model = lambda key, rows: spark.createDataFrame(rows, f"{key} string, k int, consensus array<int>, p90 double, median double, mad double, members int")
    got = check.model_for(members, model("species", [row("s1", 60), row("s2", 10), row("s3", 49)]), model("genus", [row("g1", 70), row("g2", 20)]), 50).collect()
    assert {(r.genome_id, r.level, r.members) for r in got} == {(1, "species", 60), (2, "genus", 70)}


def test_merged_indexes(spark):
    part = lambda rows: spark.createDataFrame(rows, "genome_id long, accession string")
    merged = catalog.merge_archives(part([(0, "a"), (1, "b"), (2, "b")]), part([(0, "b"), (1, "c"), (2, None)]))
    assert merged.count() == 6
    assert {tuple(r) for r in catalog.first_index(merged).collect()} == {("a", 0, 0), ("b", 0, 1), ("c", 1, 4)}
    sketch = lambda rows: spark.createDataFrame(rows, "part_index int, genome_id long, k int, m int, seed int")
    rows = [(0, 1, 16, 64, 42), (1, 2, 16, 64, 42), (1, 2, 21, 64, 42)]
    assert {r.k for r in catalog.common_sketches(sketch(rows)).collect()} == {16}
    with pytest.raises(ValueError, match="16"):
        catalog.common_sketches(sketch([*rows, (1, 3, 16, 32, 42)]))


def test_weakest_link(spark):
    info = spark.createDataFrame([(0, 0.9), (1, 0.2), (2, 0.8), (3, 0.7)], "col int, information double")
    starts = spark.createDataFrame([("x", [0, 2, 3]), ("y", [0, 1, 2]), ("z", [2, 3, 9])], "h string, cols array<int>")
    assert [r.h for r in check.weakest_link(starts, info, 3, 0.7).collect()] == ["x"]


def test_archive_guards(spark, tmp_path):
    base = spark.createDataFrame([(i, f"g{i % 2}", "ACGT" * i) for i in range(1, 6)], "genome_id long, genus string, seq string")
    lengths = lambda df: df.select("genome_id", F.length("seq").alias("len"))
    a = dataset.Dataset.create(spark, f"{tmp_path}/a", {"genomes": base, "lengths": lengths(base)}, {"k": 1})
    with pytest.raises(RuntimeError, match="claimed"):
        a._commit(1, {"genomes": (base, "data")}, {})
    a.remove(base.where("genome_id = 3"))
    doubled = {"lengths": lambda df: lengths(df).withColumn("len", F.col("len") * 2)}
    for i, params in enumerate(({"k": 1}, {"k": 2})):
        again = a.rebuild(f"{tmp_path}/b{i}", doubled, "genomes", params)
        assert {r.genome_id: r.len for r in again.live("lengths").collect()} == {g: 4 * g * (i + 1) for g in (1, 2, 4, 5)}
    visited = dataset.visit_shards(base.unionByName(spark.createDataFrame([(9, None, "A")], base.schema)), "genus", lambda key, parts: (p.assign(shard=key)[["shard", "genome_id"]] for p in parts), "shard string, genome_id long")
    assert Counter(tuple(r) for r in visited.collect()) == Counter([*(("g0" if i % 2 == 0 else "g1", i) for i in range(1, 6)), (None, 9)])
    headers = spark.createDataFrame([("a", "STARTED", 1), ("a", "COMPLETE", 2), ("b", "STARTED", 3)], "taxon string, stage string, at int")
    assert [r.taxon for r in dataset.completed(headers, spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "taxon string, x int")).collect()] == ["a"]


def test_files_out(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "root", "root"), (2, 1, "d", "X")], "taxid long, parent_taxid long, rank string, name string")
    accessions = spark.createDataFrame([("GCF_1.2", 2), ("B", 1)], "accession string, taxid long")
    writers.write_taxdump(nodes, f"{tmp_path}/dump", accessions, deleted=spark.createDataFrame([(9,)], "taxid long"))
    lines = lambda name: sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect())
    header = "accession\taccession.version\ttaxid\tgi"
    assert [x for x in lines("dump/acc2taxid.dmp") if x != header] == ["B\tB\t1\t0", "GCF_1.2\tGCF_1.2\t2\t0"] and header in lines("dump/acc2taxid.dmp")
    assert all(x.count("\t|") == 13 for x in lines("dump/nodes.dmp"))
    assert lines("dump/delnodes.dmp") == ["9\t|"] and lines("dump/merged.dmp") == []
    writers.write_columnar_taxonomy(nodes, accessions, f"{tmp_path}/col")
    rows = spark.read.parquet(f"{tmp_path}/col/acc2taxid").collect()
    assert {(r.accession, r.taxid, r.acc_hash) for r in rows} == {("GCF_1.2", 2, kx.fnv1a_64(b"GCF_1.2")), ("B", 1, kx.fnv1a_64(b"B"))}
    contigs = spark.createDataFrame([("A1", 1, "c2", "GG"), ("A1", 0, "c1", "ACGT"), ("A2", 0, "c1", "T" * 70)], "accession string, contig_index int, name string, seq string")
    writers.write_simulation(contigs, spark.createDataFrame([("A1", 0.9)], "synth_acc string, comp_actual double"), f"{tmp_path}/sim")
    got = readers.read_fasta(spark, f"{tmp_path}/sim/fasta/accession=A1").orderBy("contig_index").collect()
    assert [(r.name, r.seq) for r in got] == [("c1", "ACGT"), ("c2", "GG")]
    writers.write_panel(spark.createDataFrame([("m", 5), ("m", 3)], "marker string, hash long"), f"{tmp_path}/panel", "marker", {"k": 8})
    assert json.loads(lines("panel/params")[0]) == {"k": 8} and spark.read.parquet(f"{tmp_path}/panel/rows").count() == 2
    _, fit = groups.calibrate(spark.createDataFrame([(float(i), i / 20, i % 3) for i in range(20)], "x double, y double, f int"), "x", "y", ["f"])
    text = json.loads(writers.calibration_json({"completeness": fit}))["completeness"]
    assert text["n_samples"] == 20 and text["feature_names"] == ["f", "1"] and len(text["isotonic_x"]) == len(text["isotonic_y"])
    writers.write_repacked(contigs, f"{tmp_path}/re", "accession", "contig_index")
    assert spark.read.parquet(f"{tmp_path}/re").count() == 3
    for i in (10, 2, 1):
        contigs.limit(1).write.parquet(f"{tmp_path}/parts/part_{i}")
    parts = readers.read_parts(spark, [f"{tmp_path}/parts/part_{i}" for i in (10, 2, 1)])
    assert [r.part_path.rsplit("_", 1)[1] for r in parts.orderBy("part_index").collect()] == ["1", "2", "10"]
    (tmp_path / "patch.tsv").write_text("user_genome\tclassification\nA\td__X;s__a\nB\tN/A\n")
    assert [tuple(r) for r in readers.read_patch(spark, str(tmp_path / "patch.tsv")).collect()] == [("A", "d__X;s__a")]
    aligned = readers.marker_columns(spark.createDataFrame([("a", "AC-GT.AA")], "name string, seq string"), [("m1", 0, 3), ("m2", 3, 8), ("m3", 2, 3)])
    assert {(r.marker, r.seq) for r in aligned.collect()} == {("m1", "AC"), ("m2", "GTAA")}


def test_routing_rule_and_loop_rule(spark):
    rows = [(1, 0.03, 0.0, 0.9), (2, None, 0.1, None), (3, 0.0, 0.0, 0.6), (4, None, None, None)]
    df = spark.createDataFrame(rows, "i int, l double, t double, c double")
    flagged, full = sc.needs_scan(F.col("l"), F.col("t"), F.col("c"))
    assert {(r.i, r.f, r.g) for r in df.select("i", flagged.alias("f"), full.alias("g")).collect()} == {(1, True, True), (2, True, False), (3, True, True), (4, False, False)}
    scores = [(i, "g", 0.01 + i * 1e-4, None) for i in range(9)] + [(20, "g", 0.5, None), (21, "g", 0.0105, 0.02), (22, "g", None, None)]
    kept = quality.clean_members(spark.createDataFrame(scores, "genome_id long, genus string, leakage double, contig_outlier double"))
    assert {r.genome_id for r in kept.collect()} == {*range(9), 22}
