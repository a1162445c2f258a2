"""Files, generations, quality store, streams: round trips and fixed expectations."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import taxonomy as fx
from strandlake.operators import groups, quality
from strandlake.operators.catalog import ExtractQuery, extract, sequence_slice
from strandlake.operators.dataset import Dataset
from strandlake.sources import readers, writers
from strandlake.streaming import log


def test_manifest_and_fasta(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("acc\tFASTA\tcompleteness\tsite\n#c\tx\t1\ty\nA1\ta.fa\t95.5\tsea\nA2\tb.fa\t\t\n")
    rows = readers.read_manifest(spark, str(tmp_path / "m.tsv")).collect()
    assert [(r.accession, r.file_path, r.completeness, r.extra["site"]) for r in rows] == [("A1", "a.fa", 95.5, "sea"), ("A2", "b.fa", None, None)]
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">c1 first\r\nACGT\r\nAC\n>c2\nGG\n\n")
    got = readers.read_fasta(spark, str(tmp_path / "a.fa.gz")).orderBy("contig_index").collect()
    assert [(r.name, r.header, r.seq) for r in got] == [("c1", "c1 first", "ACGTAC"), ("c2", "c2", "GG")]
    df = spark.createDataFrame([(0, "n", "A" * 130)], "o int, name string, seq string")
    writers.write_fasta(df, str(tmp_path / "out"), ordinal="o")
    back = readers.read_fasta(spark, str(tmp_path / "out") + "/*.txt").collect()
    assert [(r.name, len(r.seq)) for r in back] == [("n", 130)]


def test_quality_and_taxonomy_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("bin name\tpercent_completion\tpercent_redundancy\ng1\t97\t3\n")
    assert [tuple(r) for r in readers.read_quality(spark, str(tmp_path / "q.tsv")).collect()] == [("g1", 0.97, 0.03)]
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\tx\t|\t\t|\tsynonym\t|\n3\t|\tTwin\t|\t\t|\tscientific name\t|\n4\t|\tTwin\t|\t\t|\tscientific name\t|\n")
    nodes, names = readers.read_taxdump(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp"))
    assert nodes.count() == 2 and [tuple(r) for r in names.collect()] == [("Bacteria", 2)]
    (tmp_path / "rel.tsv").write_text("RS_GCF_1.1\td__B;s__x\nbad\tnone\n")
    assert [tuple(r) for r in readers.read_release(spark, str(tmp_path / "rel.tsv")).collect()] == [("GCF_1.1", "d__B;s__x")]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("d__B;p__P;g__;s__S x", "RS_GCF_000001.2", "g.fna.gz", "mt")], "t string, a string, n string, k string")
    r = df.select(fx.rank_token(F.col("t"), "g").alias("g"), fx.taxon_bucket(F.col("t")).alias("b"), fx.accession_stem(F.col("a")).alias("a"), fx.strip_extensions(F.col("n")).alias("n"), fx.genome_type(F.col("k")).alias("k"), fx.ten_ranks(F.col("t"), F.col("a")).alias("ten")).first()
    assert (r.g, r.b, r.a, r.n, r.k) == (None, "__unclassified__", "GCF_000001", "g", "mitochondrion")
    assert r.ten == "d__B;l__B;k__B;p__P;c__P;o__P;f__P;g__P;s__S x;S__S x"
    s = spark.createDataFrame([("ACGTACGT", 2, 3), ("ACGT", 4, 2), ("ACGT", 2, 9), ("ACGT", 1, 0)], "s string, a int, n int")
    assert [x[0] for x in s.select(sequence_slice(F.col("s"), F.col("a"), F.col("n"))).collect()] == ["GTA", "", "GT", ""]


def test_generations(spark, tmp_path):
    cat = lambda rows: spark.createDataFrame(rows, "genome_id long, accession string, completeness double")
    d = Dataset.create(spark, str(tmp_path / "a"), {"catalog": cat([(1, "A", 95.0), (2, "B", 50.0)])})
    d.append({"catalog": cat([(2, "B", 99.0), (3, "C", 10.0)])})
    d.remove(spark.createDataFrame([(3,)], "genome_id long"))
    assert d.generation() == 3
    assert {r.genome_id: r.completeness for r in d.rows("catalog").collect()} == {1: 95.0, 2: 99.0, 3: 10.0}
    assert {r.genome_id for r in d.live("catalog").collect()} == {1, 2}
    sub = d.subset(str(tmp_path / "b"), spark.createDataFrame([(1,), (3,)], "genome_id long"), ["catalog"])
    assert [r.genome_id for r in sub.live("catalog").collect()] == [1]
    v = d.verify("catalog", ["catalog"]).first()
    assert (v.expected, v.present, v.manifest_rows) == (3, 3, 4)
    with pytest.raises(ValueError):
        d.replace_column("catalog", cat([(1, "A", None)]), "completeness")
    kept = extract(d.live("catalog"), ExtractQuery(min_completeness=95.0))
    assert {r.genome_id for r in kept.select("genome_id").collect()} == {1, 2}


def test_quality_store(spark):
    a, b = quality.column_id(axis="completeness", tool="x", method="m"), quality.column_id(axis="completeness", tool="y", method="m")
    assert a != b and a == quality.column_id(tool="x", axis="completeness", method="m", label="ignored")
    cells = spark.createDataFrame([(10, a, 0.9)], "genome_id long, column_id long, value double")
    cells = quality.ingest(cells, spark.createDataFrame([(10, 0.95), (20, 0.5)], "genome_id long, value double"), b)
    g = spark.createDataFrame([(10,), (20,), (30,)], "genome_id long")
    got = {r.genome_id: (r.completeness, r.completeness_source) for r in quality.report(g, cells, {"completeness": [a, b]}).collect()}
    assert got == {10: (0.9, a), 20: (0.5, b), 30: (None, None)}
    assert quality.parse_selector("c=x:m@k/y:n") == ("c", [{"tool": "x", "method": "m", "calibration": "k"}, {"tool": "y", "method": "n", "calibration": ""}])
    with pytest.raises(ValueError):
        quality.parse_selector("nothing")
    assert quality.policy_hash({"a": [1], "b": [2]}) == quality.policy_hash({"b": [2], "a": [1]})


def test_derep(spark):
    acc = lambda xs: spark.createDataFrame([(x,) for x in xs], "accession string")
    members = spark.createDataFrame([("r", "r"), ("m", "r"), ("u", None), ("t", "r")], "accession string, rep string")
    got = {r.accession: (r.status, r.rep) for r in quality.derep_status(acc("rmutx"), members, acc("t")).collect()}
    assert got == {"r": ("representative", None), "m": ("member", "r"), "u": ("unclustered", None), "t": ("tombstoned", None), "x": ("absent", None)}
    v = {"parts": 1, "hash": 5, "n_live": 3, "uuid": "a", "generation": 1}
    assert quality.staleness(v, v) == "Fresh"
    assert quality.staleness(v, v | {"generation": 2}) == "LayoutChangedSameLiveSet"
    assert quality.staleness(v, v | {"hash": 6, "n_live": 4}) == "StaleNewGenomes"
    assert quality.staleness(v, v | {"hash": 6, "n_live": 2}) == "StaleTombstones"
    assert quality.staleness(v, v | {"parts": 2}) == "Mismatch"
    assert quality.accession_set_hash(acc("abc")) == quality.accession_set_hash(acc("cbaa"))


def test_decontaminate_settles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    g = spark.createDataFrame([(i, float(i)) for i in range(10)], "genome_id long, x double")
    score = lambda df: df.crossJoin(df.agg(F.avg("x").alias("m"))).withColumn("z", F.abs(F.col("x") - F.col("m")))
    left, rounds, settled = quality.decontaminate(g, score, lambda s: s.where("z <= 3"))
    assert left.count() == 6 and rounds == 2 and settled
    left, rounds, settled = quality.decontaminate(g, score, lambda s: s.where("z <= 3"), most_rounds=1)
    assert left.count() == 6 and rounds == 1 and not settled


def test_streamed_log(spark, tmp_path):
    schema = "genome_id long, op string, value double, generation long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: log.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    put([(1, "add", 1.0, 1), (1, "update", 2.0, 2), (2, "add", 3.0, 3)])
    run()
    put([(2, "remove", 0.0, 4)])
    run()  # goes on from the checkpoint
    assert [(r.genome_id, r.value) for r in log.current(spark, str(tmp_path / "state")).collect()] == [(1, 2.0)]


def test_group_numerics(spark):
    x = np.array([1.0, 2.0, 3.0, 4.0])
    kx, ky = groups.isotonic(x, np.array([1.0, 3.0, 2.0, 4.0]))
    assert np.interp(x, kx, ky).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert groups.mixture_minor(np.array([0.0] * 8 + [10.0] * 2) + np.arange(10) * 0.01, np.ones(10)) == pytest.approx(0.2)
    assert groups.greedy_clusters(np.array([[1, 0], [0.99, 0.01], [0, 1.0]])).tolist() == [0, 0, 2]
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 4))
    df = spark.createDataFrame([("a", r.tolist()) for r in v], "k string, x array<double>").repartition(5)
    m = groups.covariance_model(df, "k", "x", top=4).first()
    shrink = (4 + 2) / ((50 - 1) * (4 + 2) + 2)
    cov = np.cov(v.T, bias=True)
    assert np.allclose(m.eigenvalues, np.linalg.eigvalsh((1 - shrink) * cov + shrink * np.trace(cov) / 4 * np.eye(4))[::-1])
    votes = spark.createDataFrame([("g", 1, [5, 7]), ("g", 2, [5, 8]), ("g", 3, [6, 9])], "genus string, genome_id int, sig array<int>")
    assert [r.consensus for r in groups.majority_vote(votes, "genus", "genome_id", "sig", 2).orderBy("bin").collect()] == [5, 9]  # without a majority the last candidate stands
