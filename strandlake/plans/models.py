"""Sequence, model and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as kx
from ..functions import scoring as sc
from ..operators import models as ops
from ..sources import views as v
from .registry import query

K = 12
W = "WITH " + v.SQL
MERS = f", km AS (SELECT DISTINCT genome_id, genus, family, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS hash FROM (SELECT genome_id, genus, family, substr(seq, i, {K}) AS m FROM (SELECT genome_id, genus, family, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM g WHERE length(seq) >= {K})))"
PREV = MERS + ", nm AS (SELECT genus, count(DISTINCT genome_id) AS n_members FROM km GROUP BY genus), pc AS (SELECT genus, hash, count(*) AS n_present, any_value(n_members) AS n_members FROM km JOIN nm USING (genus) GROUP BY genus, hash), runs AS (SELECT *, CASE WHEN n_present >= ceil(0.9 * n_members) THEN 'core' WHEN n_present = 1 THEN 'singleton' ELSE 'multi' END AS run FROM pc)"


def kmer_sets(spark, d, k: int = K):
    """genome_id, genus, family, hash: distinct canonical k-mers."""
    g = v.genomes(spark, d).select("genome_id", "genus", "family", "seq")
    sets = kx.longs(g, "seq", lambda s: __import__("numpy").unique(kx.kmers(kx.codes(s), k, canonical=True)), "hashes")
    return sets.select("genome_id", "genus", "family", F.explode("hashes").alias("hash"))


@query(W + ", c AS (SELECT genome_id, unnest(range(1, length(seq) + 1)) AS i, seq FROM g), s AS (SELECT genome_id, i, sum(CASE substr(seq, i, 1) WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (PARTITION BY genome_id ORDER BY i) AS run FROM c) SELECT genome_id, CASE WHEN max(abs(run)) > 0 THEN round(1.0 - abs(arg_max(run, i))::DOUBLE / max(abs(run)), 6) END AS closure FROM s GROUP BY genome_id HAVING count(*) >= 100")
def gc_skew_closure(spark, d):
    """Genomes of 100 letters or more (the threshold is a parameter)."""
    import pyarrow as pa

    g = v.genomes(spark, d).where(F.length("seq") >= 100).select("genome_id", "seq")
    return kx.with_kernel(g, "seq", lambda s: kx.skew_closure(s, 100), "closure", "double", pa.float64()).select("genome_id", F.round("closure", 6).alias("closure"))


MUL = "((({x})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _murmur_sql(v: str) -> tuple[str, ...]:
    return (f"xor({v}, {v} >> 33)", MUL.format(x="a", c="18397679294719823053"), "xor(b, b >> 33)", MUL.format(x="c", c="14181476777654086739"), "xor(d, d >> 33)")


_M = _murmur_sql("code")


@query(W + f", p AS (SELECT genome_id, unnest(range(1, length(seq) - 19)) AS i, translate(seq, 'ACGT', '0123') AS q FROM g WHERE length(seq) >= 21), k AS (SELECT genome_id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, 21), lambda j: substr(q, i + j, 1)::UBIGINT)), lambda x, y: x * 4 + y) AS code FROM p), m1 AS (SELECT genome_id, {_M[0]} AS a FROM k), m2 AS (SELECT genome_id, {_M[1]} AS b FROM m1), m3 AS (SELECT genome_id, {_M[2]} AS c FROM m2), m4 AS (SELECT genome_id, {_M[3]} AS d FROM m3), m5 AS (SELECT genome_id, min({_M[4]}) AS h FROM m4 GROUP BY genome_id) SELECT genome_id, CASE WHEN h IS NULL THEN -1 WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS fingerprint FROM g LEFT JOIN m5 USING (genome_id)")
def oph_fingerprint(spark, d):
    """Least murmur-finalised forward 21-mer; all bits set for a genome without one."""
    import numpy as np
    import pyarrow as pa

    def least(s):
        h = kx.murmur(kx.kmers(kx.codes(s), 21))
        return int((h.min() if len(h) else np.uint64(2**64 - 1)).view(np.int64))

    return kx.with_kernel(v.genomes(spark, d).select("genome_id", "seq"), "seq", least, "fingerprint", "bigint", pa.int64()).select("genome_id", "fingerprint")


@query(W + ", f AS (SELECT genome_id, contig_index, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(contig_acc, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM contigs) SELECT genome_id, contig_index, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS hash FROM f")
def fnv_contig_hash(spark, d):
    c = v.contigs(spark, d).select("genome_id", "contig_index", "contig_acc")
    return kx.with_fnv1a_64(c, "contig_acc", "hash").select("genome_id", "contig_index", "hash")


@query(W + ", p AS (SELECT genome_id, unnest(range(1, length(seq) - 2)) AS i, seq FROM g WHERE length(seq) >= 4), m AS (SELECT genome_id, least(substr(seq, i, 4), reverse(translate(substr(seq, i, 4), 'ACGT', 'TGCA'))) AS mer FROM p), n AS (SELECT genome_id, mer, count(*) AS n FROM m GROUP BY genome_id, mer), t AS (SELECT genome_id, sqrt(sum(n * n)) AS size FROM n GROUP BY genome_id) SELECT genome_id, mer, round(n / size, 6) AS share FROM n JOIN t USING (genome_id)")
def tnf_profile(spark, d):
    names = sorted({min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for m in ("".join(x) for x in __import__("itertools").product("ACGT", repeat=4))})
    p = kx.doubles(v.genomes(spark, d).select("genome_id", "seq"), "seq", kx.tnf, "tnf").select("genome_id", F.posexplode("tnf").alias("i", "x")).where("x > 0")
    return p.select("genome_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("mer"), F.round("x", 6).alias("share"))


@query(W + ", p AS (SELECT genome_id, unnest(range(1, length(seq))) AS i, seq FROM g WHERE length(seq) >= 2), n AS (SELECT genome_id, substr(seq, i, 2) AS mer, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT genome_id, length(seq)::DOUBLE AS len, length(regexp_replace(seq, '[^A]', '', 'g')) AS a, length(regexp_replace(seq, '[^C]', '', 'g')) AS c, length(regexp_replace(seq, '[^G]', '', 'g')) AS g, length(regexp_replace(seq, '[^T]', '', 'g')) AS t FROM g) SELECT genome_id, mer, round((n / (len - 1)) / ((CASE mer[1] WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END / len) * (CASE mer[2] WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END / len)), 6) AS odds FROM n JOIN t USING (genome_id)")
def rho_profile(spark, d):
    names = [a + b for a in "ACGT" for b in "ACGT"]
    p = kx.doubles(v.genomes(spark, d).select("genome_id", "seq"), "seq", kx.rho, "rho")
    p = p.select("genome_id", F.posexplode("rho").alias("i", "x"))
    p = p.select("genome_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("mer"), F.round("x", 6).alias("odds"))
    return p.where("odds > 0").join(v.genomes(spark, d).select("genome_id", "seq"), "genome_id").where(F.expr("contains(seq, mer)")).select("genome_id", "mer", "odds")


@query(W + MERS + " SELECT genome_id, count(*) AS n_kmers, min(hash) AS least FROM km GROUP BY genome_id")
def kmer_canonical(spark, d):
    k = kmer_sets(spark, d).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_kmers"), F.min("hash").alias("h"))
    letters = F.expr(f"transform(sequence({K - 1}, 0, -1), i -> substr('ACGT', cast(shiftright(h, 2 * i) & 3 as int) + 1, 1))")
    return k.select("genome_id", "n_kmers", F.array_join(letters, "").alias("least"))


@query()
def oph_sketch(spark, d):
    """One-permutation sketches of two seeds, densified, 64 bins of 16-mers."""
    import pyarrow as pa

    g = v.genomes(spark, d).select("genome_id", "seq")
    for name, seed in (("sig1", 42), ("sig2", 43)):
        g = g.withColumn("_s", F.col("seq"))
        g = kx.with_kernel(g, "_s", lambda s, seed=seed: kx.oph_sketch(s, 16, 64, seed, True)[0].tolist(), name, "array<int>", pa.list_(pa.int32())).drop("_s")
    return g.drop("seq")


@query()
def translate_6frame(spark, d):
    """Open stretches of 8 residues or more in six frames."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("frame", pa.int32()), ("start", pa.int64()), ("residues", pa.string())]))
    rows = lambda s: [{"frame": f, "start": a, "residues": r.decode()} for f, a, r in kx.translate(s) if len(r) >= 8]
    g = kx.with_kernel(v.genomes(spark, d).select("genome_id", "seq"), "seq", rows, "orfs", "array<struct<frame:int,start:bigint,residues:string>>", kind)
    return g.select("genome_id", F.explode("orfs").alias("o")).select("genome_id", "o.*")


@query()
def aamer_set(spark, d):
    """Distinct protein 8-mer hashes of each genome, counted, and Dayhoff syncmers."""
    import numpy as np

    o = translate_6frame(spark, d).select("genome_id", "residues").withColumn("again", F.col("residues"))
    h = kx.longs(kx.longs(o, "residues", lambda r: np.unique(kx.protein_kmers(r)[0]), "aamers"), "again", lambda r: np.unique(kx.closed_syncmers(r)), "syncmers")
    return h.groupBy("genome_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("aamers")))).alias("n_aamers"), F.size(F.array_distinct(F.flatten(F.collect_list("syncmers")))).alias("n_syncmers"))


@query(W + PREV + " SELECT genus, any_value(n_members) AS n_members, count(*) FILTER (run = 'core') AS n_core, count(*) FILTER (run = 'multi') AS n_multi, count(*) FILTER (run = 'singleton') AS n_singleton FROM runs GROUP BY genus")
def prevalence_core(spark, d):
    p = ops.prevalence(kmer_sets(spark, d), "genus")
    return p.groupBy("genus").agg(F.max("n_members").alias("n_members"), *[F.count_if(F.col("run") == r).alias(f"n_{r}") for r in ("core", "multi", "singleton")])


@query(W + PREV + ", core AS (SELECT genus, hash FROM runs WHERE run = 'core'), cs AS (SELECT genus, count(*) AS core_size FROM core GROUP BY genus), h AS (SELECT genome_id, genus, count(*) AS hits FROM km JOIN core USING (genus, hash) GROUP BY genome_id, genus) SELECT k.genome_id, k.genus, coalesce(hits, 0) AS hits, coalesce(core_size, 0) AS core_size, CASE WHEN core_size > 0 THEN round(coalesce(hits, 0) / core_size, 6) END AS coverage FROM (SELECT DISTINCT genome_id, genus FROM km) k LEFT JOIN cs USING (genus) LEFT JOIN h USING (genome_id, genus)")
def core_coverage(spark, d, theta: float = 0.9):
    """Coverage of the genus's prevalence core (hashes in ceil(theta * n) of its n members or more); null where that core is empty."""
    m = kmer_sets(spark, d)
    model = ops.prevalence(m, "genus", theta).where("run = 'core'")
    return ops.coverage(m, model, "genus", "left").withColumn("coverage", F.round("coverage", 6))


@query(W + MERS + ", n AS (SELECT hash, count(DISTINCT genus) + count(DISTINCT family) AS k FROM km GROUP BY hash) SELECT least(k, 255)::BIGINT AS n_keys, count(*) AS n_hashes FROM n GROUP BY 1")
def global_multiplicity(spark, d):
    """How many entries, of genera and of families, hold each hash."""
    return ops.multiplicity(kmer_sets(spark, d), "genus", "family").groupBy("n_keys").agg(F.count(F.lit(1)).alias("n_hashes"))


@query(W + MERS + ", n AS (SELECT hash, count(DISTINCT genus) AS k FROM km GROUP BY hash), t AS (SELECT least(floor(log2(k)), 15)::INT AS tier FROM n) SELECT tier, count(*) AS n_hashes, round(1 - tier / log2((SELECT count(DISTINCT genus) FROM km)), 6) AS weight FROM t GROUP BY tier")
def idf_tier(spark, d):
    m = kmer_sets(spark, d)
    total = m.agg(F.countDistinct("genus").alias("g"))  # one row
    t = ops.idf_tiers(m, "genus").groupBy("tier").agg(F.count(F.lit(1)).alias("n_hashes"))
    return t.crossJoin(F.broadcast(total)).select("tier", "n_hashes", F.round(1 - F.col("tier") / F.log2("g"), 6).alias("weight"))


PANEL = MERS + ", dg AS (SELECT hash, min(family) AS family FROM km GROUP BY hash HAVING count(DISTINCT family) = 1)"


@query(W + PANEL + " SELECT family, count(*) AS n_diagnostic FROM dg GROUP BY family")
def diagnostic_panel(spark, d):
    return ops.diagnostic(kmer_sets(spark, d), "family").groupBy("family").agg(F.count(F.lit(1)).alias("n_diagnostic"))


@query(W + PANEL + ", vt AS (SELECT genome_id, dg.family, count(*) AS votes FROM km JOIN dg USING (hash) GROUP BY 1, 2) SELECT genome_id, arg_min(family, (-votes, family)) AS clade, max(votes) AS majority, sum(votes)::BIGINT AS total, round(1 - max(votes) / sum(votes), 6) AS minority_fraction FROM vt GROUP BY genome_id")
def clade_votes(spark, d):
    m = kmer_sets(spark, d)
    return ops.clade_votes(m, ops.diagnostic(m, "family"), "family").withColumn("minority_fraction", F.round("minority_fraction", 6))


@query(W + MERS + ", sz AS (SELECT genome_id, count(*) AS n FROM km GROUP BY genome_id), rf AS (SELECT DISTINCT genus AS ref, hash FROM km), hs AS (SELECT genome_id, ref, count(*) AS shared FROM km JOIN rf USING (hash) WHERE ref <> genus GROUP BY genome_id, ref) SELECT genome_id, arg_min(ref, (-shared, ref)) AS best, max(shared) AS shared, round(max(shared) / any_value(n), 6) AS containment FROM hs JOIN sz USING (genome_id) GROUP BY genome_id")
def containment_argmax(spark, d):
    """The foreign genus that contains most of a genome's k-mers."""
    best = ops.foreign_containment(v.genomes(spark, d).select("genome_id", "genus", "seq"), "genus", K)
    return best.select("genome_id", "best", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


@query(W + MERS + ", pr AS (SELECT a.genome_id AS a, b.genome_id AS b FROM g a JOIN g b ON a.genus = b.genus AND a.genome_id < b.genome_id), sz AS (SELECT genome_id, count(*) AS n FROM km GROUP BY genome_id), sh AS (SELECT x.genome_id AS a, y.genome_id AS b, count(*) AS sh_n FROM km x JOIN km y ON x.hash = y.hash AND x.genus = y.genus AND x.genome_id < y.genome_id GROUP BY 1, 2) SELECT a, b, sh_n AS shared, round(sh_n / (p.n + q.n - sh_n), 6) AS jaccard, round(100 * (sh_n / p.n) ** (1.0 / 12), 4) AS ani FROM sh JOIN sz p ON p.genome_id = a JOIN sz q ON q.genome_id = b")
def sketch_jaccard(spark, d):
    """Jaccard and ANI of genomes of one genus that share k-mers: blocks of a genus meet in tiles, no pairs without a shared one."""
    j, c = ops.shared_kmers(v.genomes(spark, d).select("genome_id", "genus", "seq"), "genus", K), F.col
    return j.select("a", "b", "shared", F.round(c("shared") / (c("na") + c("nb") - c("shared")), 6).alias("jaccard"), F.round(100 * F.pow(c("shared") / c("na"), F.lit(1.0 / K)), 4).alias("ani"))


MARKERS = ", mk AS (SELECT item_id, text FROM benchmark), mp AS (SELECT DISTINCT item_id, substr(s, i, 12) AS hash FROM (SELECT item_id, s, unnest(range(1, length(s) - 10)) AS i FROM (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM mk) WHERE length(s) >= 12)), uq AS (SELECT hash, min(item_id) AS item_id FROM mp GROUP BY hash HAVING count(DISTINCT item_id) = 1), gm AS (SELECT DISTINCT genome_id, substr(seq, i, 12) AS hash FROM (SELECT genome_id, seq, unnest(range(1, length(seq) - 10)) AS i FROM g WHERE length(seq) >= 12)), h AS (SELECT genome_id, item_id, count(*) AS hits FROM gm JOIN uq USING (hash) GROUP BY 1, 2)"


def marker_kmers(spark, d):
    """The 12-mers of benchmark passages (item_id, hash) and of genomes (genome_id, hash)."""
    import numpy as np

    kmers = lambda df: kx.longs(df, "seq", lambda s: np.unique(kx.kmers(kx.codes(s), K)), "h")
    m = kmers(v.load(spark, d, "benchmark").select("item_id", v.acgt(F.col("text")).alias("seq"))).select("item_id", F.explode("h").alias("hash"))
    return m, kmers(v.genomes(spark, d).select("genome_id", "seq")).select("genome_id", F.explode("h").alias("hash"))


@query(W + MARKERS + " SELECT genome_id, count(*) FILTER (hits >= 5) AS n_present, count(*) AS n_touched FROM h GROUP BY genome_id")
def marker_presence(spark, d):
    """Benchmark passages as markers: hashes of one marker only; present with five hits or more."""
    m, g = marker_kmers(spark, d)
    hits = g.join(ops.diagnostic(m, "item_id"), "hash").groupBy("genome_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.groupBy("genome_id").agg(F.count_if(F.col("hits") >= 5).alias("n_present"), F.count(F.lit(1)).alias("n_touched"))


REDUNDANCY = MARKERS + ", pz AS (SELECT item_id, count(*) AS n_pool FROM uq GROUP BY item_id), rv AS (SELECT genome_id, avg(hits / n_pool) AS x FROM h JOIN pz USING (item_id) GROUP BY genome_id), rg AS (SELECT genus, family, round(x, 9) AS x FROM rv JOIN g USING (genome_id))"
MIDDLE = "list_sort(list(x)) AS v, count(*) AS n"
SPREAD = "v[floor(n / 2)::INT + 1] AS m, list_sort(list_transform(v, lambda y: abs(y - v[floor(n / 2)::INT + 1])))[floor(n / 2)::INT + 1] AS mad"


@query(W + REDUNDANCY + f", gs AS (SELECT genus, family, n, {SPREAD} FROM (SELECT genus, min(family) AS family, {MIDDLE} FROM rg GROUP BY genus)), fs AS (SELECT family, {SPREAD} FROM (SELECT family, {MIDDLE} FROM rg GROUP BY family)), c AS (SELECT genus, n, n < 10 AS borrowed, CASE WHEN n < 10 THEN fs.m ELSE gs.m END AS m, CASE WHEN n < 10 THEN fs.mad ELSE gs.mad END AS d FROM gs JOIN fs USING (family)) SELECT genus, least(n, 32767) AS n, borrowed, round(m, 6) AS median, round(greatest(d, 0.01 * m, 0.0001), 6) AS mad FROM c")
def redundancy_calibration(spark, d):
    """How much of the markers' pools genomes of each genus have, with the family's figures for genera of fewer than ten."""
    m, g = marker_kmers(spark, d)
    values = ops.marker_redundancy(g, m, "item_id").select("genome_id", F.round("redundancy", 9).alias("x"))
    named = values.join(v.genomes(spark, d).select("genome_id", "genus", "family"), "genome_id")
    return ops.redundancy_calibration(named, "genus", "family", "x").select("genus", "n", "borrowed", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


ORDERED = "list_sort(list(genome_length)) AS v, count(*) AS n"


@query(W + f", a AS (SELECT genus, {ORDERED} FROM cat GROUP BY genus), b AS (SELECT genus, n, v, v[ceil(0.9 * n)::INT] AS p90_ceil, v[least(floor(0.9 * n), n - 1)::INT + 1] AS p90_floor, v[floor(n / 2)::INT + 1] AS upper_median, v[floor(0.2 * n)::INT + 1] AS p20_floor FROM a) SELECT genus, n, p90_ceil, p90_floor, upper_median, p20_floor, list_sort(list_transform(v, lambda x: abs(x - upper_median)))[floor(n / 2)::INT + 1] AS mad FROM b")
def genus_p90_median_mad(spark, d):
    return ops.group_statistics(v.catalog(spark, d), "genus", "genome_length")


@query("WITH a AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, v, n, v[floor(n / 2)::INT + 1] AS med FROM a WHERE n >= 3), c AS (SELECT l_suppkey, med, list_sort(list_transform(v, lambda x: abs(x - med)))[floor(n / 2)::INT + 1] AS mad FROM b) SELECT l_orderkey, l_linenumber, round((l_extendedprice - med) / (1.4826 * greatest(mad, 0.0001)), 6) AS z FROM lineitem JOIN c USING (l_suppkey)")
def robust_z(spark, d):
    return ops.robust_z(v.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


@query("SELECT l_orderkey AS genome_id, round(sum(CASE WHEN l_discount >= 0.08 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS outlier_bp, round(sum(CASE WHEN l_tax >= 0.06 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS foreign_bp, sum(l_quantity)::BIGINT AS scored_bp FROM lineitem GROUP BY 1")
def bp_weighted_outlier(spark, d):
    share = lambda cond: F.round(F.sum(F.when(cond, F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity"), 6)
    return v.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("genome_id")).agg(share(F.col("l_discount") >= 0.08).alias("outlier_bp"), share(F.col("l_tax") >= 0.06).alias("foreign_bp"), F.sum("l_quantity").cast("long").alias("scored_bp"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'abstain' WHEN l_discount >= 0.08 AND l_tax >= 0.06 THEN 'both' WHEN l_discount >= 0.08 THEN 'tnf' WHEN l_tax >= 0.06 THEN 'foreign' ELSE 'none' END AS channel, (l_returnflag <> 'R' AND (l_discount >= 0.08 OR l_tax >= 0.06)) AS suspicious FROM lineitem")
def qcontig_suspicious(spark, d):
    tnf, foreign, abstain = F.col("l_discount") >= 0.08, F.col("l_tax") >= 0.06, F.col("l_returnflag") == "R"
    channel = F.when(abstain, "abstain").when(tnf & foreign, "both").when(tnf, "tnf").when(foreign, "foreign").otherwise("none")
    return v.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", channel.alias("channel"), (~abstain & (tnf | foreign)).alias("suspicious"))


@query("WITH a AS (SELECT s_nationkey, list_sort(list(s_acctbal)) AS v FROM supplier GROUP BY 1), q AS (SELECT s_nationkey, list_transform(range(0, 128), lambda k: v[floor(k / 127.0 * (len(v) - 1) + 0.5)::INT + 1]) AS t FROM a) SELECT c_custkey, round(len(list_filter(t, lambda x: x <= c_acctbal)) / 128.0, 6) AS percentile FROM customer JOIN q ON s_nationkey = c_nationkey")
def quantile_percentile(spark, d):
    t = ops.quantile_table(v.load(spark, d, "supplier"), "s_nationkey", "s_acctbal")
    c = v.load(spark, d, "customer").join(t, F.col("c_nationkey") == F.col("s_nationkey"))
    return c.select("c_custkey", F.round(ops.percentile_of(F.col("c_acctbal"), F.col("quantiles")), 6).alias("percentile"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, 1 - l_discount AS c16, (1 - l_discount) * (1 - l_tax) AS c21, (1 - l_discount) * (1 - l_tax) * (1 - l_quantity / 100) AS c31 FROM lineitem), b AS (SELECT *, exp((16 * ln(c16) + 21 * ln(c21)) / (16 * 16 + 21 * 21) * 31) AS e FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN least(c16, c21, c31) >= 0.01 THEN round(greatest(e - c31, 0) / greatest(e, 0.01), 6) END AS leakage FROM b")
def leakage_excess(spark, d):
    c16 = 1 - F.col("l_discount")
    c21 = c16 * (1 - F.col("l_tax"))
    c31 = c21 * (1 - F.col("l_quantity") / 100)
    return v.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.leakage_excess([c16, c21, c31], [16, 21, 31]), 6).alias("leakage"))


AXES = """ax AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_discount END AS dup_mass, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS dup_excess,
  CASE WHEN l_quantity > 10 THEN l_tax * 2 END AS fmh_minority, CASE WHEN l_quantity > 20 THEN l_discount * 1.5 END AS rho_outlier, CASE WHEN l_quantity > 30 THEN l_tax * 1.5 END AS spe,
  CASE WHEN l_linestatus = 'O' THEN l_discount END AS contig_outlier_adj, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS tnf_minor,
  CASE WHEN l_linenumber = 1 THEN l_quantity / 50 END AS marker, CASE WHEN l_linenumber <= 3 THEN l_quantity / 45 END AS aamer_core, CASE WHEN l_returnflag = 'A' THEN l_quantity / 50 END AS post_decontam,
  CASE WHEN l_linestatus = 'F' THEN l_quantity / 60 END AS cluster_relative FROM lineitem)"""
CHANNELS = AXES + """, ch AS (SELECT *, least(greatest(CASE WHEN dup_mass IS NOT NULL THEN greatest(1.448954::DOUBLE * dup_mass + 0.009998::DOUBLE, 0) ELSE dup_excess * 0.125::DOUBLE END, 0), 1) AS d0,
  least(greatest(fmh_minority, 0), 1) AS s0, list_sort(list_filter([rho_outlier, spe, contig_outlier_adj, tnf_minor], lambda x: x IS NOT NULL)) AS ge FROM ax),
chn AS (SELECT *, CASE WHEN dup_mass IS NULL AND dup_excess IS NULL THEN NULL ELSE d0 END AS D, CASE WHEN fmh_minority IS NULL THEN NULL ELSE s0 END AS S,
  CASE WHEN len(ge) = 0 THEN NULL WHEN len(ge) % 2 = 1 THEN ge[len(ge) // 2 + 1] ELSE (ge[len(ge) // 2] + ge[len(ge) // 2 + 1]) / 2 END AS G,
  coalesce(rho_outlier >= 0.1, false)::INT + coalesce(spe >= 0.1, false)::INT + coalesce(contig_outlier_adj >= 0.05, false)::INT + coalesce(tnf_minor >= 0.1, false)::INT AS ov FROM ch)"""


def axes(spark, d):
    c, w = F.col, F.when
    return v.load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        w(c("l_linenumber") % 3 == 0, c("l_discount")).alias("dup_mass"), w(c("l_linenumber") % 2 == 0, c("l_tax")).alias("dup_excess"),
        w(c("l_quantity") > 10, c("l_tax") * 2).alias("fmh_minority"), w(c("l_quantity") > 20, c("l_discount") * 1.5).alias("rho_outlier"), w(c("l_quantity") > 30, c("l_tax") * 1.5).alias("spe"),
        w(c("l_linestatus") == "O", c("l_discount")).alias("contig_outlier_adj"), w(c("l_returnflag") != "N", c("l_tax")).alias("tnf_minor"),
        w(c("l_linenumber") == 1, c("l_quantity") / 50).alias("marker"), w(c("l_linenumber") <= 3, c("l_quantity") / 45).alias("aamer_core"), w(c("l_returnflag") == "A", c("l_quantity") / 50).alias("post_decontam"),
        w(c("l_linestatus") == "F", c("l_quantity") / 60).alias("cluster_relative"),
    )


@query("WITH " + CHANNELS + " SELECT l_orderkey, l_linenumber, round(D, 6) AS d, round(S, 6) AS s, round(G, 6) AS g, CASE WHEN coalesce(D, S, G) IS NOT NULL THEN round(1 - coalesce(1 - D, 1) * coalesce(1 - S, 1) * coalesce(1 - G, 1), 6) END AS display, coalesce(D >= 0.05, false)::INT + coalesce(S >= 0.1, false)::INT + (ov >= 2)::INT AS fired FROM chn")
def contam_channels(spark, d):
    ch = sc.channels()
    return axes(spark, d).select("l_orderkey", "l_linenumber", *[F.round(ch[k], 6).alias(k.lower()) for k in ("D", "S", "G", "display")], ch["fired"].alias("fired"))


CE = ", cei AS (SELECT *, coalesce(marker, aamer_core, post_decontam) AS intr FROM chn), cev AS (SELECT *, CASE WHEN intr IS NULL THEN cluster_relative WHEN intr < 0.5 AND cluster_relative < intr AND intr - cluster_relative > 0.3 THEN sqrt(intr * cluster_relative) ELSE intr END AS ce FROM cei)"


@query("WITH " + CHANNELS + CE + " SELECT l_orderkey, l_linenumber, round(ce, 6) AS completeness, CASE WHEN ce IS NULL OR ce < 0.5 THEN 'LQ' WHEN ce < 0.9 THEN 'MQ' WHEN (post_decontam IS NULL AND cluster_relative IS NULL AND aamer_core IS NOT NULL) OR coalesce(D >= 0.05, false) THEN 'MQ' ELSE 'HQ' END AS tier, CASE WHEN ce >= 0.9 AND S < 0.05 THEN 'HQ' WHEN ce >= 0.5 AND S < 0.10 THEN 'MQ' ELSE 'LQ' END AS assembly_tier FROM cev")
def quality_tier(spark, d):
    ce, ch = sc.completeness_effective(), sc.channels()
    return axes(spark, d).select("l_orderkey", "l_linenumber", F.round(ce, 6).alias("completeness"), sc.quality_tier(ce, ch["D"]).alias("tier"), sc.assembly_tier(ce, ch["S"]).alias("assembly_tier"))


@query("SELECT user_id AS genome_id, round(arg_max(value, event_id) FILTER (event_type = 'view'), 6) AS view, round(arg_max(value, event_id) FILTER (event_type = 'click'), 6) AS click, round(coalesce(arg_max(value, event_id) FILTER (event_type = 'purchase'), arg_max(value, event_id) FILTER (event_type = 'signup')), 6) AS purchase_or_signup FROM events GROUP BY user_id")
def quality_pivot_report(spark, d):
    """Long quality cells to a wide report; the third axis falls back to another column."""
    e = v.load(spark, d, "events").select(F.col("user_id").alias("genome_id"), "event_type", F.struct("event_id", "value").alias("cell"))
    p = e.groupBy("genome_id").pivot("event_type", ["view", "click", "purchase", "signup"]).agg(F.max("cell"))
    return p.select("genome_id", F.round("view.value", 6).alias("view"), F.round("click.value", 6).alias("click"), F.round(F.coalesce("purchase.value", "signup.value"), 6).alias("purchase_or_signup"))


@query("WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'DOC_' || doc_id WHEN 1 THEN 'DOC_' || doc_id || '.fa.gz' ELSE 'DOC_' || doc_id || '.fna' END AS name, quality FROM labels) SELECT d.doc_id AS genome_id, x.name, x.quality / 1.0 AS completeness FROM documents d JOIN x ON regexp_replace(x.name, '([.](gz|fasta|fna|faa|fa))+$', '') = 'DOC_' || d.doc_id")
def ingest_external(spark, d):
    """External names match exactly, else without extensions."""
    from ..functions.taxonomy import strip_extensions

    ext = F.element_at(F.array(F.lit(""), F.lit(".fa.gz"), F.lit(".fna")), (F.col("doc_id") % 3 + 1).cast("int"))
    x = v.load(spark, d, "labels").select(F.concat(F.lit("DOC_"), "doc_id", ext).alias("name"), "quality").withColumn("stem", strip_extensions(F.col("name")))
    g = v.genomes(spark, d).select("genome_id", "accession")
    exact = x.join(g.select("genome_id", F.col("accession").alias("name")), "name", "left")
    both = exact.join(g.select(F.col("genome_id").alias("by_stem"), F.col("accession").alias("stem")), "stem", "left")
    return both.select(F.coalesce("genome_id", "by_stem").alias("genome_id"), "name", (F.col("quality") / 1.0).alias("completeness")).where("genome_id is not null")


@query("WITH r AS (SELECT label, min(vec_id) AS rep, count(*) AS n FROM embeddings GROUP BY label) SELECT e.vec_id, e.label, r.rep, CASE WHEN e.vec_id = r.rep THEN 'representative' ELSE 'member' END AS status, r.n AS cluster_size FROM embeddings e JOIN r USING (label)")
def derep_neighbors(spark, d):
    e = v.load(spark, d, "embeddings").select("vec_id", "label")
    r = e.groupBy("label").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cluster_size"))
    return e.join(r, "label").select("vec_id", "label", "rep", F.when(F.col("vec_id") == F.col("rep"), "representative").otherwise("member").alias("status"), "cluster_size")


@query("WITH r AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS n_reps, count(*) FILTER (n = 1) AS n_singletons, sum(n)::BIGINT AS n_members FROM r")
def derep_stats(spark, d):
    r = v.load(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return r.agg(F.count(F.lit(1)).alias("n_reps"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.sum("n").alias("n_members"))


@query("WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS id, list_cosine_similarity(x, embedding::DOUBLE[]) AS c FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY -round(c, 9), id) - 1 AS rank FROM s) SELECT query, rank::INT AS rank, id, round(c, 6) AS similarity FROM r WHERE rank < 10")
def similar_topk(spark, d):
    """Every vector whose id is divisible by 20 against all; ten best."""
    e = v.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ops.similar(e.where("id % 20 = 0"), e, 10).withColumn("similarity", F.round("similarity", 6))


