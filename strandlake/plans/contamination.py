"""Foreign hashes, single-copy cores, baselines and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as kx
from ..operators import models as ops
from ..sources import views as v
from .models import K, MERS, W, kmer_sets
from .registry import query


@query(W + MERS + ", nm AS (SELECT genus, count(DISTINCT genome_id) AS n FROM km GROUP BY genus), pr AS (SELECT genus, hash, count(*) * 1.0 / any_value(n) AS prev, count(*) AS k FROM km JOIN nm USING (genus) GROUP BY genus, hash), fam AS (SELECT family, hash, count(DISTINCT genus) AS fk FROM km GROUP BY family, hash), mu AS (SELECT hash, count(DISTINCT genus) AS m FROM km GROUP BY hash), x AS (SELECT km.genome_id, CASE WHEN k >= 2 THEN prev ELSE 0 END AS host, (k = 1 AND m BETWEEN 2 AND 3 AND fk = 1) AS is_foreign FROM km JOIN pr USING (genus, hash) JOIN fam USING (family, hash) JOIN mu USING (hash)) SELECT genome_id, round(sum(host), 6) AS host_mass, count(*) FILTER (is_foreign) AS n_foreign, CASE WHEN count(*) FILTER (is_foreign OR host > 0) >= 16 THEN round(count(*) FILTER (is_foreign) / (sum(host) + count(*) FILTER (is_foreign)), 6) END AS foreign_fraction FROM x GROUP BY genome_id")
def foreign_score(spark, d):
    """Hashes that only this member of the genus has, no other genus of the family, and one or two foreign genera do, against the mass of
    host prevalence; fewer than 16 classifiable hashes abstain."""
    m = kmer_sets(spark, d)
    prev = ops.prevalence(m, "genus").select("genus", "hash", F.col("n_present").alias("k"), "prevalence")
    family = m.select("family", "genus", "hash").distinct().groupBy("family", "hash").agg(F.count(F.lit(1)).alias("fk"))
    many = ops.multiplicity(m, "genus", cap=1 << 30)
    x = m.join(prev, ["genus", "hash"]).join(family, ["family", "hash"]).join(many, "hash")
    host = F.when(F.col("k") >= 2, F.col("prevalence")).otherwise(0.0)
    foreign = (F.col("k") == 1) & F.col("n_keys").between(2, 3) & (F.col("fk") == 1)
    s = x.groupBy("genome_id").agg(F.sum(host).alias("h"), F.count_if(foreign).alias("n_foreign"), F.count_if(foreign | (host > 0)).alias("c"))
    return s.select("genome_id", F.round("h", 6).alias("host_mass"), "n_foreign", F.when(F.col("c") >= 16, F.round(F.col("n_foreign") / (F.col("h") + F.col("n_foreign")), 6)).alias("foreign_fraction"))


COPIES = f", kc AS (SELECT genome_id, family, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS hash, count(*) AS copies FROM (SELECT genome_id, family, substr(seq, i, {K}) AS m FROM (SELECT genome_id, family, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM g WHERE length(seq) >= {K})) GROUP BY 1, 2, 3)"


def kmer_copies(spark, d):
    """genome_id, family, hash, copies: counted in the kernel, so repeats inside a genome are one row."""
    import numpy as np

    def counted(s):
        return np.concatenate(np.unique(kx.kmers(kx.codes(s), K, canonical=True), return_counts=True)).astype(np.uint64)

    c = kx.longs(v.genomes(spark, d).select("genome_id", "family", "seq"), "seq", counted, "both").withColumn("half", F.floor(F.size("both") / 2).cast("int"))
    pairs = F.arrays_zip(F.slice("both", F.lit(1), F.col("half")).alias("hash"), F.slice("both", F.col("half") + 1, F.col("half")).alias("copies"))
    c = c.where("half > 0").select("genome_id", "family", pairs.alias("x"))
    return c.select("genome_id", "family", F.explode("x").alias("x")).select("genome_id", "family", "x.hash", "x.copies")


@query(W + COPIES + ", nm AS (SELECT family, count(DISTINCT genome_id) AS n FROM kc GROUP BY family), pc AS (SELECT family, hash, count(*) AS present, count(*) FILTER (copies > 1) AS multi, any_value(n) AS n FROM kc JOIN nm USING (family) GROUP BY family, hash) SELECT family, count(*) AS n_hashes, count(*) FILTER (n >= 10 AND present >= ceil(0.9 * n) AND multi <= floor(0.1 * present)) AS n_single_copy FROM pc GROUP BY family")
def single_copy_core(spark, d):
    """Hashes in nine tenths of a family's genomes or more that are multi-copy in a tenth of those at most."""
    p = ops.single_copy(kmer_copies(spark, d), "family")
    return p.groupBy("family").agg(F.count(F.lit(1)).alias("n_hashes"), F.count_if("is_core").alias("n_single_copy"))


@query(W + COPIES + ", nm AS (SELECT family, count(DISTINCT genome_id) AS n FROM kc GROUP BY family), pc AS (SELECT family, hash, count(*) AS present, count(*) FILTER (copies > 1) AS multi, any_value(n) AS n FROM kc JOIN nm USING (family) GROUP BY family, hash), sc AS (SELECT family, hash FROM pc WHERE n >= 10 AND present >= ceil(0.9 * n) AND multi <= floor(0.1 * present)), ns AS (SELECT family, count(*) AS n_core FROM sc GROUP BY family), cd AS (SELECT family, genome_id, coalesce(count(sc.hash) FILTER (copies > 1)::DOUBLE / nullif(count(sc.hash), 0), 0) AS dup FROM kc LEFT JOIN sc USING (family, hash) GROUP BY family, genome_id), a AS (SELECT family, list_sort(list(dup)) AS v, count(*) AS n FROM cd GROUP BY family), b AS (SELECT family, n, v, v[floor(n / 2)::INT + 1] AS med FROM a), c AS (SELECT family, med, list_sort(list_transform(v, lambda x: abs(x - med)))[floor(n / 2)::INT + 1] AS mad FROM b) SELECT family, coalesce(n_core, 0) AS n_single_copy, CASE WHEN n_core > 0 THEN round(med, 6) END AS median, CASE WHEN n_core > 0 THEN round(mad, 6) END AS mad, CASE WHEN n_core > 0 THEN round(med + 20 * mad, 6) END AS ceiling FROM c LEFT JOIN ns USING (family)")
def single_copy_ceiling(spark, d, theta: float = 0.9):
    """Single-copy core of each family (hashes in ceil(theta * n) of its n genomes or more) and the ceiling of its duplication."""
    c = kmer_copies(spark, d)
    p = ops.single_copy(c, "family", theta)
    n = p.groupBy("family").agg(F.count_if("is_core").alias("n_single_copy"))
    ceiling = n.join(ops.duplication_ceiling(c, p.where("is_core"), "family"), "family")
    given = F.col("n_single_copy") > 0
    return ceiling.select("family", "n_single_copy", *[F.when(given, F.round(x, 6)).alias(x) for x in ("median", "mad", "ceiling")])


@query(W + COPIES + " SELECT genome_id, round(sum(copies - 1) / sum(copies), 6) AS dup_mass, count(*) FILTER (copies > 1) AS n_multi FROM kc GROUP BY genome_id")
def duplication_mass(spark, d):
    return kmer_copies(spark, d).groupBy("genome_id").agg(F.round(F.sum(F.col("copies") - 1) / F.sum("copies"), 6).alias("dup_mass"), F.count_if(F.col("copies") > 1).alias("n_multi"))


@query("WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount AS cco FROM lineitem), s AS (SELECT l_suppkey, list_sort(list(cco)) AS v, count(*) AS n FROM x GROUP BY 1) SELECT l_orderkey, l_linenumber, round(CASE WHEN n >= 5 THEN greatest(0, cco - v[floor(0.2 * n)::INT + 1]) ELSE cco END, 6) AS adjusted FROM x JOIN s USING (l_suppkey)")
def cco_baseline_adj(spark, d):
    """The group's 20th percentile is taken off where it has five members or more."""
    x = v.load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")
    s = ops.group_statistics(x, "l_suppkey", "l_discount").select("l_suppkey", "n", "p20_floor")
    adj = F.when(F.col("n") >= 5, F.greatest(F.lit(0.0), F.col("l_discount") - F.col("p20_floor"))).otherwise(F.col("l_discount"))
    return x.join(s, "l_suppkey").select("l_orderkey", "l_linenumber", F.round(adj, 6).alias("adjusted"))


@query("WITH c AS (SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 5), a AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT l_orderkey, n, v, v[floor(n / 2)::INT + 1] AS med FROM a), m AS (SELECT l_orderkey, med, greatest(1.4826 * list_sort(list_transform(v, lambda x: abs(x - med)))[floor(n / 2)::INT + 1], 0.000001) AS mad FROM b) SELECT l_orderkey AS genome_id, round(sum(CASE WHEN (l_extendedprice - med) / (mad / sqrt(greatest(1, l_quantity / 16))) > 3 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS outlier_bp FROM c JOIN m USING (l_orderkey) GROUP BY 1")
def contig_outlier_z(spark, d, least_length: float = 5, window: float = 16):
    """bp share of contigs that lie more than three length-scaled deviations above their genome's median, over contigs of least_length
    or more; null (no row) where fewer than three contigs are scored. Lengths here are the fixture's, in its own unit."""
    x = v.load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice").where(F.col("l_quantity") >= least_length)
    s = ops.group_statistics(x, "l_orderkey", "l_extendedprice").where("n >= 3").select("l_orderkey", F.col("upper_median").alias("med"), F.greatest(1.4826 * F.col("mad"), F.lit(1e-6)).alias("mad"))
    z = (F.col("l_extendedprice") - F.col("med")) / (F.col("mad") / F.sqrt(F.greatest(F.lit(1.0), F.col("l_quantity") / window)))
    share = F.sum(F.when(z > 3, F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity")
    return x.join(s, "l_orderkey").groupBy(F.col("l_orderkey").alias("genome_id")).agg(F.round(share, 6).alias("outlier_bp"))


@query("WITH m AS (SELECT c_custkey, c_nationkey, count(DISTINCT l_partkey) AS present FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), s AS (SELECT c_nationkey, list_sort(list(present)) AS v, count(*) AS n FROM m GROUP BY 1), a AS (SELECT list_sort(list(present)) AS v, count(*) AS n FROM m) SELECT c_custkey, least(1, round(present / greatest(1, CASE WHEN s.n >= 10 THEN s.v[ceil(0.9 * s.n)::INT] ELSE a.v[ceil(0.9 * a.n)::INT] END), 6)) AS marker FROM m JOIN s USING (c_nationkey), a")
def marker_p90_calibration(spark, d):
    """Markers present over the group's 90th percentile, the global one where a group has fewer than ten."""
    load = lambda t: v.load(spark, d, t)
    j = load("customer").select("c_custkey", "c_nationkey").join(load("orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(load("lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = j.groupBy("c_custkey", "c_nationkey").agg(F.countDistinct("l_partkey").alias("present"))
    s = ops.group_statistics(m, "c_nationkey", "present").select("c_nationkey", F.when(F.col("n") >= 10, F.col("p90_ceil")).alias("own"))
    a = ops.nth_values(m.withColumn("all", F.lit(1)), ["all"], "present", {"overall": lambda n: F.ceil(0.9 * n) - 1}).select("overall")
    out = m.join(s, "c_nationkey").crossJoin(F.broadcast(a))  # one row
    return out.select("c_custkey", F.least(F.lit(1.0), F.round(F.col("present") / F.greatest(F.lit(1), F.coalesce("own", "overall")), 6)).alias("marker"))
