"""Queries over group models and iterative operators (rows are checked, values by tests)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as kx
from ..operators import check
from ..operators import groups as ops
from ..sources import views as v
from .models import oph_sketch
from .registry import query

W = "WITH " + v.SQL


def contig_profiles(spark, d, least: int = 20):
    """genome_id, contig_index, genus, bp, tnf of contigs of `least` letters or more."""
    c = v.contigs(spark, d).where(F.length("seq") >= least)
    c = kx.doubles(c.withColumn("bp", F.length("seq").cast("long")).withColumn("_s", F.col("seq")), "_s", kx.tnf, "tnf")
    return c.select("genome_id", "contig_index", "bp", "tnf").where("tnf is not null")


@query()
def genus_consensus_vote(spark, d):
    """Running vote of each bin over a genus' members in order of id."""
    g = v.genomes(spark, d).select("genome_id", "genus")
    return ops.majority_vote(oph_sketch(spark, d).join(g, "genome_id"), "genus", "genome_id", "sig1", 64)


@query()
def cov_model(spark, d):
    """Shrunk covariance of the 4-mer profiles of each genus."""
    g = kx.doubles(v.genomes(spark, d).select("genome_id", "genus", "seq"), "seq", kx.tnf, "tnf")
    return ops.covariance_model(g, "genus", "tnf").select("genus", "n", F.slice("eigenvalues", 1, 3).alias("leading"), "residual")


@query()
def balanced_cov_model(spark, d, least: int = 20):
    """Covariance of each genus in which genomes weigh the same, with the quantiles of its own contigs' distances."""
    c = v.contigs(spark, d).where(F.length("seq") >= 20).withColumn("bp", F.length("seq").cast("long")).withColumn("_s", F.col("seq"))
    c = kx.doubles(kx.doubles(c, "_s", kx.tnf, "tnf"), "seq", kx.rho, "rho").join(v.genomes(spark, d).select("genome_id", "genus"), "genome_id")
    m = ops.balanced_model(c, "genus", "genome_id", "tnf", "rho", "bp", least=least)
    middle = [F.round(F.element_at(f"{x}_quantiles", 64), 6).alias(f"{x}_middle") for x in ("t2", "spe", "rho")]
    return m.select("genus", "n_genomes", "n_contigs", "valid", F.transform(F.slice("eigenvalues", 1, 3), lambda x: F.round(x, 9)).alias("leading"), *middle)


@query()
def tnf_excess(spark, d):
    """Excess distance of every genome's profile from its genus, as the check has it and as building has it."""
    g = kx.doubles(v.genomes(spark, d).select(F.col("genome_id").alias("id"), "genus", "seq"), "seq", kx.tnf, "tnf")
    return ops.profile_excess(g, ops.shrunk_model(g, "genus", "tnf"), "genus", "tnf")


@query()
def tnf_distances(spark, d):
    """T2 and SPE of every genome's profile against the leading axes of its genus."""
    g = kx.doubles(v.genomes(spark, d).select(F.col("genome_id").alias("id"), "genus", "seq"), "seq", kx.tnf, "tnf")
    return ops.distances(g, ops.covariance_model(g, "genus", "tnf"), "genus", "tnf")


@query()
def gmm_bic(spark, d):
    """Two diagonal Gaussians against one over the contigs of each genome, by the two axes of widest spread, weighted by length."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("contig_index")
        x, bp = np.stack(g["tnf"].to_numpy()), g["bp"].to_numpy(float)
        x = x[:, np.argsort(-x.var(axis=0), kind="stable")[:2]]
        share, gain, better = ops.two_gaussians(x, bp) or (None, None, None)
        return pd.DataFrame({"genome_id": [int(g["genome_id"].iloc[0])], "minority": pd.array([share], "Float64"), "bic_gain": pd.array([gain], "Float64"), "bimodal": pd.array([better], "boolean")})

    return contig_profiles(spark, d).groupBy("genome_id").applyInPandas(run, "genome_id long, minority double, bic_gain double, bimodal boolean")


@query()
def contig_split(spark, d):
    """Of each genome's contigs, by their sketches: the share that agrees best with another genus of the family, and the share that falls
    two deviations short of the genome's own running vote. Genera come with the family's consensus, a short list."""
    bins, k = 32, 8
    genera = v.genomes(spark, d).select("genome_id", "family", "genus")
    stored = check.sketches(v.genomes(spark, d), (k,), bins)
    models = check.consensus_signatures(stored, genera, "genus", bins).select("genus", "consensus").join(genera.select("family", "genus").distinct(), "genus")
    by_family = models.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("genus", "consensus"))).alias("models"))
    contigs = v.contigs(spark, d).where(F.length("seq") >= 20).select((F.col("genome_id") * 100_000 + F.col("contig_index")).alias("genome_id"), "seq", F.length("seq").alias("bp"))
    cut = check.sketches(contigs, (k,), bins).where("n_real > 0").join(contigs.select("genome_id", "bp"), "genome_id")
    cut = cut.select(F.floor(F.col("genome_id") / 100_000).cast("long").alias("genome_id"), (F.col("genome_id") % 100_000).alias("contig_index"), "bp", "sig", F.element_at("real", 1).alias("real"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("contig_index")
        sig, bp = np.stack(g["sig"].to_numpy()), g["bp"].to_numpy(float)
        real = (g["real"].to_numpy(np.int64)[:, None] >> np.arange(bins)) & 1 == 1
        known = {m["genus"]: np.asarray(m["consensus"]) for m in g["models"].iloc[0]}
        host = g["genus"].iloc[0]
        known = {host: known[host], **known}  # the host comes first: ties are its own
        found = [ops.reference_minority(sig, real, bp, known, host), ops.self_outlier(sig, real, bp)]
        return pd.DataFrame({"genome_id": [int(g["genome_id"].iloc[0])], "n_contigs": [len(g)], "reference_minority": pd.array(found[:1], "Float64"), "self_outlier": pd.array(found[1:], "Float64")})

    j = cut.join(genera, "genome_id").join(by_family, "family")
    return j.groupBy("genome_id").applyInPandas(run, "genome_id long, n_contigs long, reference_minority double, self_outlier double")


def _per_genome(kernel, name, most: int | None = None):
    """Applies the kernel to all contigs of a genome, or to its `most` longest where the operator has such a limit."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bp", "contig_index"], ascending=[False, True]).head(len(g) if most is None else most)
        x = np.stack(g["tnf"].to_numpy())
        return pd.DataFrame([(int(g["genome_id"].iloc[0]), len(g), kernel(x, g["bp"].to_numpy(float)))], columns=["genome_id", "n_contigs", name])

    return run


@query()
def gmm_minor(spark, d):
    """Minor component of a two-Gaussian mixture along the first principal axis of all contig profiles of each genome."""

    def kernel(x, bp):
        c = x - x.mean(axis=0)
        axis = np.linalg.svd(c, full_matrices=False)[2][0]
        return ops.mixture_minor(c @ axis, bp)

    return contig_profiles(spark, d).groupBy("genome_id").applyInPandas(_per_genome(kernel, "minor"), "genome_id long, n_contigs long, minor double")


@query()
def fiedler(spark, d):
    """Smaller side of the Fiedler cut over the 32 longest contigs of each genome."""
    return contig_profiles(spark, d).groupBy("genome_id").applyInPandas(_per_genome(lambda x, bp: ops.fiedler_minor(np.maximum(x @ x.T, 0), bp), "minor", 32), "genome_id long, n_contigs long, minor double")


@query()
def calibrate_isotonic(spark, d):
    """Quality truth on genome length, with GC and contigs as further features."""
    c = v.catalog(spark, d).withColumn("truth", F.col("completeness") / 100).withColumn("gc", F.col("gc_pct_x100") / 10000)
    estimated, _ = ops.calibrate(c, "genome_length", "truth", ["gc", "n_contigs"])
    return estimated.select("genome_id", "truth", F.round("estimate", 6).alias("estimate"))


@query()
def greedy_anchor_clusters(spark, d):
    """Greedy clusters of the profiles of each anchor (label), in order of id."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id").reset_index(drop=True)
        reps = ops.greedy_clusters(np.stack(g["embedding"].to_numpy()).astype(float))
        return pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "rep": g["vec_id"].to_numpy()[reps]})

    return v.load(spark, d, "embeddings").groupBy("label").applyInPandas(run, "vec_id long, label int, rep long")


@query(W + ", r AS (SELECT genome_id, contig_index, length(seq) AS bp, sum(length(seq)) OVER (PARTITION BY genome_id ORDER BY md5(contig_acc), contig_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(length(seq)) OVER (PARTITION BY genome_id) AS total FROM contigs) SELECT genome_id, contig_index, bp FROM r WHERE coalesce(before, 0) < 0.7 * total")
def sim_fragments(spark, d):
    """Simulated incomplete genomes: shuffled contigs are taken until 70 % of the letters are reached."""
    order = Window.partitionBy("genome_id").orderBy(F.md5(F.col("contig_acc").cast("binary")), "contig_index").rowsBetween(Window.unboundedPreceding, -1)
    c = v.contigs(spark, d).withColumn("bp", F.length("seq").cast("long"))
    c = c.withColumn("before", F.coalesce(F.sum("bp").over(order), F.lit(0))).withColumn("total", F.sum("bp").over(Window.partitionBy("genome_id")))
    return c.where(F.col("before") < 0.7 * F.col("total")).select("genome_id", "contig_index", "bp")


@query()
def cross_genus(spark, d):
    """Genomes whose profile some sibling genus of the family explains better than their own genus."""
    g = kx.doubles(v.genomes(spark, d).select(F.col("genome_id").alias("id"), "family", "genus", "seq"), "seq", kx.tnf, "x").where("x is not null")
    models = ops.covariance_model(g, "genus", "x", least=5)
    siblings = g.groupBy("family").agg(F.sort_array(F.collect_set("genus")).alias("siblings"))
    return ops.log_likelihoods(g.join(siblings, "family"), models, "genus", "siblings")


@query()
def fracminhash_set(spark, d):
    """Sizes of the subsampled hash sets of each genome over k and c."""
    out = v.genomes(spark, d).select("genome_id", "seq")
    for k in (21, 31):
        for c in (5, 30):
            out = kx.longs(out.withColumn("_s", F.col("seq")), "_s", lambda s, k=k, c=c: kx.fracminhash(s, k, c), "h").withColumn(f"n_{k}_{c}", F.size("h")).drop("h", "_s")
    return out.drop("seq")


@query(W + ", gs AS (SELECT DISTINCT family, genus FROM g), n AS (SELECT family, genus, coalesce(lead(genus) OVER (PARTITION BY family ORDER BY genus), min(genus) OVER (PARTITION BY family)) AS donor FROM gs), s AS (SELECT genus, sum(length(seq))::BIGINT AS bp FROM g GROUP BY genus) SELECT n.genus AS host, donor, level, round(s.bp * level / (1 - level), 4) AS donor_bp FROM n JOIN s USING (genus), (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS level) x WHERE donor <> n.genus")
def bench_grid(spark, d):
    """Contamination grid: each genus with the next of its family as donor, at four levels; donor letters for each level."""
    g = v.genomes(spark, d).select("family", "genus", F.length("seq").cast("long").alias("bp")).groupBy("family", "genus").agg(F.sum("bp").alias("bp"))
    w = Window.partitionBy("family")
    donor = F.coalesce(F.lead("genus").over(w.orderBy("genus")), F.min("genus").over(w))
    levels = F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2, 0.3)))).alias("level")
    grid = g.withColumn("donor", donor).where("donor <> genus").select(F.col("genus").alias("host"), "donor", "bp", levels)
    return grid.select("host", "donor", "level", F.round(F.col("bp") * F.col("level") / (1 - F.col("level")), 4).alias("donor_bp"))
