"""The quality check's first pass: support tiers, length proxy, stored sketches against consensus signatures, leakage, composition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as kx
from ..functions import scoring as sc
from . import groups, models

SKETCH = "genome_id bigint, k int, m int, seed int, sig array<int>, real array<bigint>, n_real int"


def sketches(genomes: DataFrame, ks: tuple[int, ...], bins: int, seed: int = 42) -> DataFrame:
    """Stored sketches of (genome_id, seq): for each k the densified signature, the real bins as 64-bit words, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in ks:
                    sig, real = kx.oph_sketch((seq or "").encode(), k, bins, seed, True)
                    words = np.packbits(np.pad(real, (0, -bins % 64)), bitorder="little").view("<i8")
                    rows.append({"genome_id": i, "k": k, "m": bins, "seed": seed, "sig": sig.tolist(), "real": words.tolist(), "n_real": int(real.sum())})
            kind = pa.schema([("genome_id", pa.int64()), ("k", pa.int32()), ("m", pa.int32()), ("seed", pa.int32()), ("sig", pa.list_(pa.int32())), ("real", pa.list_(pa.int64())), ("n_real", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, kind)

    return genomes.select("genome_id", "seq").mapInArrow(run, SKETCH)


def sketch_scan(stored: DataFrame, ids: DataFrame, ks: tuple[int, ...] | None = None) -> DataFrame:
    """Sketches of the given genomes, of one k or several."""
    out = stored.join(ids.select("genome_id").distinct(), "genome_id", "left_semi")
    return out if ks is None else out.where(F.col("k").isin(*ks))


def sketch_slice(stored: DataFrame, m: int) -> DataFrame:
    """Sketches cut to their first m bins: signature, words of real bins, and their number counted again."""
    whole, rest = divmod(m, 64)
    cut = F.slice("real", 1, whole + bool(rest))
    if rest:
        mask = F.lit((1 << rest) - 1)
        cut = F.transform(cut, lambda w, i: F.when(i == whole, w.bitwiseAND(mask)).otherwise(w))
    n = F.aggregate(cut, F.lit(0), lambda a, w: a + F.bit_count(w))
    return stored.where(F.col("m") >= m).select("genome_id", "k", F.lit(m).alias("m"), "seed", F.slice("sig", 1, m).alias("sig"), cut.alias("real"), n.cast("int").alias("n_real"))


def support_tiers(catalog: DataFrame, key: str = "genus", saturated: int = 3) -> DataFrame:
    """genome_id, key, tier, p90_length, length_ratio (clamped to [0, 1.5]): what a genome's group and its length alone say."""
    size = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    long = models.nth_values(catalog.where("genome_length > 0"), [key], "genome_length", {"p90_length": lambda n: F.ceil(0.9 * n) - 1}).select(key, "p90_length")
    bare = F.col(key).isNull() | (F.length(key) <= 3)
    tier = F.when(bare, "Singleton").when(F.col("members") < saturated, "GenusSparse").otherwise("GenusSaturated")
    ratio = F.when(F.col("p90_length") > 0, F.least(F.greatest(F.col("genome_length") / F.col("p90_length"), F.lit(0.0)), F.lit(1.5)))
    return catalog.join(size, key, "left").join(long, key, "left").select("genome_id", key, "members", tier.alias("tier"), "p90_length", ratio.alias("length_ratio"))


#: Members whose containment falls below this share of their group's best take no part in its percentiles (fixed value).
COMPLETE_SHARE = 0.5


def consensus_signatures(stored: DataFrame, members: DataFrame, key: str, bins: int) -> DataFrame:
    """key, k, consensus (running vote in order of genome_id), members."""
    s = stored.join(members.select("genome_id", key), "genome_id").select(F.concat_ws("\x01", F.col(key), F.col("k").cast("string")).alias("model"), "genome_id", "sig")
    votes = groups.majority_vote(s, "model", "genome_id", "sig", bins)
    whole = votes.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "consensus"))), lambda x: x.consensus.cast("int")).alias("consensus"), F.max("n").alias("members"))
    name = F.split("model", "\x01")
    return whole.select(name[0].alias(key), name[1].cast("int").alias("k"), "consensus", "members")


def consensus_models(stored: DataFrame, members: DataFrame, key: str, bins: int, least_k: int) -> DataFrame:
    """key, k, consensus, members, p90, median, mad: the last three of the members' containment in the consensus.

    The members that stand for the group are those whose containment at least_k reaches COMPLETE_SHARE of the best.
    """
    consensus = consensus_signatures(stored, members, key, bins)
    held = stored.join(members.select("genome_id", key), "genome_id").join(consensus, [key, "k"]).select(key, "k", "genome_id", agreement("sig", "consensus").alias("c"))
    first = held.where(F.col("k") == least_k).select(key, "genome_id", F.col("c").alias("c0"))
    best = first.groupBy(key).agg((F.max("c0") * COMPLETE_SHARE).alias("bar"))
    whole = held.join(first, [key, "genome_id"]).join(best, key).where("c0 >= bar").select(key, "k", "c")
    ranks = {"p90": lambda n: F.ceil(0.9 * n) - 1, "median": lambda n: F.floor(n / 2)}
    shape = models.nth_values(whole, [key, "k"], "c", ranks).drop("n")
    off = whole.join(shape.select(key, "k", "median"), [key, "k"]).select(key, "k", F.abs(F.col("c") - F.col("median")).alias("off"))
    mad = models.nth_values(off, [key, "k"], "off", {"mad": ranks["median"]}).select(key, "k", (1.4826 * F.col("mad")).alias("mad"))
    return consensus.join(shape, [key, "k"]).join(mad, [key, "k"])


def agreement(sig: str, consensus: str) -> F.Column:
    """Share of bins in which a signature has the consensus value."""
    same = F.aggregate(F.zip_with(sig, consensus, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(sig)


def model_for(members: DataFrame, of_species: DataFrame, of_genus: DataFrame, least: int) -> DataFrame:
    """genome_id, k and the model that scores it: its species' where that has `least` members or more, else its genus' with the same
    bound; genomes without either have no row. members: genome_id, genus, species."""
    columns = ("consensus", "p90", "median", "mad", "members")
    pick = lambda m, key: m.where(F.col("members") >= least).select(F.col(key), F.col("k"), F.struct(*columns).alias(f"{key}_model"))
    ks = of_genus.select("k").unionByName(of_species.select("k")).distinct()
    j = members.select("genome_id", "genus", "species").crossJoin(F.broadcast(ks))  # a handful of k
    j = j.join(pick(of_species, "species"), ["species", "k"], "left").join(pick(of_genus, "genus"), ["genus", "k"], "left")
    j = j.withColumn("model", F.coalesce("species_model", "genus_model")).where("model is not null")
    level = F.when(F.col("species_model").isNotNull(), "species").otherwise("genus")
    return j.select("genome_id", "k", level.alias("level"), *[F.col(f"model.{c}").alias(c) for c in columns])


def pass_a(catalog: DataFrame, stored: DataFrame, profiles: DataFrame, bins: int, least_members: int = 50, dispersed: int = 10) -> DataFrame:
    """The first pass over every genome of the catalogue (genome_id, genus, species, genome_length) with its stored sketches and
    profiles (id, genus, tnf): tier, level of the model used, relative completeness, leakage, accessory ratio and z, composition excess.

    Relative completeness is the containment at the smallest k over the model's p90 where that is more than 0.01, else the length's share
    of the group's p90. Leakage is the excess decay at the largest k, or the loss itself where there is one k. The accessory scores need
    a saturated group, `dispersed` members and a spread. All steps are joins and aggregates on group, genome and k.
    """
    tiers = support_tiers(catalog)
    ks = sorted(r.k for r in stored.select("k").distinct().collect())  # a handful
    if ks:
        of = [consensus_models(stored, catalog, level, bins, ks[0]) for level in ("species", "genus")]
        c = stored.join(model_for(catalog, *of, least_members), ["genome_id", "k"]).select("genome_id", "k", "level", "p90", "median", "mad", "members", agreement("sig", "consensus").alias("c"))
        at = lambda column, k: F.max(F.when(F.col("k") == k, F.col(column)))
        wide = c.groupBy("genome_id").agg(*[at("c", k).alias(f"c{k}") for k in ks], *[at(x, ks[0]).alias(x) for x in ("level", "p90", "median", "mad", "members")]).withColumnRenamed("members", "model_members")
    excess = groups.profile_excess(profiles, groups.shrunk_model(profiles, "genus", "tnf"), "genus", "tnf").select(F.col("id").alias("genome_id"), "excess")
    out = tiers.join(excess, "genome_id", "left")
    none = F.lit(None).cast("double")
    if not ks:
        return out.select("genome_id", "tier", F.lit(None).cast("string").alias("level"), F.col("length_ratio").alias("completeness"), none.alias("leakage"), none.alias("accessory_ratio"), none.alias("accessory_z"), F.col("excess").alias("tnf_excess"))
    out = out.join(wide, "genome_id", "left")
    c0 = F.col(f"c{ks[0]}")
    relative = F.when(c0.isNotNull() & (F.col("p90") > 0.01), F.least(F.greatest(c0 / F.col("p90"), F.lit(0.0)), F.lit(1.5))).otherwise(F.col("length_ratio"))
    all_k = [F.col(f"c{k}") for k in ks]
    leakage = (1 - c0) if len(ks) == 1 else sc.leakage_excess(all_k, list(ks))
    spread = (F.col("tier") == "GenusSaturated") & (F.col("model_members") >= dispersed) & (F.col("mad") > 0)
    return out.select(
        "genome_id", "tier", "level", relative.alias("completeness"), leakage.alias("leakage"), F.when(spread & (F.col("median") > 0), c0 / F.col("median")).alias("accessory_ratio"),
        F.when(spread, (c0 - F.col("median")) / F.col("mad")).alias("accessory_z"), F.col("excess").alias("tnf_excess"),
    )


def column_information(alignment: DataFrame, genus: str, order: str) -> DataFrame:
    """col (from 0), n_observed, information of (genus, order, seq): one less the entropy of reduced residues as a share of its greatest,
    over one representative a genus (the first in order), so that dense genera weigh no more; gaps and other letters are left out."""
    one = alignment.groupBy(genus).agg(F.min_by("seq", order).alias("seq"))
    letters = one.select(F.posexplode(F.split("seq", "")).alias("col", "x")).where("x <> ''")
    reduced = F.coalesce(*[F.when(F.col("x").isin(*group), F.lit(i)) for i, group in enumerate(kx.DAYHOFF_6)])
    n = letters.select("col", reduced.alias("cls")).where("cls is not null").groupBy("col", "cls").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("col").agg(F.sum("n").alias("n_observed"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    entropy = F.ln("n_observed") - F.col("s") / F.col("n_observed")
    return total.select("col", "n_observed", F.greatest((F.lit(np.log(6.0)) - entropy) / float(np.log(6.0)), F.lit(0.0)).alias("information"))


def weakest_link(starts: DataFrame, information: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rows of (..., cols: the alignment columns of a residue k-mer) whose least informative column reaches the threshold; columns that no
    representative observes inform of nothing."""
    known = information.select("col", "information")
    numbered = starts.withColumn("_row", F.monotonically_increasing_id())
    least = numbered.select("_row", F.explode("cols").alias("col")).join(known, "col", "left").groupBy("_row").agg(F.min(F.coalesce("information", F.lit(0.0))).alias("least"), F.count(F.lit(1)).alias("n"))
    return numbered.join(least.where((F.col("least") >= threshold) & (F.col("n") == k)).select("_row"), "_row", "left_semi").drop("_row")
