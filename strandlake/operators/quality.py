"""Quality columns by provenance: identities, ingestion, profiles, reports, dereplication views, decontamination."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = ("axis", "tool", "method", "unit", "version", "ref_db", "core_model", "calibration")


def column_id(**identity: str) -> int:
    """63-bit id of a column's identity; a label is not part of it."""
    text = "\x1f".join(identity.get(k, "") for k in IDENTITY)
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1


def ingest(cells: DataFrame, values: DataFrame, column: int) -> DataFrame:
    """Long cells (genome_id, column_id, value) with one column's values put in the place of older ones."""
    new = values.select("genome_id", F.lit(column).alias("column_id"), F.col("value").cast("double").alias("value"))
    return cells.join(new.select("genome_id", "column_id"), ["genome_id", "column_id"], "left_anti").unionByName(new)


def parse_selector(text: str) -> tuple[str, list[dict]]:
    """axis=tool:method[@cal][/tool:method[@cal]] -> axis and its choices in order."""
    axis, _, rest = text.partition("=")
    choices = []
    for part in rest.split("/"):
        m = re.fullmatch(r"([^:@]+):([^:@]+)(?:@(.+))?", part)
        if not axis or not m:
            raise ValueError(f"selector {text!r} is not axis=tool:method[@cal][/...]")
        choices.append({"tool": m[1], "method": m[2], "calibration": m[3] or ""})
    return axis, choices


def policy_hash(selections: dict[str, list[int]]) -> str:
    """Equal for equal selections, in whatever order they were given; a description has no part in it."""
    return hashlib.sha256(repr(sorted((k, list(v)) for k, v in selections.items())).encode()).hexdigest()


def report(genomes: DataFrame, cells: DataFrame, profile: dict[str, list[int]]) -> DataFrame:
    """One value and its source per axis, the first choice that has a value: one pass over the cells, one pivot."""
    rank = {(a, c): i for a, cs in profile.items() for i, c in enumerate(cs)}
    spark = cells.sparkSession
    choice = spark.createDataFrame([(a, c, i) for (a, c), i in rank.items()], "axis string, column_id long, choice int")
    best = cells.where(F.col("value").isNotNull()).join(F.broadcast(choice), "column_id").groupBy("genome_id", "axis").agg(F.min_by(F.struct("value", "column_id"), "choice").alias("cell"))
    wide = best.groupBy("genome_id").pivot("axis", sorted(profile)).agg(F.first("cell"))
    out = genomes.select("genome_id").join(wide, "genome_id", "left")
    return out.select("genome_id", *[x for a in sorted(profile) for x in (F.col(f"`{a}`.value").alias(a), F.col(f"`{a}`.column_id").alias(f"{a}_source"))])


def derep_status(requests: DataFrame, members: DataFrame, tombstones: DataFrame) -> DataFrame:
    """accession -> representative, member (with rep), unclustered, tombstoned, absent. members: accession, rep (null: unclustered)."""
    m = members.select("accession", "rep", F.lit(True).alias("_known"))
    t = tombstones.select("accession", F.lit(True).alias("_gone")).distinct()
    j = requests.join(m, "accession", "left").join(t, "accession", "left")
    status = F.when(F.col("_known").isNull(), "absent").when(F.col("_gone"), "tombstoned").when(F.col("rep").isNull(), "unclustered").when(F.col("rep") == F.col("accession"), "representative").otherwise("member")
    return j.select("accession", status.alias("status"), F.when(status == "member", F.col("rep")).alias("rep"))


def accession_set_hash(accessions: DataFrame) -> tuple[int, int]:
    """Order-independent hash and size of a set of accessions."""
    r = accessions.select("accession").distinct().agg(F.bit_xor(F.xxhash64("accession")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return r.h or 0, r.n


def staleness(view: dict, archive: dict) -> str:
    """How a stored view relates to an archive; each has parts, hash, n_live, uuid, generation."""
    if view["parts"] != archive["parts"]:
        return "Mismatch"
    if view["hash"] == archive["hash"]:
        same = (view["uuid"], view["generation"]) == (archive["uuid"], archive["generation"])
        return "Fresh" if same else "LayoutChangedSameLiveSet"
    if archive["n_live"] > view["n_live"]:
        return "StaleNewGenomes"
    return "StaleTombstones" if archive["n_live"] < view["n_live"] else "Mismatch"


def decontaminate(genomes: DataFrame, score: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], most_rounds: int = 5) -> tuple[DataFrame, int, bool]:
    """Score, drop, repeat until nothing is dropped: what is left, rounds done, and whether it settled (False: the last of most_rounds
    still dropped some, so another call may go on from there). Each round is checkpointed; only counts come to the driver."""
    left = genomes.select("genome_id").checkpoint()
    n = left.count()
    for done in range(1, most_rounds + 1):
        good = keep(score(genomes.join(left, "genome_id", "left_semi"))).select("genome_id").checkpoint()
        now = good.count()
        if now == n:
            return good, done, True
        left, n = good, now
    return left, most_rounds, False


def clean_members(scores: DataFrame, group: str = "genus", z_over: float = 5.0, gap_over: float = 0.02, outlier_over: float = 0.015) -> DataFrame:
    """The rule of the loop: a genome goes if its leakage lies z_over robust deviations and gap_over above its group's median, or if its
    contig outlier share exceeds outlier_over. scores: genome_id, group, leakage, contig_outlier (null: no evidence)."""
    from .models import group_statistics

    s = group_statistics(scores, group, "leakage").select(group, F.col("upper_median").alias("_median"), F.greatest(1.4826 * F.col("mad"), F.lit(1e-6)).alias("_mad"))
    gap = F.col("leakage") - F.col("_median")
    bad = F.coalesce((gap / F.col("_mad") > z_over) & (gap > gap_over), F.lit(False)) | F.coalesce(F.col("contig_outlier") > outlier_over, F.lit(False))
    return scores.join(s, group, "left").where(~bad).select(*scores.columns)
