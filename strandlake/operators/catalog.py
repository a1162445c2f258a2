"""Catalogue operators: filters, newest-wins, deletions, lookups, slices, duplicates, appends, set operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class ExtractQuery:
    """The declarative filter; None leaves a bound out. Thresholds are compared in tenths, truncated, as stored;
    fingerprints as unsigned 64-bit numbers (columns hold the same bits, signed)."""

    min_completeness: float | None = None
    max_contamination: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    max_contigs: int | None = None
    accessions: DataFrame | None = None
    limit: int | None = None
    min_fingerprint: int | None = None
    max_fingerprint: int | None = None
    include_deleted: bool = False


def tenths(c) -> F.Column:
    return F.floor(c.cast("float") * F.lit(10.0).cast("float")).cast("int")


def extract(catalog: DataFrame, q: ExtractQuery, tombstones: DataFrame | None = None) -> DataFrame:
    """Live rows that pass; an accession list replaces the predicates; the limit comes last, in order of genome_id."""
    if q.accessions is not None:
        out = catalog.join(q.accessions.select("accession").distinct(), "accession", "left_semi")
    else:
        bounds = [
            (q.min_completeness, lambda v: tenths(F.col("completeness")) >= tenths(F.lit(v))),
            (q.max_contamination, lambda v: tenths(F.col("contamination")) <= tenths(F.lit(v))),
            (q.min_length, lambda v: F.col("genome_length") >= v),
            (q.max_length, lambda v: F.col("genome_length") <= v),
            (q.max_contigs, lambda v: F.col("n_contigs") <= v),
            (q.min_fingerprint, lambda v: unsigned_order(F.col("fingerprint")) >= v - (1 << 63)),
            (q.max_fingerprint, lambda v: unsigned_order(F.col("fingerprint")) <= v - (1 << 63)),
        ]
        out = catalog
        for value, cond in bounds:
            if value is not None:
                out = out.where(cond(value))
    if tombstones is not None and not q.include_deleted:
        out = live(out, tombstones)
    return out.orderBy("genome_id").limit(q.limit) if q.limit is not None else out


def unsigned_order(c) -> F.Column:
    """A signed number in whose order 64-bit columns stand as unsigned ones."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def fingerprint_range(catalog: DataFrame, low: int, high: int, tombstones: DataFrame | None = None) -> DataFrame:
    """Live rows whose fingerprint lies in [low, high], unsigned, in order of (fingerprint, genome_id)."""
    found = extract(catalog, ExtractQuery(min_fingerprint=low, max_fingerprint=high), tombstones)
    return found.orderBy(unsigned_order(F.col("fingerprint")), "genome_id")


def live(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    return df.join(tombstones.select("genome_id").distinct(), "genome_id", "left_anti")


def newest(df: DataFrame, key: str = "genome_id", order: str = "generation") -> DataFrame:
    """Newest row of each key: an aggregate with map-side combining, not a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(requests: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Requests in their order (ordinal) with what is found, null where nothing is."""
    return requests.join(target.select(key, *columns), key, "left")


def sequence_slice(seq, start, length) -> F.Column:
    """[start, start + length) of the concatenated sequence; empty beyond the end or for length 0."""
    return F.when((length <= 0) | (start >= F.length(seq)), F.lit("")).otherwise(F.substring(seq, (start + 1).cast("int"), length.cast("int")))


def duplicate_groups(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to delete: all but the best (highest completeness, then lowest id) of each group of equal keys."""
    best = Window.partitionBy(*keys).orderBy(F.col("completeness").desc_nulls_last(), "genome_id")
    return catalog.withColumn("rank", F.row_number().over(best)).where("rank > 1")


def append(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of a batch: unknown accession, unknown content, and the best of equal content within the batch."""
    fresh = batch.join(existing.select("accession").distinct(), "accession", "left_anti").join(existing.select(*keys).distinct(), keys, "left_anti")
    best = Window.partitionBy(*keys).orderBy(F.col("completeness").desc_nulls_last(), "genome_id")
    return fresh.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def union_parts(parts: list[DataFrame]) -> DataFrame:
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part_index", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def first_index(parts: DataFrame, key: str = "accession", value: str = "genome_id") -> DataFrame:
    """The index of merged parts: each key's value in the first part that has it, the least there; all rows stay in the catalogue."""
    return parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("part_index", value)).alias("first")).select(key, F.col("first.part_index").alias("part_index"), F.col(f"first.{value}").alias(value))


def merge_strings(parts: list[DataFrame], column: str) -> DataFrame:
    """Sorted union of the distinct strings of several parts: the string, its first part, in how many parts it is, in which place of
    the order of bytes (from 0, by counts of ranges)."""
    from .taxonomy import dense_ids

    each = union_parts([p.select(column).where(F.col(column).isNotNull()).distinct() for p in parts])
    held = each.groupBy(column).agg(F.min("part_index").alias("first_part"), F.count(F.lit(1)).alias("n_parts"))
    return held.join(dense_ids(held, column).select(column, (F.col("taxid") - 1).alias("position")), column)


def common_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of merged parts (part_index, genome_id, k, m, seed, ...): only those of the k that every part has. Parts whose size or
    seed differ for such a k make the merge fail."""
    shape = sketches.groupBy("k").agg(F.countDistinct("part_index").alias("parts"), F.countDistinct("m", "seed").alias("shapes"))
    total = sketches.agg(F.countDistinct("part_index").alias("all"))  # one row
    common = shape.crossJoin(F.broadcast(total)).where(F.col("parts") == F.col("all"))
    odd = [r.k for r in common.where("shapes > 1").select("k").collect()]
    if odd:
        raise ValueError(f"parts differ in sketch size or seed for k = {sorted(odd)}")
    return sketches.join(common.select("k"), "k", "left_semi")


def merge_archives(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's ids shift behind a's; of equal accessions the index keeps the first input's."""
    offset = a.agg((F.coalesce(F.max("genome_id"), F.lit(-1)) + 1).alias("_shift"))
    shifted = b.crossJoin(F.broadcast(offset)).withColumn("genome_id", F.col("genome_id") + F.col("_shift")).drop("_shift")  # one row
    return union_parts([a, shifted])
