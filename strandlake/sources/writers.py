"""Writers: FASTA, tab-separated tables, taxonomy dumps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fasta_text(name, seq, width: int = 60) -> F.Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", ordinal: str | None = None) -> None:
    """Text files in order of the ordinal, if there is one."""
    out = df.select(*([ordinal] if ordinal else []), fasta_text(F.col(name), F.col(seq)).alias("value"))
    (out.repartitionByRange(ordinal).sortWithinPartitions(ordinal).select("value") if ordinal else out).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Null and NaN are NA."""
    cols = [F.when(F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False)), "NA").otherwise(F.col(c).cast("string")).alias(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, sep="\t", header=True, quote="")


def write_fasta_files(df: DataFrame, path: str, accession: str = "accession", name: str = "name", seq: str = "seq", ordinal: str = "contig_index") -> None:
    """A folder accession=<accession> for each genome, its contigs in order in one text file."""
    text = df.select(F.col(accession).alias("accession"), F.col(ordinal).alias("_o"), fasta_text(F.col(name), F.col(seq)).alias("value"))
    text.repartition("accession").sortWithinPartitions("accession", "_o").select("accession", "value").write.partitionBy("accession").text(path)


#: Names of ranks in nodes.dmp by prefix; life, kingdom and whatever else have no rank there (fixed values).
DUMP_RANKS = {"d": "superkingdom", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}


def write_taxdump(nodes: DataFrame, path: str, accessions: DataFrame | None = None, merged: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    """nodes (taxid, parent_taxid, rank, name) as nodes.dmp (13 fields; a parent of null or 0 is the node itself, a rank is a prefix or a name)
    and names.dmp; accessions (accession, taxid) as acc2taxid.dmp, with a header in each part; merged (old, new) and deleted (taxid) as
    merged.dmp and delnodes.dmp, which are empty where they are not given."""
    end, sep = F.lit("\t|"), "\t|\t"
    line = lambda df, *cols: df.select(F.concat(F.concat_ws(sep, *cols), end).alias("value"))
    none = nodes.select("taxid", F.col("taxid").alias("old"), F.col("taxid").alias("new")).where("false")
    full = {"domain": "superkingdom"} | {n: n for n in DUMP_RANKS.values()} | DUMP_RANKS
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in full.items() for x in kv])[F.coalesce("rank", F.lit(""))], F.lit("no rank"))
    parent = F.when(F.coalesce("parent_taxid", F.lit(0)) == 0, F.col("taxid")).otherwise(F.col("parent_taxid"))
    line(nodes, "taxid", parent, rank, *[F.lit(x) for x in ("", "0", "0", "1", "0", "0", "0", "0", "0", "")]).write.text(f"{path}/nodes.dmp")
    line(nodes, "taxid", "name", F.lit(""), F.lit("scientific name")).write.text(f"{path}/names.dmp")
    if accessions is not None:
        a = accessions.select("accession", F.col("accession").alias("accession.version"), "taxid", F.lit(0).alias("gi"))
        a.write.csv(f"{path}/acc2taxid.dmp", sep="\t", header=True, quote="")
    line(none if merged is None else merged, "old", "new").write.text(f"{path}/merged.dmp")
    line(none if deleted is None else deleted, "taxid").write.text(f"{path}/delnodes.dmp")


def write_columnar_taxonomy(nodes: DataFrame, accessions: DataFrame, path: str) -> None:
    """taxnodes (taxid, parent_taxid, rank, name) in order of taxid and acc2taxid (acc_hash, accession, taxid) in the unsigned order of the
    accession's hash, as Parquet whose statistics prune look-ups; and both as tab-separated text."""
    from ..functions.kernels import with_fnv1a_64
    from ..operators.catalog import unsigned_order

    hashed = with_fnv1a_64(accessions.select("accession", "taxid"), "accession", "acc_hash").withColumn("_u", unsigned_order(F.col("acc_hash")))
    tables = {"taxnodes": (nodes.select("taxid", "parent_taxid", "rank", "name"), ["taxid"], "taxonomy.tsv"), "acc2taxid": (hashed.select("acc_hash", "accession", "taxid", "_u"), ["_u", "accession"], "acc2taxid.tsv")}
    for name, (df, order, text) in tables.items():
        df.repartitionByRange(*order).sortWithinPartitions(*order).drop("_u").write.parquet(f"{path}/{name}")
        df.drop("_u", "acc_hash").write.csv(f"{path}/{text}", sep="\t", header=True, quote="")


def calibration_json(parts: dict[str, dict]) -> str:
    """Fitted calibrations as one document: for each part its isotonic knots, weights, feature names, error and number of samples."""
    keys = ("isotonic_x", "isotonic_y", "ols_weights", "feature_names", "training_rmse", "n_samples")
    return json.dumps({name: {k: part[k] for k in keys} for name, part in parts.items()}, indent=2)


def write_panel(panel: DataFrame, path: str, key: str, params: dict) -> None:
    """A panel of hashes (key, hash, ...): Parquet in order of hash, each key's rows together, and its parameters beside it."""
    panel.repartitionByRange(key, "hash").sortWithinPartitions(key, "hash").write.parquet(f"{path}/rows")
    panel.sparkSession.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.text(f"{path}/params")


def write_simulation(contigs: DataFrame, truth: DataFrame, path: str) -> None:
    """Simulated genomes (accession, contig_index, name, seq) as FASTA folders and their truth table as tab-separated text."""
    write_fasta_files(contigs, f"{path}/fasta")
    write_tsv(truth, f"{path}/truth")


def write_repacked(df: DataFrame, path: str, taxon: str, order: str) -> None:
    """Re-sharded by taxon: each taxon's rows lie together, in order; row-group statistics then prune by taxon."""
    df.repartitionByRange(taxon, order).sortWithinPartitions(taxon, order).write.option("compression", "zstd").parquet(path)
