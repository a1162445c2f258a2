"""Readers: manifests, FASTA, quality tables, accession lists, taxonomy dumps and releases, alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that manifest columns go by.
ALIASES = {
    "accession": ("accession", "acc"),
    "file_path": ("file_path", "path", "fasta_path", "fasta", "file"),
    "taxonomy": ("taxonomy",),
    "completeness": ("completeness",),
    "contamination": ("contamination",),
    "genome_length": ("genome_length",),
    "n_contigs": ("n_contigs",),
    "genome_type": ("genome_type",),
}
TYPES = {"completeness": "float", "contamination": "float", "genome_length": "bigint", "n_contigs": "int"}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest with a header: aliased columns, `extra` as a map; comment lines and rows without accession or path are left out."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#", quote="")
    lower = {c.strip().lower(): c for c in t.columns}
    known = {name: lower[a] for name, aliases in ALIASES.items() for a in reversed(aliases) if a in lower}
    rest = [c for c in t.columns if c not in known.values()]
    cols = [F.col(f"`{known[n]}`").cast(TYPES.get(n, "string")).alias(n) if n in known else F.lit(None).cast(TYPES.get(n, "string")).alias(n) for n in ALIASES]
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`"))]) if rest else F.create_map().cast("map<string,string>")
    return t.select(*cols, extra.alias("extra")).where("accession is not null and file_path is not null")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, contig_index, header, name, seq; gzip by file suffix."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("fasta"))
    return parse_fasta(files, "fasta", "path")


def parse_fasta(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per record; CR and LF are tolerated, the name is the header's first token."""
    records = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(column, "\r", "")), "\n>", -1), lambda x: F.trim(x) != "")
    r = df.select(*keys, F.posexplode(records).alias("contig_index", "r"))
    header = F.regexp_extract("r", "^([^\n]*)", 1)
    return r.select(*keys, "contig_index", header.alias("header"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace("r", "^[^\n]*", ""), r"\s", "").alias("seq"))


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """External quality tables in either layout, percent to fractions: name, completeness, contamination."""
    t = spark.read.csv(path, sep="\t", header=True)
    lower = {c.strip().lower(): c for c in t.columns}
    pick = lambda *names: next(F.col(f"`{lower[n]}`") for n in names if n in lower)
    return t.select(
        pick("name", "genome", "accession", "bin", "bin name").alias("name"),
        (pick("completeness", "percent_completion", "% completion").cast("double") / 100).alias("completeness"),
        (pick("contamination", "percent_redundancy", "% redundancy").cast("double") / 100).alias("contamination"),
    )


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """One accession a line, or a table with an accession or name column."""
    lines = spark.read.text(path)
    first = lines.first()
    if first and "\t" in first.value:
        t = spark.read.csv(path, sep="\t", header=True)
        column = next(c for c in t.columns if c.lower() in ("accession", "name"))
        return t.select(F.trim(F.col(column)).alias("accession")).where("accession <> ''").distinct()
    return lines.select(F.trim("value").alias("accession")).where("accession <> '' and accession not like '#%' and lower(accession) not in ('accession', 'name')").distinct()


def read_taxdump(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(taxid, parent, rank) and unambiguous scientific (name, taxid)."""
    cut = lambda p: spark.read.text(p).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))
    n = cut(nodes).select(F.col("f")[0].cast("long").alias("taxid"), F.col("f")[1].cast("long").alias("parent"), F.col("f")[2].alias("rank"))
    m = cut(names).where(F.col("f")[3] == "scientific name").select(F.col("f")[1].alias("name"), F.col("f")[0].cast("long").alias("taxid"))
    return n, m.groupBy("name").agg(F.min("taxid").alias("taxid"), F.countDistinct("taxid").alias("k")).where("k = 1").drop("k")


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """Release taxonomy without a header: accession (source prefix stripped), taxonomy."""
    t = spark.read.csv(path, sep="\t").toDF("accession", "taxonomy")
    return t.where("taxonomy like 'd\\_\\_%'").select(F.regexp_replace("accession", "^(RS|GB)_", "").alias("accession"), "taxonomy")


def read_patch(spark: SparkSession, path: str) -> DataFrame:
    """accession and new taxonomy from a two-column patch or a classification summary; N/A rows are left out."""
    t = spark.read.csv(path, sep="\t", header=True)
    acc = next(c for c in t.columns if c in ("accession", "user_genome"))
    tax = next(c for c in t.columns if c in ("new_taxonomy", "classification", "taxonomy"))
    return t.select(F.col(acc).alias("accession"), F.col(tax).alias("taxonomy")).where("taxonomy is not null and taxonomy <> 'N/A'")


def marker_columns(alignment: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Aligned sequences (name, seq) cut to each marker's column range, gaps out: name, marker, seq."""
    cut = F.array(*[F.struct(F.lit(m).alias("marker"), F.regexp_replace(F.substring("seq", a + 1, b - a), "[-.]", "").alias("seq")) for m, a, b in ranges])
    return alignment.select("name", F.explode(cut).alias("x")).select("name", "x.marker", "x.seq").where("seq <> ''")


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parts of a set in natural order (part_2 before part_10), tagged with part_index."""
    import re

    number = lambda p: int(m[1]) if (m := re.search(r"part_(\d+)", p)) else -1
    out = None
    for i, p in enumerate(sorted(paths, key=lambda p: (number(p), p))):
        df = spark.read.parquet(p).withColumn("part_index", F.lit(i)).withColumn("part_path", F.lit(p))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
