"""Archive entities as views over the driver's tables: documents are genomes, their lines contigs, lang and source the lineage,
labels the external quality, events the append and delete log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acgt(text) -> F.Column:
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def genomes(spark, d) -> DataFrame:
    """genome_id, accession, taxonomy, family, genus, seq."""
    family, genus = F.col("lang"), F.concat_ws("_", "lang", "source")
    tax = F.concat(F.lit("d__Corpus;f__"), family, F.lit(";g__"), genus, F.lit(";s__"), genus, F.lit(" sp"))
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("genome_id"), F.concat(F.lit("DOC_"), F.col("doc_id")).alias("accession"), tax.alias("taxonomy"),
        F.concat(F.lit("f__"), family).alias("family"), F.concat(F.lit("g__"), genus).alias("genus"), acgt(F.col("text")).alias("seq"), "text",
    )


def contigs(spark, d) -> DataFrame:
    """genome_id, contig_index, contig_acc, seq: non-blank lines, numbered from 0."""
    g = load(spark, d, "documents").select(F.col("doc_id").alias("genome_id"), F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "").alias("lines"))
    return g.select("genome_id", F.posexplode("lines").alias("contig_index", "line")).select("genome_id", "contig_index", F.concat_ws(":", F.concat(F.lit("DOC_"), "genome_id"), "contig_index").alias("contig_acc"), acgt(F.col("line")).alias("seq"))


def catalog(spark, d) -> DataFrame:
    """genome_id, accession, taxonomy, family, genus, genome_length, n_contigs, gc_pct_x100, completeness, contamination."""
    g = genomes(spark, d)
    gc = F.length(F.regexp_replace("seq", "[AT]", ""))
    y = load(spark, d, "labels").select(F.col("doc_id").alias("genome_id"), (F.col("quality") * 100.0).alias("completeness"), (F.col("toxic") * 100.0).alias("contamination"))
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
    c = g.select("genome_id", "accession", "taxonomy", "family", "genus", F.length("seq").cast("long").alias("genome_length"), lines.cast("long").alias("n_contigs"), F.floor(gc * 10000 / F.when(F.length("seq") > 0, F.length("seq"))).cast("long").alias("gc_pct_x100"))
    return c.join(y, "genome_id", "left")


def log(spark, d) -> DataFrame:
    """The append log: genome_id, op (add, remove, update), value, generation."""
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("update")
    return load(spark, d, "events").select(F.col("user_id").alias("genome_id"), op.alias("op"), "value", "ts", F.col("event_id").alias("generation"))


# The same views for DuckDB, as common table expressions.
SQL = """
g AS (SELECT doc_id AS genome_id, 'DOC_' || doc_id AS accession, 'd__Corpus;f__' || lang || ';g__' || lang || '_' || source || ';s__' || lang || '_' || source || ' sp' AS taxonomy,
  'f__' || lang AS family, 'g__' || lang || '_' || source AS genus, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq, text FROM documents),
li AS (SELECT doc_id AS genome_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
ct AS (SELECT genome_id, unnest(range(len(lines)))::INT AS contig_index, lines FROM li),
contigs AS (SELECT genome_id, contig_index, 'DOC_' || genome_id || ':' || contig_index AS contig_acc, regexp_replace(upper(lines[contig_index + 1]), '[^ACGT]', '', 'g') AS seq FROM ct),
cat AS (SELECT g.genome_id, accession, taxonomy, family, genus, length(seq) AS genome_length, len(lines) AS n_contigs,
  floor(length(regexp_replace(seq, '[AT]', '', 'g')) * 10000 / nullif(length(seq), 0))::BIGINT AS gc_pct_x100, quality * 100.0::DOUBLE AS completeness, toxic * 100.0::DOUBLE AS contamination
  FROM g JOIN li USING (genome_id) LEFT JOIN labels l ON l.doc_id = g.genome_id),
log AS (SELECT user_id AS genome_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'update' END AS op, value, ts, event_id AS generation FROM events)
"""
