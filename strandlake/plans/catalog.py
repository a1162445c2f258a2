"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..operators.taxonomy import positions
from ..sources import views as v
from .registry import query

W = "WITH " + v.SQL
TOMBS = "tomb AS (SELECT DISTINCT genome_id FROM log WHERE op = 'remove')"


def removed(spark, d):
    return v.log(spark, d).where("op = 'remove'").select("genome_id").distinct()


@query(W + "SELECT count(*) AS n_total, sum(genome_length)::BIGINT AS total_bp, sum(n_contigs)::BIGINT AS n_contigs, round(avg(completeness), 6) AS mean_completeness, round(avg(contamination), 6) AS mean_contamination, round(avg(gc_pct_x100), 6) AS mean_gc FROM cat")
def catalog_stats(spark, d):
    return v.catalog(spark, d).agg(F.count(F.lit(1)).alias("n_total"), F.sum("genome_length").alias("total_bp"), F.sum("n_contigs").alias("n_contigs"), F.round(F.avg("completeness"), 6).alias("mean_completeness"), F.round(F.avg("contamination"), 6).alias("mean_contamination"), F.round(F.avg("gc_pct_x100"), 6).alias("mean_gc"))


@query(W + "SELECT genome_id, accession, genome_length, n_contigs, completeness, contamination FROM cat WHERE floor(completeness::FLOAT * 10) >= 900 AND floor(contamination::FLOAT * 10) <= 50 AND genome_length BETWEEN 100 AND 5000 AND n_contigs <= 40")
def catalog_filter(spark, d):
    q = ops.ExtractQuery(min_completeness=90.0, max_contamination=5.0, min_length=100, max_length=5000, max_contigs=40)
    return ops.extract(v.catalog(spark, d), q).select("genome_id", "accession", "genome_length", "n_contigs", "completeness", "contamination")


@query(W + ", " + TOMBS + " SELECT genome_id, accession, genome_length FROM cat WHERE genome_length >= 100 AND genome_id NOT IN (SELECT genome_id FROM tomb) ORDER BY genome_id LIMIT 100")
def extract_limit(spark, d):
    """The limit is the feature: first 100 live genomes that pass, deletions taken out before it."""
    q = ops.ExtractQuery(min_length=100, limit=100)
    return ops.extract(v.catalog(spark, d), q, removed(spark, d)).select("genome_id", "accession", "genome_length")


@query("WITH " + v.SQL + ", acc AS (SELECT 'DOC_' || doc_id AS accession FROM labels WHERE toxic = 1) SELECT genome_id, accession, genome_length FROM cat WHERE accession IN (SELECT accession FROM acc)")
def extract_accessions(spark, d):
    wanted = v.load(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("DOC_"), "doc_id").alias("accession"))
    return ops.extract(v.catalog(spark, d), ops.ExtractQuery(min_length=10**9, accessions=wanted)).select("genome_id", "accession", "genome_length")


@query(W + "SELECT genome_id, arg_max(op, generation) AS op, round(arg_max(value, generation), 6) AS value, max(generation) AS generation FROM log GROUP BY genome_id")
def catalog_newest_wins(spark, d):
    return ops.newest(v.log(spark, d).drop("ts")).select("genome_id", "op", F.round("value", 6).alias("value"), "generation")


@query(W + ", " + TOMBS + " SELECT genome_id, accession, genus FROM cat WHERE genome_id NOT IN (SELECT genome_id FROM tomb)")
def tombstone_anti(spark, d):
    return ops.live(v.catalog(spark, d), removed(spark, d)).select("genome_id", "accession", "genus")


@query(W + "SELECT l.ordinal, l.accession, c.genome_id, c.genome_length FROM (SELECT event_id AS ordinal, 'DOC_' || user_id AS accession FROM events) l LEFT JOIN cat c USING (accession)")
def accession_lookup_batch(spark, d):
    asked = v.load(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("DOC_"), "user_id").alias("accession"))
    return ops.lookup(asked, v.catalog(spark, d), "accession", ["genome_id", "genome_length"]).select("ordinal", "accession", "genome_id", "genome_length")


@query(W + "SELECT o.ordinal, o.contig_acc, coalesce(c.genome_id, -1)::BIGINT AS genome_id FROM (SELECT event_id AS ordinal, 'DOC_' || user_id || ':' || (event_id % 12) AS contig_acc FROM events) o LEFT JOIN contigs c USING (contig_acc)")
def contig_lookup_batch(spark, d):
    asked = v.load(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("DOC_"), "user_id", F.lit(":"), (F.col("event_id") % 12)).alias("contig_acc"))
    return ops.lookup(asked, v.contigs(spark, d), "contig_acc", ["genome_id"]).select("ordinal", "contig_acc", F.coalesce("genome_id", F.lit(-1)).cast("long").alias("genome_id"))


@query(W + "SELECT e.event_id, e.user_id AS genome_id, CASE WHEN g.seq IS NULL THEN NULL WHEN e.event_id % 50 = 0 OR (e.event_id % 700) >= length(g.seq) THEN '' ELSE substr(g.seq, e.event_id % 700 + 1, e.event_id % 50) END AS slice FROM events e LEFT JOIN g ON g.genome_id = e.user_id")
def sequence_slice(spark, d):
    e = v.load(spark, d, "events").select("event_id", F.col("user_id").alias("genome_id"))
    start, size = F.col("event_id") % 700, F.col("event_id") % 50
    j = e.join(v.genomes(spark, d).select("genome_id", "seq"), "genome_id", "left")
    return j.select("event_id", "genome_id", F.when(F.col("seq").isNotNull(), ops.sequence_slice(F.col("seq"), start, size)).alias("slice"))


@query(W + "SELECT genome_id, md5(string_agg(seq, 'NNNNNNNNNN' ORDER BY contig_index)) AS joined_md5, (sum(length(seq)) + 10 * (count(*) - 1))::BIGINT AS joined_length FROM contigs GROUP BY genome_id")
def concat_contigs(spark, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contig_index", "seq"))), lambda x: x.seq), "N" * 10)
    c = v.contigs(spark, d).groupBy("genome_id").agg(joined.alias("joined"))
    return c.select("genome_id", F.md5(F.col("joined").cast("binary")).alias("joined_md5"), F.length("joined").cast("long").alias("joined_length"))


@query("WITH t AS (SELECT doc_id AS genome_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents), s AS (SELECT genome_id, string_split_regex(seq, 'N+') AS parts, regexp_extract_all(seq, 'N+') AS gaps FROM t), u AS (SELECT genome_id, unnest(range(1, len(parts) + 1)) AS i, parts, gaps FROM s), r AS (SELECT genome_id, i, length(parts[i]) AS len, coalesce(length(gaps[i]), 0) AS gap FROM u), c AS (SELECT *, coalesce(sum(len + gap) OVER (PARTITION BY genome_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, coalesce(sum(gap) OVER (PARTITION BY genome_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM r) SELECT genome_id, start, len::BIGINT AS len, n_before FROM c WHERE len > 0")
def nmask_segments(spark, d):
    """Stretches without N: start, length, Ns before."""
    seq = F.regexp_replace(F.upper("text"), "[^ACGTN]", "")
    t = v.load(spark, d, "documents").select(F.col("doc_id").alias("genome_id"), F.split(seq, "N+", -1).alias("parts"), F.regexp_extract_all(seq, F.lit("N+"), F.lit(0)).alias("gaps"))
    t = t.select("genome_id", F.posexplode(F.arrays_zip(F.transform("parts", F.length).alias("len"), F.transform("gaps", F.length).alias("gap"))).alias("i", "x")).select("genome_id", "i", "x.len", F.coalesce("x.gap", F.lit(0)).alias("gap"))
    before = Window.partitionBy("genome_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("start", F.coalesce(F.sum(F.col("len") + F.col("gap")).over(before), F.lit(0))).withColumn("n_before", F.coalesce(F.sum("gap").over(before), F.lit(0)))
    return t.where("len > 0").select("genome_id", "start", F.col("len").cast("long").alias("len"), "n_before")


@query(W + ", r AS (SELECT c.genome_id, md5(g.seq) AS content, c.genome_length, completeness, row_number() OVER (PARTITION BY md5(g.seq), c.genome_length ORDER BY completeness DESC NULLS LAST, c.genome_id) AS rank FROM cat c JOIN g USING (genome_id)) SELECT genome_id, content, genome_length, rank::INT AS rank FROM r WHERE rank > 1")
def dedup_groups(spark, d):
    c = v.catalog(spark, d).join(v.genomes(spark, d).select("genome_id", F.md5(F.col("seq").cast("binary")).alias("content")), "genome_id")
    return ops.duplicate_groups(c, ["content", "genome_length"]).select("genome_id", "content", "genome_length", "rank")


@query(W + ", k AS (SELECT c.genome_id, accession, md5(g.seq) AS content, c.genome_length, completeness, family FROM cat c JOIN g USING (genome_id, accession, family)), e AS (SELECT * FROM k WHERE family = 'f__en'), b AS (SELECT * FROM k WHERE accession NOT IN (SELECT accession FROM e) AND (content, genome_length) NOT IN (SELECT content, genome_length FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY content, genome_length ORDER BY completeness DESC NULLS LAST, genome_id) AS rk FROM b) SELECT genome_id, accession, genome_length FROM r WHERE rk = 1")
def append_dedup(spark, d):
    """All genomes are added to an archive that holds one family."""
    g = v.genomes(spark, d).select("genome_id", F.md5(F.col("seq").cast("binary")).alias("content"))
    c = v.catalog(spark, d).join(g, "genome_id")
    return ops.append(c.where("family = 'f__en'"), c, ["content", "genome_length"]).select("genome_id", "accession", "genome_length")


@query(W + "SELECT genome_id, contig_index, length(seq) AS contig_length FROM contigs WHERE genome_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_semi(spark, d):
    keep = v.load(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("genome_id"))
    return v.contigs(spark, d).join(keep, "genome_id", "left_semi").select("genome_id", "contig_index", F.length("seq").cast("long").alias("contig_length"))


@query(W + ", m AS (SELECT max(genome_id) + 1 AS o FROM cat WHERE family <> 'f__de') SELECT genome_id, accession, 0 AS part_index FROM cat WHERE family <> 'f__de' UNION ALL SELECT genome_id + o, accession, 1 FROM cat, m WHERE family = 'f__de'")
def merge_parts(spark, d):
    c = v.catalog(spark, d).select("genome_id", "accession", "family")
    return ops.merge_archives(c.where("family <> 'f__de'"), c.where("family = 'f__de'")).select("genome_id", "accession", "part_index")


@query(W + ", " + TOMBS + " SELECT family, count(*) AS n_genomes, count(*) FILTER (genome_id NOT IN (SELECT genome_id FROM tomb)) AS n_live, coalesce(sum(genome_length) FILTER (genome_id NOT IN (SELECT genome_id FROM tomb)), 0)::BIGINT AS live_bp FROM cat GROUP BY family")
def archive_stats(spark, d):
    t = removed(spark, d).withColumn("gone", F.lit(True))
    c = v.catalog(spark, d).join(t, "genome_id", "left")
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("n_genomes"), F.count_if(F.col("gone").isNull()).alias("n_live"), F.coalesce(F.sum(F.when(F.col("gone").isNull(), F.col("genome_length"))), F.lit(0)).alias("live_bp"))


@query(W + "SELECT genome_id, genus, row_number() OVER (PARTITION BY genus ORDER BY genome_length, genome_id)::INT AS position FROM cat")
def repack_order(spark, d):
    """Order within each taxon's shard after re-sharding: places in the order of all rows, less those before the taxon."""
    placed = positions(v.catalog(spark, d).select("genome_id", "genus", "genome_length"), ["genus", "genome_length", "genome_id"], "at")
    before = placed.groupBy("genus").agg((F.min("at") - 1).alias("before"))
    return placed.join(before, "genus").select("genome_id", "genus", (F.col("at") - F.col("before")).cast("int").alias("position"))


@query(W + "SELECT genome_id, contig_index, length(seq)::BIGINT AS contig_length, coalesce(sum(length(seq)) OVER (PARTITION BY genome_id ORDER BY contig_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS contig_offset FROM contigs")
def contig_offsets(spark, d):
    w = Window.partitionBy("genome_id").orderBy("contig_index").rowsBetween(Window.unboundedPreceding, -1)
    c = v.contigs(spark, d).select("genome_id", "contig_index", F.length("seq").cast("long").alias("contig_length"))
    return c.withColumn("contig_offset", F.coalesce(F.sum("contig_length").over(w), F.lit(0)))


@query(W + ", r AS (SELECT genome_id, contig_index, length(seq)::BIGINT AS contig_length, row_number() OVER (PARTITION BY genome_id ORDER BY length(seq) DESC, contig_index) AS rk FROM contigs) SELECT genome_id, contig_index, contig_length, rk::INT AS rk FROM r WHERE rk <= 30")
def longest_contigs(spark, d):
    """The 30 longest contigs of each genome (the limit is the operator's)."""
    w = Window.partitionBy("genome_id").orderBy(F.col("contig_length").desc(), "contig_index")
    return v.contigs(spark, d).select("genome_id", "contig_index", F.length("seq").cast("long").alias("contig_length")).withColumn("rk", F.row_number().over(w)).where("rk <= 30")


@query(W + ", a AS (SELECT DISTINCT genus FROM cat WHERE completeness = 100), b AS (SELECT DISTINCT genus FROM cat WHERE contamination = 100) SELECT 'both' AS side, genus FROM (SELECT genus FROM a INTERSECT SELECT genus FROM b) UNION ALL SELECT 'complete_only', genus FROM (SELECT genus FROM a EXCEPT SELECT genus FROM b) UNION ALL SELECT 'contaminated_only', genus FROM (SELECT genus FROM b EXCEPT SELECT genus FROM a)")
def genus_set_operations(spark, d):
    c = v.catalog(spark, d)
    a, b = c.where("completeness = 100").select("genus"), c.where("contamination = 100").select("genus")
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "genus")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "complete_only")).unionByName(tag(b.subtract(a), "contaminated_only"))


@query(W + "SELECT CASE WHEN grouping(family) = 0 THEN family ELSE genus END AS taxon, CASE WHEN grouping(family) = 0 THEN 'family' ELSE 'genus' END AS level, count(*) AS n, sum(genome_length)::BIGINT AS bp FROM cat GROUP BY GROUPING SETS ((family), (genus))")
def family_and_genus_totals(spark, d):
    c = v.catalog(spark, d)
    g = c.groupingSets([[F.col("family")], [F.col("genus")]], "family", "genus").agg(F.grouping("family").alias("no_family"), F.count(F.lit(1)).alias("n"), F.sum("genome_length").alias("bp"))
    of_family = F.col("no_family") == 0
    return g.select(F.when(of_family, F.col("family")).otherwise(F.col("genus")).alias("taxon"), F.when(of_family, "family").otherwise("genus").alias("level"), "n", "bp")


@query(W + "SELECT to_json({'n': count(*), 'bp': sum(genome_length)::BIGINT, 'contigs': sum(n_contigs)::BIGINT})::VARCHAR AS stat FROM cat")
def stat_json(spark, d):
    c = v.catalog(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("genome_length").alias("bp"), F.sum("n_contigs").alias("contigs"))
    return c.select(F.to_json(F.struct("n", "bp", "contigs")).alias("stat"))


@query("SELECT page_id, length(html)::BIGINT AS n_chars, len(string_split(html, '<p>'))::BIGINT - 1 AS n_paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def raw_text_parse(spark, d):
    return v.load(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n_chars"), (F.size(F.split("html", "<p>", -1)) - 1).cast("long").alias("n_paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("WITH e AS (SELECT user_id, event_type, ts, event_id FROM events) SELECT user_id AS genome_id, date_diff('day', DATE '2024-01-01', max(ts)::DATE)::BIGINT AS date_added, count(*) AS n FROM e GROUP BY user_id")
def days_since_epoch(spark, d):
    """Dates are days since 2024-01-01."""
    e = v.load(spark, d, "events").groupBy(F.col("user_id").alias("genome_id")).agg(F.max("ts").alias("t"), F.count(F.lit(1)).alias("n"))
    return e.select("genome_id", F.datediff(F.to_date("t"), F.lit("2024-01-01").cast("date")).cast("long").alias("date_added"), "n")
