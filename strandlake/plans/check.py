"""Queries of the quality check's first pass, of sketch look-ups, orders and identities."""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as kx
from ..functions import scoring as sc
from ..operators import catalog as cat_ops
from ..operators import check as ops
from ..operators import taxonomy as tax_ops
from ..sources import views as v
from .catalog import TOMBS, removed
from .models import MUL, PREV, K, kmer_sets, oph_fingerprint
from .registry import ORACLES, query
from .taxonomy import PATHS

W = "WITH " + v.SQL
BINS, KS = 64, (8, 12, 16)


def check_members(spark, d):
    """genome_id, genus, species, genome_length: families stand for genera here, genera for species, so both levels have members."""
    return v.genomes(spark, d).select("genome_id", F.col("family").alias("genus"), F.col("genus").alias("species"), F.length("seq").cast("long").alias("genome_length"))


@query(W + ", m AS (SELECT genome_id, genus, length(seq) AS len FROM g), n AS (SELECT genus, count(*) AS members FROM m GROUP BY genus), p AS (SELECT genus, list_sort(list(len)) AS v FROM m WHERE len > 0 GROUP BY genus), q AS (SELECT genus, v[ceil(0.9 * len(v))::INT]::BIGINT AS p90_length FROM p) SELECT genome_id, genus, members, CASE WHEN length(genus) <= 3 THEN 'Singleton' WHEN members < 3 THEN 'GenusSparse' ELSE 'GenusSaturated' END AS tier, p90_length, CASE WHEN p90_length > 0 THEN round(least(greatest(len::DOUBLE / p90_length, 0), 1.5), 6) END AS length_ratio FROM m JOIN n USING (genus) LEFT JOIN q USING (genus)")
def support_tiers(spark, d):
    return ops.support_tiers(v.genomes(spark, d).select("genome_id", "genus", F.length("seq").cast("long").alias("genome_length"))).withColumn("length_ratio", F.round("length_ratio", 6))


@query()
def check_pass_a(spark, d):
    """The whole first pass over stored sketches of three k; species' models from 5 members on, else the genus'."""
    g = v.genomes(spark, d).select("genome_id", "seq")
    profiles = kx.doubles(v.genomes(spark, d).select(F.col("genome_id").alias("id"), F.col("family").alias("genus"), "seq"), "seq", kx.tnf, "tnf")
    return ops.pass_a(check_members(spark, d), ops.sketches(g, KS, BINS), profiles, BINS, least_members=5)


@query()
def model_lookup(spark, d):
    """Which model scores each genome, and in how many bins its sketch differs from it."""
    stored, members = ops.sketches(v.genomes(spark, d).select("genome_id", "seq"), (12,), BINS), check_members(spark, d)
    none = [F.lit(None).cast("double").alias(c) for c in ("p90", "median", "mad")]
    of = [ops.consensus_signatures(stored, members, level, BINS).select("*", *none) for level in ("species", "genus")]
    j = stored.join(ops.model_for(members, *of, 5), ["genome_id", "k"])
    return j.select("genome_id", "k", "level", "members", F.round((1 - ops.agreement("sig", "consensus")) * BINS).cast("int").alias("mismatches"))


@query()
def sketch_slices(spark, d):
    """Stored sketches of the labelled genomes, cut to fewer bins."""
    stored = ops.sketches(v.genomes(spark, d).select("genome_id", "seq"), (12, 16), BINS)
    ids = v.load(spark, d, "labels").select(F.col("doc_id").alias("genome_id"))
    return ops.sketch_slice(ops.sketch_scan(stored, ids, (12,)), 40)


@query("WITH x AS (SELECT l_orderkey, l_linenumber, 1 - l_discount AS c16, (1 - l_discount) * (1 - l_tax) AS c21, (1 - l_discount) * (1 - l_tax) * (1 - l_quantity / 100) AS c31 FROM lineitem), b AS (SELECT *, exp((16 * ln(c16) + 21 * ln(c21) + 31 * ln(c31)) / (16 * 16 + 21 * 21 + 31 * 31) * 31) AS e FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN least(c16, c21, c31) >= 0.01 THEN round(greatest(e - c31, 0) / greatest(e, 0.01), 6) END AS leakage FROM b")
def leakage_build(spark, d):
    """Leakage as it is stored when an archive is built: the fit takes in the largest k."""
    c16 = 1 - F.col("l_discount")
    c21 = c16 * (1 - F.col("l_tax"))
    c31 = c21 * (1 - F.col("l_quantity") / 100)
    return v.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.leakage_build([c16, c21, c31], [16, 21, 31]), 6).alias("leakage"))


@query(W + PREV + ", q AS (SELECT n_present, n_members, CASE WHEN n_members <= 1 OR n_present >= n_members THEN 255 WHEN n_present <= 1 THEN 0 ELSE least(greatest(floor(255.0 * ln(n_present) / ln(n_members) + 0.5), 1), 255) END::INT AS q FROM runs) SELECT n_present, n_members, q, round(CASE WHEN n_members <= 1 THEN 1.0 ELSE pow(n_members, q / 255.0 - 1.0) END, 6) AS prevalence, count(*) AS n_hashes FROM q GROUP BY 1, 2, 3")
def prevalence_bytes(spark, d):
    """Prevalence as a byte and back, by presence and members."""
    from ..operators import models

    p = models.prevalence(kmer_sets(spark, d, K), "genus").groupBy("n_present", "n_members").agg(F.count(F.lit(1)).alias("n_hashes"))
    q = p.withColumn("q", sc.quantised_prevalence(F.col("n_present"), F.col("n_members")))
    return q.withColumn("prevalence", F.round(sc.dequantised_prevalence(F.col("q"), F.col("n_members")), 6))


@query("SELECT l_orderkey, l_linenumber, (coalesce(CASE WHEN l_linestatus = 'O' THEN l_discount - 0.05 END > 0.02, false) OR coalesce(l_tax - 0.07 > 0, false) OR coalesce(CASE WHEN l_returnflag <> 'A' THEN l_quantity / 50 END < 0.7, false)) AS flagged, (coalesce(CASE WHEN l_linestatus = 'O' THEN l_discount - 0.05 END > 0.02, false) OR coalesce(CASE WHEN l_returnflag <> 'A' THEN l_quantity / 50 END < 0.7, false)) AS needs_full FROM lineitem")
def work_routing(spark, d):
    """Which genomes go to the contig scan: by leakage, composition or completeness."""
    c = F.col
    flagged, full = sc.needs_scan(F.when(c("l_linestatus") == "O", c("l_discount") - 0.05), c("l_tax") - 0.07, F.when(c("l_returnflag") != "A", c("l_quantity") / 50))
    return v.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flagged.alias("flagged"), full.alias("needs_full"))


@query("SELECT d.doc_id AS genome_id, (l.doc_id IS NULL OR l.quality IS NULL OR NOT coalesce(l.toxic = 0, false) OR d.doc_id % 7 = 0 OR d.doc_id % 11 = 0) AS stale FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_freshness(spark, d):
    """Genomes whose cached scores must be made again; the prior table lacks some genomes and some signals."""
    i = F.col("doc_id")
    prior = v.load(spark, d, "labels").select("doc_id", F.col("quality").alias("post_decontam"), (F.col("toxic") == 0).alias("scored"))
    j = v.load(spark, d, "documents").select("doc_id").join(prior, "doc_id", "left")
    return j.select(i.alias("genome_id"), sc.stale(F.col("post_decontam"), i % 7, i % 11, F.col("scored"), True, True).alias("stale"))


@query(W + ", " + TOMBS + f", fp AS (SELECT genome_id, CASE WHEN fingerprint < 0 THEN fingerprint::HUGEINT + 18446744073709551616 ELSE fingerprint::HUGEINT END AS u, fingerprint FROM ({ORACLES['oph_fingerprint']}) f) SELECT genome_id, fingerprint FROM fp WHERE u BETWEEN {1 << 52} AND {(1 << 63) + (1 << 60)} AND genome_id NOT IN (SELECT genome_id FROM tomb)")
def oph_range_scan(spark, d):
    """Live genomes whose fingerprint, as an unsigned number, lies in a range, in order of it."""
    return cat_ops.fingerprint_range(oph_fingerprint(spark, d), 1 << 52, (1 << 63) + (1 << 60), removed(spark, d))


MERGED = "p0 AS (SELECT doc_id AS genome_id, 'DOC_' || doc_id AS accession FROM documents WHERE lang <> 'de'), p1 AS (SELECT doc_id AS genome_id, 'DOC_' || doc_id AS accession FROM documents WHERE doc_id % 3 = 0 OR lang = 'de'), o AS (SELECT max(genome_id) + 1 AS o FROM p0)"


@query("WITH " + MERGED + " SELECT accession, 0 AS part_index, genome_id FROM p0 UNION ALL SELECT accession, 1, genome_id + o FROM p1, o WHERE accession NOT IN (SELECT accession FROM p0)")
def merge_index(spark, d):
    """The index of two merged archives that share accessions: the first part wins, ids of the second are shifted."""
    c = v.genomes(spark, d).select("genome_id", "accession", "family")
    parts = cat_ops.merge_archives(c.where("family <> 'f__de'"), c.where("genome_id % 3 = 0 OR family = 'f__de'"))
    return cat_ops.first_index(parts)


@query("WITH p AS (SELECT DISTINCT lang || '_' || source AS s, 0 AS part FROM documents WHERE lang <> 'de' UNION SELECT DISTINCT lang || '_' || source, 1 FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT source, 2 FROM documents) SELECT s AS name, min(part)::INT AS first_part, count(*) AS n_parts, row_number() OVER (ORDER BY encode(s)) - 1 AS position FROM p GROUP BY s")
def merge_strings(spark, d):
    """Sorted union of three lists of names."""
    docs = v.load(spark, d, "documents")
    name = F.concat_ws("_", "lang", "source").alias("name")
    return cat_ops.merge_strings([docs.where("lang <> 'de'").select(name), docs.where("doc_id % 3 = 0").select(name), docs.select(F.col("source").alias("name"))], "name")


@query(W + ', m AS (SELECT genome_id, contig_index, greatest(length(seq) - 3, 0) AS n FROM contigs), w AS (SELECT genome_id, contig_index, n, unnest(range(0, n // 64 + CASE WHEN n % 64 >= 32 THEN 1 ELSE 0 END)) AS win FROM m) SELECT genome_id, contig_index, win::INT AS "window", (win * 64)::BIGINT AS start, least(64, n - win * 64)::BIGINT AS n_mers FROM w')
def tumbling_windows(spark, d, size: int = 64):
    """Windows of `size` 4-mers side by side along each contig; what is left is one more if it is half a window."""
    n = F.greatest(F.length("seq") - 3, F.lit(0))
    c = v.contigs(spark, d).select("genome_id", "contig_index", n.cast("long").alias("n"))
    count = (F.floor(F.col("n") / size) + F.when(F.col("n") % size >= size / 2, 1).otherwise(0)).cast("int")
    w = c.where(count > 0).select("genome_id", "contig_index", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    start = F.col("window").cast("long") * size
    return w.select("genome_id", "contig_index", "window", start.alias("start"), F.least(F.lit(size), F.col("n") - start).alias("n_mers"))


@query(W + "SELECT genome_id, genus AS bucket, row_number() OVER (ORDER BY encode(genus), genome_id) AS position FROM g")
def manifest_order(spark, d):
    """The manifest sorted by genus bucket, rows of a bucket in the order of input; positions by counts of ranges."""
    return tax_ops.positions(v.genomes(spark, d).select("genome_id", F.col("genus").alias("bucket")), ["bucket", "genome_id"], "position")


MERS_4 = sorted({min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for m in map("".join, product("ACGT", repeat=4))})
DIRECTION = kx.projection_vector()
_DIRECTION_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in DIRECTION) + "]"
_MERS_SQL = "[" + ", ".join(f"'{m}'" for m in MERS_4) + "]"


@query(W + f", p AS (SELECT genome_id, unnest(range(1, length(seq) - 2)) AS i, seq FROM g WHERE length(seq) >= 4), m AS (SELECT genome_id, least(substr(seq, i, 4), reverse(translate(substr(seq, i, 4), 'ACGT', 'TGCA'))) AS mer FROM p), n AS (SELECT genome_id, mer, count(*) AS n FROM m GROUP BY genome_id, mer), t AS (SELECT genome_id, sqrt(sum(n * n)) AS size, sum(n * {_DIRECTION_SQL}[list_position({_MERS_SQL}, mer)]) AS dot FROM n GROUP BY genome_id) SELECT genome_id, round(dot / size, 6) AS projection FROM t")
def projection_order(spark, d):
    """Genomes in the order of their profiles along a fixed direction, so that like ones lie near each other."""
    p = kx.doubles(v.genomes(spark, d).select("genome_id", "seq"), "seq", kx.tnf, "tnf").where("tnf is not null")
    dot = F.aggregate(F.zip_with("tnf", F.array(*map(F.lit, DIRECTION)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return p.select("genome_id", dot.alias("exact")).orderBy("exact", "genome_id").select("genome_id", F.round("exact", 6).alias("projection"))


_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(path, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
CONCEPTS = PATHS + f", cid AS (SELECT path, {_FNV}::UBIGINT | 9223372036854775808::UBIGINT AS u FROM n)"


@query(W + CONCEPTS + " SELECT path, (u::HUGEINT - 18446744073709551616)::BIGINT AS concept_id FROM cid")
def concept_ids(spark, d):
    """Ids of lineage paths: a hash with the upper bit set, later paths moved on where hashes meet."""
    return tax_ops.concept_ids(tax_ops.tree_nodes(v.genomes(spark, d)).select("path"))


@query(W + CONCEPTS + " SELECT path, row_number() OVER (ORDER BY u) + 1 AS taxid FROM cid")
def renumbered_ids(spark, d):
    """Concept ids made dense in unsigned order; 1 is the root's."""
    ids = tax_ops.concept_ids(tax_ops.tree_nodes(v.genomes(spark, d)).select("path"))
    return tax_ops.positions(ids.withColumn("u", cat_ops.unsigned_order(F.col("concept_id"))), ["u"], "taxid").select("path", (F.col("taxid") + 1).alias("taxid"))


@query()
def ranked_lineages(spark, d):
    """Lineages of a taxonomy dump as ten ranks."""
    from ..functions.taxonomy import ranked_lineage

    docs = v.load(spark, d, "documents")
    step = lambda rank, name: F.struct(F.lit(rank).alias("rank"), name.alias("name"))
    i = F.col("doc_id")
    steps = F.array(step("no rank", F.lit("cellular organisms")), step("superkingdom", F.col("lang")), step("clade", F.when(i % 2 == 0, "SAR").otherwise("other")), step("family", F.col("source")), step("genus", F.when(i % 3 == 0, F.col("source"))), step("species", F.when(i % 5 == 0, F.concat("source", F.lit(" sp")))))
    lineage = F.filter(steps, lambda x: x["name"].isNotNull())
    return docs.select(i.alias("genome_id"), ranked_lineage(F.when(i % 7 == 0, F.slice(lineage, 1, 2)).otherwise(lineage), F.concat(F.lit("ACC_"), i)).alias("taxonomy"))


@query(W + ", c AS (SELECT genome_id, 'ACC_' || genome_id % 40 AS accession, md5(array_to_string(list_transform(list_sort(list_transform(lines, lambda x: upper(x))), lambda x: x || chr(10)), '')) AS content FROM li), f AS (SELECT accession, content, min(genome_id) AS first FROM c GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY first) AS i FROM f) SELECT genome_id, c.accession, k.accession || CASE WHEN i > 1 THEN '~dup' || i ELSE '' END AS resolved, CASE WHEN genome_id = first THEN 'keep' ELSE 'drop-exact-duplicate' END AS action FROM c JOIN k USING (accession, content)")
def accession_collisions(spark, d):
    """Files that share an accession: equal content is one genome, other content gets a numbered accession."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    content = F.md5(F.array_join(F.transform(F.array_sort(F.transform(lines, F.upper)), lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"))
    files = v.load(spark, d, "documents").select(F.col("doc_id").alias("genome_id"), F.concat(F.lit("ACC_"), F.col("doc_id") % 40).alias("accession"), content.alias("content"))
    return tax_ops.resolve_collisions(files, "genome_id").select("genome_id", "accession", "resolved", "action")


@query()
def content_digests(spark, d):
    """XXH3 of each genome's canonical content."""
    import pyarrow as pa

    c = v.load(spark, d, "documents").select(F.col("doc_id").alias("genome_id"), F.array_join(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), "\n").alias("lines"))
    return kx.with_kernel(c, "lines", lambda s: kx.xxh3_content(s.decode().split("\n")), "digest", "bigint", pa.int64()).select("genome_id", "digest")


GROUPS_6 = dict(zip(range(6), kx.DAYHOFF_6, strict=True))


@query("WITH a AS (SELECT doc_id, lang || '_' || source AS genus, substr(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 1, 60) AS seq FROM documents WHERE text IS NOT NULL), r AS (SELECT genus, arg_min(seq, doc_id) AS seq FROM a GROUP BY genus), c AS (SELECT i - 1 AS col, CASE " + " ".join(f"WHEN contains('{x}', substr(seq, i, 1)) THEN {k}" for k, x in enumerate(kx.DAYHOFF_6)) + " END AS cls FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM r)), n AS (SELECT col, cls, count(*) AS n FROM c WHERE cls IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY col) AS p FROM n) SELECT col::INT AS col, sum(n)::BIGINT AS n_observed, round(greatest((ln(6) + sum(p * ln(p))) / ln(6), 0), 6) AS information FROM t GROUP BY col")
def column_information(spark, d):
    """Information of alignment columns over reduced residues, one representative a genus."""
    a = v.load(spark, d, "documents").where("text is not null").select("doc_id", F.concat_ws("_", "lang", "source").alias("genus"), F.substring(F.translate("text", ascii_lowercase, ascii_uppercase), 1, 60).alias("seq"))
    return ops.column_information(a, "genus", "doc_id").withColumn("information", F.round("information", 6))
