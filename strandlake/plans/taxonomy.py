"""Taxonomy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as fx
from ..operators import taxonomy as ops
from ..sources import views as v
from .registry import query

W = "WITH " + v.SQL
PATHS = ", t AS (SELECT DISTINCT string_split(taxonomy, ';') AS t FROM g), u AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM t), n AS (SELECT DISTINCT array_to_string(t[1:i], ';') AS path, CASE WHEN i > 1 THEN array_to_string(t[1:i-1], ';') END AS parent_path, substr(t[i], 1, 1) AS rank, substr(t[i], 4) AS name, (i - 1)::INT AS depth FROM u)"
# region, nation, customer, order as one tree of four ranks
EDGES = "e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"


def edges(spark, d):
    load = lambda t, node, parent: v.load(spark, d, t).select(node.alias("node"), parent.alias("parent"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    return (
        load("region", key("r", "r_regionkey"), F.lit(None).cast("string"))
        .unionByName(load("nation", key("n", "n_nationkey"), key("r", "n_regionkey")))
        .unionByName(load("customer", key("c", "c_custkey"), key("n", "c_nationkey")))
        .unionByName(load("orders", key("o", "o_orderkey"), key("c", "o_custkey")))
    )


@query(W + "SELECT genome_id, regexp_extract(taxonomy, '(?:^|;)(g__[^;]*)', 1) AS genus_token, regexp_extract(taxonomy, '(?:^|;)(s__[^;]*)', 1) AS species_token, CASE WHEN length(regexp_extract(taxonomy, '(?:^|;)(o__[^;]*)', 1)) > 3 THEN regexp_extract(taxonomy, '(?:^|;)(o__[^;]*)', 1) END AS order_token FROM g")
def rank_extract(spark, d):
    t = F.col("taxonomy")
    return v.genomes(spark, d).select("genome_id", fx.rank_token(t, "g").alias("genus_token"), fx.rank_token(t, "s").alias("species_token"), fx.rank_token(t, "o").alias("order_token"))


# lineages with missing and bare ranks, of the ten-rank form, and none at all, by id
ODD = "odd AS (SELECT doc_id AS genome_id, CASE doc_id % 3 WHEN 0 THEN 'RS_GCF_' || doc_id || '.1' WHEN 1 THEN 'GCA_' || doc_id || '.2.b' ELSE 'DOC_' || doc_id || '.7' END AS acc, CASE doc_id % 8 WHEN 0 THEN 'd__X;p__P;f__' || lang || ';g__' || source || ';s__' || source || ' sp' WHEN 1 THEN 'd__X;c__;f__' || lang || ';g__' || source WHEN 2 THEN 'd__X;f__' || lang || ';g__;s__' WHEN 3 THEN 'd__X;l__L;k__K;p__;f__' || lang || ';s__x' WHEN 4 THEN '' WHEN 5 THEN 'd__X;c__' || source WHEN 6 THEN 'd__X;f__;s__' || lang ELSE 'g__' || source || ';d__X' END AS tax FROM documents)"


def odd_lineages(spark, d):
    """genome_id, acc, tax."""
    i, f, g = F.col("doc_id"), F.concat(F.lit(";f__"), "lang"), F.concat(F.lit(";g__"), "source")
    acc = F.when(i % 3 == 0, F.concat(F.lit("RS_GCF_"), i, F.lit(".1"))).when(i % 3 == 1, F.concat(F.lit("GCA_"), i, F.lit(".2.b"))).otherwise(F.concat(F.lit("DOC_"), i, F.lit(".7")))
    forms = [
        F.concat(F.lit("d__X;p__P"), f, g, F.lit(";s__"), "source", F.lit(" sp")), F.concat(F.lit("d__X;c__"), f, g), F.concat(F.lit("d__X"), f, F.lit(";g__;s__")),
        F.concat(F.lit("d__X;l__L;k__K;p__"), f, F.lit(";s__x")), F.lit(""), F.concat(F.lit("d__X;c__"), "source"), F.concat(F.lit("d__X;f__;s__"), "lang"), F.concat(F.lit("g__"), "source", F.lit(";d__X")),
    ]
    return v.load(spark, d, "documents").select(i.alias("genome_id"), acc.alias("acc"), F.element_at(F.array(*forms), (i % 8 + 1).cast("int")).alias("tax"))


def _bucket_sql(bare: str) -> str:
    """The first rank of g, f, o, c whose prefix is in the string, and the string from there to the next semicolon."""
    hit = lambda p: f"strpos(tax, '{p}__') > 0 THEN string_split(substr(tax, strpos(tax, '{p}__')), ';')[1]"
    return f"CASE {' '.join('WHEN ' + hit(p) for p in 'gfoc')} ELSE '' END AS t{bare}"


@query("WITH " + ODD + f", x AS (SELECT genome_id, {_bucket_sql('')} FROM odd) SELECT genome_id, CASE WHEN length(t) > 3 THEN t ELSE '__unclassified__' END AS bucket, CASE WHEN t <> '' THEN t ELSE '__unclassified__' END AS repack_bucket FROM x")
def taxon_bucket(spark, d):
    """Genus bucket with fallback, as appending has it and as re-sharding has it."""
    t = F.col("tax")
    return odd_lineages(spark, d).select("genome_id", fx.taxon_bucket(t).alias("bucket"), fx.taxon_bucket(t, keep_bare=True).alias("repack_bucket"))


_TOKEN = "coalesce(list_filter(t, lambda x: x[1:3] = '{r}__')[1][4:], '')"


@query(
    "WITH " + ODD + ", s AS (SELECT *, string_split(tax, ';') AS t, regexp_replace(acc, '^(RS|GB)_', '') AS a FROM odd), n0 AS (SELECT genome_id, tax, CASE WHEN a[1:4] IN ('GCF_', 'GCA_') THEN regexp_replace(a, '[.][^.]*$', '') ELSE a END AS stem, "
    + ", ".join(f"{_TOKEN.format(r=r)} AS {n}" for n, r in zip(("d0", "l0", "k0", "p0", "c0", "o0", "f0", "g0", "s0"), "dlkpcofgs", strict=True))
    + " FROM s)"
    + "".join(f", n{i} AS (SELECT *, CASE WHEN {r}0 = '' THEN {up} ELSE {r}0 END AS {r}1 FROM n{i - 1})" for i, (r, up) in enumerate(zip("lkpcofg", ("d0", "l1", "k1", "p1", "c1", "o1", "f1"), strict=True), 1))
    + ", e AS (SELECT *, CASE WHEN s0 = '' THEN stem ELSE s0 END AS s1 FROM n7) SELECT genome_id, CASE WHEN tax LIKE 'l\\_\\_%' ESCAPE '\\' OR contains(tax, ';l__') THEN tax ELSE 'd__' || d0 || ';l__' || l1 || ';k__' || k1 || ';p__' || p1 || ';c__' || c1 || ';o__' || o1 || ';f__' || f1 || ';g__' || g1 || ';s__' || s1 || ';S__' || s1 END AS taxonomy FROM e"
)
def tax_normalize_10rank(spark, d):
    return odd_lineages(spark, d).select("genome_id", fx.ten_ranks(F.col("tax"), F.col("acc")).alias("taxonomy"))


FILLED = (
    "WITH " + ODD + ", e AS (SELECT acc, list_filter(string_split(tax, ';'), lambda x: regexp_matches(x, '^[dlkpcofgs]__')) AS tk FROM odd), w AS (SELECT bool_or(len(list_filter(tk, lambda x: x[1] IN ('l', 'k'))) > 0) AS whole FROM e), "
    "n AS (SELECT acc, whole, list_filter(tk, lambda x: length(x) > 3) AS nm FROM e, w), a AS (SELECT acc, whole, nm, array_to_string(nm, ';') AS upto, coalesce(nm[-1][4:], '') AS anchor, coalesce(strpos('dlkpcofgs', nm[-1][1]), 1) AS deep FROM n), "
    "own AS (SELECT acc, i - 100 AS o, array_to_string(nm[1:i], ';') AS path, CASE WHEN i > 1 THEN array_to_string(nm[1:i-1], ';') ELSE 'root' END AS parent_path, nm[i][1] AS rank, nm[i][4:] AS name, false AS synthetic, false AS per_accession FROM (SELECT acc, nm, unnest(range(1, len(nm) + 1)) AS i FROM a)), "
    "b AS (SELECT acc, upto, p, 'dlkpcofgs'[p] AS rank, CASE WHEN p = 9 THEN 's__[' || anchor || ' sp. ' || acc || ']' ELSE 'dlkpcofgs'[p] || '__[unclassified ' || anchor || ']' END AS name FROM (SELECT *, unnest(range(1, 10)) AS p FROM a) WHERE p > deep AND (whole OR p NOT IN (2, 3))), "
    "made AS (SELECT acc, p AS o, upto || ';' || name AS path, coalesce(upto || ';' || lag(name) OVER (PARTITION BY acc ORDER BY p), CASE WHEN upto = '' THEN 'root' ELSE upto END) AS parent_path, rank, name, p <> 9 AS synthetic, p = 9 AS per_accession FROM b), al AS (SELECT * FROM own UNION ALL SELECT * FROM made)"
)


@query(FILLED + " SELECT DISTINCT path, parent_path, rank, name, synthetic, per_accession FROM al UNION ALL SELECT 'root', 'root', 'no rank', 'root', false, false")
def tax_tree_filled(spark, d):
    """Nodes of the tree with synthetic ranks down to the species."""
    return ops.filled_tree(ops.filled_lineages(odd_lineages(spark, d).select(F.col("acc").alias("accession"), F.col("tax").alias("lineage"))))


@query(FILLED + " SELECT acc AS accession, arg_max(path, o) AS path FROM al GROUP BY acc")
def tax_accession_leaves(spark, d):
    """The node that each accession hangs on."""
    filled = ops.filled_lineages(odd_lineages(spark, d).select(F.col("acc").alias("accession"), F.col("tax").alias("lineage")))
    return filled.select("accession", F.element_at("nodes", -1)["path"].alias("path"))


@query(W + PATHS + " SELECT * FROM n")
def tax_tree_nodes(spark, d):
    return ops.tree_nodes(v.genomes(spark, d))


@query(W + PATHS + " SELECT path, row_number() OVER (ORDER BY encode(path)) AS taxid FROM n")
def tax_dense_ids(spark, d):
    return ops.dense_ids(ops.tree_nodes(v.genomes(spark, d)))


@query("WITH RECURSIVE " + EDGES + ", up(node, ancestor, steps) AS (SELECT node, node, 0 FROM e UNION ALL SELECT up.node, e.parent, up.steps + 1 FROM up JOIN e ON up.ancestor = e.node WHERE e.parent IS NOT NULL) SELECT node, ancestor, steps FROM up WHERE ancestor LIKE 'r%'")
def tax_ancestor(spark, d):
    """The ancestor of the top rank of every node."""
    return ops.closure(edges(spark, d)).where("ancestor LIKE 'r%'")


@query("WITH RECURSIVE " + EDGES + ", up(node, ancestor, steps) AS (SELECT node, node, 0 FROM e WHERE node NOT LIKE 'o%' UNION ALL SELECT up.node, e.parent, up.steps + 1 FROM up JOIN e ON up.ancestor = e.node WHERE e.parent IS NOT NULL), p AS (SELECT 'c' || c_custkey AS a, 'n' || n_nationkey AS b FROM customer JOIN nation ON n_nationkey <> c_nationkey AND n_regionkey = c_custkey % 5), j AS (SELECT a, b, x.ancestor, x.steps FROM p JOIN up x ON x.node = a JOIN up y ON y.node = b AND x.ancestor = y.ancestor) SELECT a, b, arg_min(ancestor, steps) AS lca FROM j GROUP BY a, b")
def tax_lca(spark, d):
    c = v.load(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("k"))
    n = v.load(spark, d, "nation")
    pairs = c.join(n, (F.col("n_regionkey") == F.col("k")) & (F.col("n_nationkey") != F.col("c_nationkey"))).select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return ops.lowest_common(ops.closure(edges(spark, d).where("node NOT LIKE 'o%'")), pairs)


SIDES = "cur AS (SELECT CASE WHEN lang = 'de' THEN 'GCA_' ELSE 'DOC_' END || doc_id AS accession, lang || '_' || source AS species FROM documents), rel AS (SELECT 'DOC_' || doc_id AS accession, CASE WHEN toxic = 1 THEN 'moved' ELSE (SELECT lang || '_' || source FROM documents x WHERE x.doc_id = labels.doc_id) END AS species FROM labels UNION ALL SELECT 'NEW_' || page_id, 'new' FROM pages)"


@query("WITH " + SIDES + ", ks AS (SELECT DISTINCT species FROM rel) SELECT coalesce(c.accession, r.accession) AS accession, CASE WHEN c.accession IS NULL THEN 'new_in_release' WHEN c.species = r.species THEN 'unchanged' WHEN r.accession IS NOT NULL THEN 'taxonomy_changed' WHEN regexp_matches(c.accession, '^GC[FA]_') THEN 'dropped' WHEN c.species IN (SELECT species FROM ks) THEN 'custom_stable' ELSE 'needs_gtdbtk' END AS class FROM cur c FULL JOIN rel r ON c.accession = r.accession")
def tax_diff(spark, d):
    docs = v.load(spark, d, "documents").select("doc_id", "lang", F.concat_ws("_", "lang", "source").alias("species"))
    current = docs.select(F.concat(F.when(F.col("lang") == "de", "GCA_").otherwise("DOC_"), "doc_id").alias("accession"), "species")
    y = v.load(spark, d, "labels").join(docs, "doc_id", "left")
    release = y.select(F.concat(F.lit("DOC_"), "doc_id").alias("accession"), F.when(F.col("toxic") == 1, "moved").otherwise(F.col("species")).alias("species"))
    pages = v.load(spark, d, "pages").select(F.concat(F.lit("NEW_"), "page_id").alias("accession"), F.lit("new").alias("species"))
    return ops.difference(current, release.unionByName(pages))


@query(W + "SELECT g.accession, CASE WHEN l.toxic = 1 THEN 'd__Corpus;f__quarantine' ELSE g.taxonomy END AS taxonomy FROM g LEFT JOIN labels l ON l.doc_id = g.genome_id")
def tax_patch(spark, d):
    changes = v.load(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("DOC_"), "doc_id").alias("accession"), F.lit("d__Corpus;f__quarantine").alias("taxonomy"))
    return ops.patch(v.genomes(spark, d).select("accession", "taxonomy"), changes)


@query(W + PATHS + " SELECT rank, count(*) AS n_taxa, (SELECT count(*) FROM g) AS n_accessions FROM n GROUP BY rank")
def tax_summary(spark, d):
    g = v.genomes(spark, d).select("accession", "taxonomy")
    total = g.agg(F.count(F.lit(1)).alias("n_accessions"))  # one row
    return ops.tree_nodes(g).groupBy("rank").agg(F.count(F.lit(1)).alias("n_taxa")).crossJoin(F.broadcast(total))


@query(W + PATHS + " SELECT path || chr(9) || '|' || chr(9) || coalesce(parent_path, 'root') || chr(9) || '|' || chr(9) || rank || chr(9) || '|' AS line FROM n")
def taxdump_nodes(spark, d):
    tab = "\t|\t"
    n = ops.tree_nodes(v.genomes(spark, d))
    return n.select(F.concat(F.concat_ws(tab, "path", F.coalesce("parent_path", F.lit("root")), "rank"), F.lit("\t|")).alias("line"))


@query()
def tax_partition_lpt(spark, d):
    """Largest taxon first to the least loaded of eight parts; taxon totals come to the driver."""
    c = v.catalog(spark, d)
    sizes = [(r.genus, r.n) for r in c.groupBy("genus").agg(F.count(F.lit(1)).alias("n")).collect()]
    parts = spark.createDataFrame(sorted(ops.balanced_parts(sizes, 8).items()), "genus string, part int")
    return c.join(F.broadcast(parts), "genus").groupBy("part").agg(F.count(F.lit(1)).alias("n_genomes"), F.countDistinct("genus").alias("n_taxa"))


@query("SELECT url, regexp_replace(regexp_replace(url, '^https?://', ''), '([.](gz|fasta|fna|faa|fa))+$', '') AS stripped FROM pages")
def strip_extensions(spark, d):
    return v.load(spark, d, "pages").select("url", fx.strip_extensions(F.regexp_replace("url", "^https?://", "")).alias("stripped"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'nuclear' WHEN 'click' THEN 'plasmid' WHEN 'purchase' THEN 'virus' WHEN 'error' THEN 'mitochondrion' ELSE 'plastid' END AS genome_type, CASE WHEN value IS NULL THEN 'NA' ELSE printf('%.4f', value) END AS shown FROM events")
def genome_type_and_format(spark, d):
    alias = {"view": "chromosome", "click": "plasmid", "purchase": "viral", "error": "mt"}
    e = F.col("event_type")
    given = F
    for k, x in alias.items():
        given = given.when(e == k, x)
    return v.load(spark, d, "events").select("event_id", fx.genome_type(given.otherwise("cp")).alias("genome_type"), fx.shown(F.col("value")).alias("shown"))
