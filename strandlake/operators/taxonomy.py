"""Taxonomy trees as adjacency tables: building, closure, common ancestors, difference, patch, dense ids, balanced parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import with_fnv1a_64

MAX_DEPTH = 40


def tree_nodes(lineages: DataFrame, column: str = "taxonomy") -> DataFrame:
    """Distinct nodes of lineage strings: path, parent_path, rank, name, depth."""
    t = lineages.select(F.split(column, ";").alias("t")).distinct()
    t = t.select(F.posexplode("t").alias("depth", "token"), "t")
    path = F.array_join(F.slice("t", F.lit(1), F.col("depth") + 1), ";")
    parent = F.when(F.col("depth") > 0, F.array_join(F.slice("t", F.lit(1), F.col("depth")), ";"))
    return t.select(path.alias("path"), parent.alias("parent_path"), F.substring("token", 1, 1).alias("rank"), F.substring("token", 4, 1 << 20).alias("name"), "depth").distinct()


#: Ranks from the top, by prefix; the second and third are filled only where some lineage has one of them (fixed values).
RANKS = "dlkpcofgs"


def _fnv1a_32(text: F.Column) -> F.Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as eight hexadecimal digits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def filled_lineages(entries: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(accession, lineage) -> accession, nodes: its path from the top as structs of path, parent_path, rank, name, synthetic and
    per_accession, down to a species.

    Tokens without a known rank or without a name are left out. Each rank below the last named token gets a synthetic node, all of
    them direct extensions of that token's path and each the parent of the next: [unclassified X], and for the species [X sp. accession],
    of that accession alone, or [X sp. group and a hash] where `groups` (accession, representative; one row an accession) has the
    accession. Null lineages are as empty ones, whose X is empty.
    """
    parts = F.filter(F.split(F.coalesce("lineage", F.lit("")), ";"), lambda t: t.rlike(f"^[{RANKS}]__"))
    e = entries.select("accession", parts.alias("parts"))
    full = e.agg(F.coalesce(F.max(F.exists("parts", lambda t: t.rlike("^[lk]__"))), F.lit(False)).alias("full"))  # one row
    e = e.withColumn("named", F.filter("parts", lambda t: F.length(t) > 3)).crossJoin(F.broadcast(full))
    name = F.lit(None).cast("string")
    if groups is not None:
        e = e.join(groups.select("accession", "representative"), "accession", "left")
        name = F.when(F.col("representative").isNotNull(), F.concat(F.lit(" sp. group"), _fnv1a_32(F.col("representative"))))
    last = F.try_element_at("named", F.lit(-1))
    anchor, upto = F.coalesce(F.substring(last, 4, 1 << 20), F.lit("")), F.array_join("named", ";")
    deepest = F.coalesce(F.instr(F.lit(RANKS), F.substring(last, 1, 1)), F.lit(1))
    species = F.concat(F.lit("s__["), anchor, F.coalesce(name, F.concat(F.lit(" sp. "), F.col("accession"))), F.lit("]"))
    e = e.withColumn("upto", upto).withColumn("anchor", anchor).withColumn("species", species)
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(RANKS, 1)])
    missing = F.filter(places, lambda p: (p.i > deepest) & (F.col("full") | ~p.r.isin("l", "k")))
    e = e.withColumn("missing", F.transform(missing, lambda p: F.struct(p.r.alias("rank"), F.when(p.r == "s", F.col("species")).otherwise(F.concat(p.r, F.lit("__[unclassified "), F.col("anchor"), F.lit("]"))).alias("name"))))

    def node(path, parent, rank, name, synthetic, alone):
        return F.struct(path.alias("path"), parent.alias("parent_path"), rank.alias("rank"), name.alias("name"), synthetic.alias("synthetic"), alone.alias("per_accession"))

    no, head = F.lit(False), lambda n: F.array_join(F.slice("named", F.lit(1), n), ";")
    own = F.transform("named", lambda t, i: node(head(i + 1), F.when(i > 0, head(i)).otherwise("root"), F.substring(t, 1, 1), F.substring(t, 4, 1 << 20), no, no))
    below = lambda m: F.concat(F.col("upto"), F.lit(";"), m)
    above = lambda i: F.when(i > 0, below(F.get("missing", i - 1)["name"])).when(F.col("upto") != "", F.col("upto")).otherwise("root")
    made = F.transform("missing", lambda m, i: node(below(m["name"]), above(i), m["rank"], m["name"], m["rank"] != "s", m["rank"] == "s"))
    return e.select("accession", F.concat(own, made).alias("nodes"))


def filled_tree(lineages: DataFrame) -> DataFrame:
    """Distinct nodes of filled_lineages, and the root. Where a named token has the path of a synthetic node, the named one stands."""
    n = lineages.select(F.explode("nodes").alias("n")).select("n.*")
    kept = F.min(F.struct("synthetic", "per_accession", "parent_path", "rank", "name"))
    nodes = n.groupBy("path").agg(kept.alias("k")).select("path", "k.parent_path", "k.rank", "k.name", "k.synthetic", "k.per_accession")
    root = lineages.sparkSession.range(1).select(*[F.lit(x).alias(c) for c, x in (("path", "root"), ("parent_path", "root"), ("rank", "no rank"), ("name", "root"), ("synthetic", False), ("per_accession", False))])
    return nodes.unionByName(root)


def closure(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(node, parent) -> (node, ancestor, steps), the node itself at 0 steps; a row for each path, of at most `depth` steps.

    Nodes that are parents climb first, a join a step until none gets further; each such step is kept by Spark. All nodes join these
    climbs once, on their parents. (A recursive common table expression would stop at spark.sql.cteRecursionRowLimit rows.)
    """
    c = F.col
    up = edges.where("parent IS NOT NULL").select(c("node").alias("_n"), c("parent").alias("_p"))
    every = edges.select("node", c("node").alias("ancestor"), F.lit(0).alias("steps"))
    climb = up.select(c("_p").alias("via")).distinct().select("via", c("via").alias("ancestor"), F.lit(1).alias("steps")).persist()
    inner = up.join(climb.select(c("via").alias("_n")), "_n", "left_semi").persist()
    climbs = None
    for step in range(1, depth + 1):
        if climb.isEmpty():
            break
        climbs = climb if climbs is None else climbs.unionByName(climb)
        climb = climb.join(inner, c("ancestor") == c("_n")).select("via", c("_p").alias("ancestor"), F.lit(step + 1).alias("steps")).persist()
    if climbs is None:
        return every
    first = edges.select("node").join(up, c("node") == c("_n")).select("node", c("_p").alias("via"))  # rows of one node each climb by all of them
    return every.unionByName(first.join(climbs, "via").select("node", "ancestor", "steps"))


def lowest_common(closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, lca): the shared ancestor nearest to a.

    The distinct b and their ancestors are kept by Spark first, so that their sizes are known: where they are few they go to the climbs
    of the a, which then are not shuffled by ancestor (few ancestors would mean few tasks); where they are many, both sides are shuffled.
    """
    c = F.col
    ends = pairs.select(c("b").alias("node")).distinct().persist()
    ends.count()
    above = closed.join(ends, "node", "left_semi").select(c("node").alias("_b"), c("ancestor").alias("_u")).distinct().persist()
    above.count()
    up = pairs.join(closed, c("a") == c("node")).select("a", "b", c("ancestor").alias("u"), c("steps").alias("s"))
    both = up.join(above, (c("b") == c("_b")) & (c("u") == c("_u")))
    return both.groupBy("a", "b").agg(F.min_by("u", "s").alias("lca"))


def difference(current: DataFrame, release: DataFrame) -> DataFrame:
    """(accession, species) both sides -> accession, class."""
    c, r = current.select("accession", F.col("species").alias("cs")), release.select("accession", F.col("species").alias("rs"))
    known = release.select(F.col("species").alias("cs"), F.lit(True).alias("exists")).distinct()
    j = c.join(r, "accession", "full_outer").join(known, "cs", "left")
    kind = (
        F.when(F.col("cs").isNull(), "new_in_release")
        .when(F.col("cs") == F.col("rs"), "unchanged")
        .when(F.col("rs").isNotNull(), "taxonomy_changed")
        .when(F.col("accession").rlike("^GC[FA]_"), "dropped")
        .when(F.col("exists"), "custom_stable")
        .otherwise("needs_gtdbtk")
    )
    return j.select("accession", kind.alias("class"))


def patch(lineages: DataFrame, changes: DataFrame) -> DataFrame:
    """New lineage where the patch has the accession."""
    p = changes.select("accession", F.col("taxonomy").alias("_new"))
    return lineages.join(p, "accession", "left").withColumn("taxonomy", F.coalesce("_new", "taxonomy")).drop("_new")


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """All columns and the place of each row, from 1, in the order of columns that tell rows apart: counts of range partitions give the
    offsets, so no single task sorts all rows."""
    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    spread = spread.withColumn("_mono", F.monotonically_increasing_id())
    part, within = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND((1 << 33) - 1)
    placed = spread.withColumn("_part", part).withColumn("_within", within).drop("_mono")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_within") + 1).drop("_part", "_within", "_before")


def dense_ids(nodes: DataFrame, key: str = "path") -> DataFrame:
    """1..N in order of the key."""
    return positions(nodes.select(key).distinct(), [key], "taxid")


def concept_ids(paths: DataFrame, hashed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, concept_id: the path's 64-bit hash with the upper bit set. Of paths with one hash the first in order keeps it and the others
    move on by one until each has its own; hashes meet so rarely that a round more is the exception."""
    hashed = hashed or (lambda df: with_fnv1a_64(df, "path", "h"))
    top = F.lit(-(1 << 63))
    own = lambda c: F.when(c.bitwiseOR(top) == top, top.bitwiseOR(F.lit(1))).otherwise(c.bitwiseOR(top))
    ids = hashed(paths.select("path").distinct()).select("path", own(F.col("h")).alias("concept_id"), F.lit(0).alias("moved"))
    while ids.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        first = Window.partitionBy("concept_id").orderBy(F.col("moved"), "path")
        late = F.row_number().over(first) > 1
        ids = ids.withColumn("late", late).select("path", F.when(F.col("late"), own(F.col("concept_id") + 1)).otherwise(F.col("concept_id")).alias("concept_id"), F.when(F.col("late"), F.col("moved") + 1).otherwise(F.col("moved")).alias("moved"))
    return ids.select("path", "concept_id")


def resolve_collisions(files: DataFrame, order: str) -> DataFrame:
    """All columns of (accession, content, order), resolved and action: the first content of an accession keeps it, the n-th distinct
    one gets ~dup and n, equal content is dropped but for its first file; null content is kept under the accession."""
    first = files.where("content is not null").groupBy("accession", "content").agg(F.min(order).alias("_first"))
    numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy("accession").orderBy("_first")))
    j = files.join(numbered, ["accession", "content"], "left")
    resolved = F.when(F.col("_n") > 1, F.concat(F.col("accession"), F.lit("~dup"), F.col("_n"))).otherwise(F.col("accession"))
    action = F.when(F.col("content").isNull(), "keep-unhashed").when(F.col(order) == F.col("_first"), "keep").otherwise("drop-exact-duplicate")
    return j.withColumn("resolved", resolved).withColumn("action", action).drop("_first", "_n")


def balanced_parts(sizes: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Largest group first to the least loaded part (group totals only: as many as there are taxa)."""
    load, out = [0] * n, {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        i = min(range(n), key=lambda k: (load[k], k))
        load[i] += size
        out[name] = i
    return out
