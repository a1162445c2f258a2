"""Secret scans with corpus-wide ownership frequency (DataFrame operations only).

Patterns give candidates; each candidate value's hash is aggregated over the corpus by distinct repositories and owners.
A value that more than MAX_LIVE_OWNERS owners or more than MAX_LIVE_REPOS repositories hold is a widely copied example, any other
looks live. Assign, access and hex matches are always spans; a generic token (a digit and 15 or more token characters) that overlaps
none of them is a span only when it looks live.

Offsets come from the pieces between matches (split) and the matches (regexp_extract_all), summed in a window by
(document, kind): linear in the number of matches, whatever the text's length. Texts are read once; what is shuffled are
candidates.

Defined results: null and empty texts have no spans; repeated rows are separate documents; null owners and repositories count
as one owner or repository; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

# Fixed patterns: letters of the assign keywords match in either case (ASCII).
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
GENERIC = r"[0-9][A-Za-z0-9_+/-]{15,}"
#: In the order in which spans with one start are listed.
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("generic", GENERIC))
MIN_ASSIGNED = 8
#: Owners, and repositories over all owners, that a live value has at most.
MAX_LIVE_OWNERS, MAX_LIVE_REPOS = 2, 4


def scan(docs: DataFrame, text_col: str, owner_col: str, repo_cols: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """One row per document with rid, doc (a struct of the columns `keep`), owner, repo and, for each kind that occurs, lengths of
    the gaps and the matches; written once. No column of the documents stands beside those of the scan, so names cannot clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def found(rank: int, pattern: str) -> F.Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        return F.when(text.rlike(pattern), F.struct(F.lit(rank).alias("rank"), gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))

    kinds = F.filter(F.array(*[found(i, p) for i, (_, p) in enumerate(KINDS)]), lambda x: x.isNotNull())
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
            F.col(owner_col).cast("string").alias("owner"),
            F.to_json(F.array(*[F.col(c).cast("string") for c in repo_cols])).alias("repo"),
            kinds.alias("kinds"),
        )
    )


def spans_of(scanned: DataFrame) -> DataFrame:
    """rid, rank, kind, start, end (code points), base (boolean), live (boolean), value_md5: base spans and kept generic ones."""
    each = scanned.where(F.size("kinds") > 0).select("rid", "owner", "repo", F.explode("kinds").alias("k"))
    each = each.select("rid", "owner", "repo", F.col("k.rank").alias("rank"), F.posexplode(F.arrays_zip(F.slice("k.gaps", F.lit(1), F.size("k.hits")).alias("gap"), F.col("k.hits").alias("hit"))).alias("i", "m"))
    by = Window.partitionBy("rid", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("rid", "owner", "repo", "rank", "i", F.col("m.gap").alias("gap"), F.col("m.hit").alias("hit")).withColumn("size", F.length("hit"))
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by)).withColumn("start", F.col("end") - F.col("size"))
    value = F.when(F.col("rank") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    each = each.withColumn("value", value).where((F.col("rank") != 0) | (F.length("value") >= MIN_ASSIGNED))
    base_end, base_start = F.when(F.col("rank") < 3, F.col("end")), F.when(F.col("rank") < 3, F.col("start"))
    along = Window.partitionBy("rid").orderBy("start", "rank")
    before = F.max(base_end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(along.rowsBetween(1, Window.unboundedFollowing))
    each = each.withColumn("before", before).withColumn("after", after)
    each = each.where((F.col("rank") < 3) | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))))
    each = each.select("rid", "rank", "start", "end", "owner", "repo", F.md5(F.col("value").cast("binary")).alias("value_md5"))
    # one row per (value, owner, repository) before distinct owners are counted, so a hot value is summed map-side first
    held = each.groupBy("value_md5", "owner", "repo").agg(F.lit(1).alias("one"))
    held = held.groupBy("value_md5", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("value_md5").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    seen = each.drop("owner", "repo").join(held, "value_md5").withColumn("live", (F.col("n_owners") <= MAX_LIVE_OWNERS) & (F.col("n_repos") <= MAX_LIVE_REPOS))
    name = F.element_at(F.array(*[F.lit(k) for k, _ in KINDS]), F.col("rank") + 1)
    return seen.where((F.col("rank") < 3) | F.col("live")).select("rid", "rank", name.alias("kind"), "start", "end", (F.col("rank") < 3).alias("base"), "live", "value_md5", "n_owners", "n_repos")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per document: doc_id, spans array<struct<start, rank, kind, end, base, live>> in order of start, then kind."""
    scanned = scan(docs, text_col, owner_col, repo_cols, (id_col,)).withColumn("doc_id", F.col(f"doc.`{id_col}`"))
    by_doc = spans_of(scanned).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "base", "live"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean,live:boolean>>)")
    return scanned.select("rid", "doc_id").join(by_doc, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    of_kind = lambda rank: count(lambda x: x.rank == rank)
    return found.select(
        "doc_id",
        *[of_kind(rank).alias(n) for rank, n in enumerate(("n_assign", "n_access", "n_hex"))],
        F.sha2(listed(F.filter("spans", lambda x: x.base)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(lambda x: x.live).alias("n_live"),
        count(lambda x: ~x.live).alias("n_copied"),
    )


def redact(docs: DataFrame, mask: str = "<secret>", text_col: str = "text", size_col: str = "n_chars", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """The same documents with live-looking spans replaced by a mask; the column size_col, where there is one, follows. Overlapping
    spans are merged first. All rows and columns stay, whatever the columns are called.

    The patterns run once over every text, when whole rows are written with what was found. Rows without a match pass straight
    through; the others are rebuilt piece by piece.
    """
    scanned = scan(docs, text_col, owner_col, repo_cols, tuple(docs.columns))
    some = F.size("kinds") > 0
    live = spans_of(scanned).where("live").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("live"))
    joined = scanned.where(some).select("rid", "doc").join(live, "rid", "left")
    text = F.col(f"doc.`{text_col}`")
    # pieces are joined once at the end: a text of many spans costs no more than its length
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("z"))).alias("gaps"))

    def step(acc, s):
        gap = F.array(F.struct(acc.at.alias("a"), s.start.alias("z")))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.gaps, gap)).otherwise(acc.gaps).alias("gaps"))

    def finish(acc):
        cut = lambda a, z: F.substring(text, (a + 1).cast("int"), (z - a).cast("int"))
        gaps = F.transform(F.slice(acc.gaps, F.lit(2), F.greatest(F.size(acc.gaps) - 1, F.lit(0))), lambda g: cut(g.a, g.z))
        return F.array_join(F.concat(gaps, F.array(cut(acc.at, F.length(text).cast("bigint")))), mask)

    joined = joined.select("doc", "live", F.when(F.col("live").isNull(), text).otherwise(F.aggregate("live", state, step, finish)).alias("clean"))
    own = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    new = own | {text_col: F.col("clean")}
    if size_col in own:
        new[size_col] = F.when(F.col("live").isNull(), own[size_col]).otherwise(F.length("clean").cast(docs.schema[size_col].dataType))
    through = scanned.where(~some)
    return through.select(*[x.alias(c) for c, x in own.items()]).unionByName(joined.select(*[x.alias(c) for c, x in new.items()]))


_SQL_ASSIGN, _SQL_ACCESS, _SQL_HEX, _SQL_GENERIC = (p.replace("'", "''") for _, p in KINDS)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {{'none': source IS NULL, 'name': coalesce(source, '')}} AS owner, {{'none': source IS NULL, 'name': coalesce(source, ''), 'no_lang': lang IS NULL, 'lang': coalesce(lang, '')}} AS repo, coalesce(text, '') AS text FROM documents),
p AS (SELECT * FROM (VALUES (0, 'assign', '{_SQL_ASSIGN}'), (1, 'access', '{_SQL_ACCESS}'), (2, 'hex', '{_SQL_HEX}'), (3, 'generic', '{_SQL_GENERIC}')) v(rank, kind, pat)),
m AS (
  SELECT rid, 0 AS rank, string_split_regex(text, '{_SQL_ASSIGN}') AS gaps, regexp_extract_all(text, '{_SQL_ASSIGN}') AS hits FROM d
  UNION ALL SELECT rid, 1, string_split_regex(text, '{_SQL_ACCESS}'), regexp_extract_all(text, '{_SQL_ACCESS}') FROM d
  UNION ALL SELECT rid, 2, string_split_regex(text, '{_SQL_HEX}'), regexp_extract_all(text, '{_SQL_HEX}') FROM d
  UNION ALL SELECT rid, 3, string_split_regex(text, '{_SQL_GENERIC}'), regexp_extract_all(text, '{_SQL_GENERIC}') FROM d),
e AS (SELECT rid, rank, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM m WHERE len(hits) > 0),
f AS (SELECT rid, rank, i, length(gaps[i]) AS gap, hits[i] AS hit FROM e),
g AS (SELECT *, sum(gap + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i)::BIGINT AS stop FROM f),
h AS (
  SELECT rid, rank, stop - length(hit) AS start, stop, CASE WHEN rank = 0 THEN regexp_extract(hit, '{_SQL_ASSIGN}', 2) ELSE hit END AS value FROM g),
k AS (SELECT * FROM h WHERE rank <> 0 OR length(value) >= 8),
c AS (
  SELECT * FROM k WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM k b WHERE b.rid = k.rid AND b.rank < 3 AND b.start < k.stop AND k.start < b.stop)),
o AS (SELECT value, count(DISTINCT owner) <= 2 AND count(DISTINCT repo) <= 4 AS live FROM c JOIN d USING (rid) GROUP BY value),
s AS (
  SELECT rid, rank, kind, start, stop, live, kind || ':' || start || ':' || stop AS txt
  FROM c JOIN o USING (value) JOIN p USING (rank) WHERE rank < 3 OR live),
a AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(txt, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(txt, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (rid)
"""
