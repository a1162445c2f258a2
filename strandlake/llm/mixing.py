"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Each source is shuffled by a seeded hash; a document's virtual finish time in pass e over its source is
(e * source_size + words of its source up to and with it) / target. All (document, pass) pairs are put in order of
finish time and taken until the budget (all words) is used up, so each source has got its target when time is 1.

Truncating the globally sorted queue at the budget needs only the finish time at which the budget is reached, so rows are not moved
into that order: sums over ranges of finish time give the range, then the row, at which a range sort would be cut, and every pair
before it is taken. What is taken is the same as after the sort.

No source is ordered in one task: rows are summed by (source, hash prefix), prefix offsets come from those sums, and only
rows of one (source, prefix) meet in a window. The cut is found by sums over slots of finish time, refined once.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows are
separate documents; an empty table gives an empty result; other columns are not read, but for those named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, table, written

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = "mix-1"
#: Slots of finish time a unit, and the last slot, which is open-ended.
SLOTS, LAST_SLOT = 4096, 1 << 17


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, source_size, source_rank, target. Sources are few; the windows here run over sources alone.

    In order of cap * size / weight the sources that reach their cap are a prefix: a source is capped when the rest of the
    budget, dealt by weight to it and those after it, would give it more than its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_rank", F.row_number().over(order))
    s = s.withColumn("w", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("source_size").cast("double") / F.col("w"), "source_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("rest") * F.col("w") > F.col("most") * F.col("rest_w"))
        .withColumn("free", F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything))
        .withColumn("free_w", F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything))
    )
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("free").cast("double") / F.col("free_w"))
    return s.select("source", "source_size", "source_rank", target.alias("target"), "total")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Columns `keep` (orderable; they tell repeated rows apart), doc_id, source, size, source_size, target, passes (times the document is taken), taken (= passes * size)."""
    spark = docs.sparkSession
    mark = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    kept = [f"kept_{i}" for i in range(len(keep))]
    sized = written(docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), mark.alias("mark")))
    # a handful of rows, one per source
    targets = written(source_targets(sized, weights, max_passes))
    part = F.substring("mark", 1, 3)
    sums = sized.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).drop("part_size")
    parts = sums.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(F.col("p.source").alias("p_source"), F.col("part").alias("p_part"), "offset", "source_size", "source_rank", "target", "total")
    within = Window.partitionBy("source", "part").orderBy("mark", "doc_id", "size", *kept).rowsBetween(Window.unboundedPreceding, 0)
    cum = sized.withColumn("part", part).withColumn("within", F.sum("size").over(within))
    placed = written(
        cum.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .withColumn("cum", F.col("offset") + F.col("within"))
        .select(*kept, "doc_id", "source", "size", "source_size", "source_rank", "target", "total", "cum")
    )

    def finish(e) -> F.Column:
        return (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")

    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("e")
    queue = placed.where("size > 0").select("size", "source_rank", "source_size", "target", "cum", "total", passes).withColumn("f", finish(F.col("e")))
    slot = F.least(F.floor(F.col("f") * SLOTS), F.lit(LAST_SLOT)).cast("long")
    fine = F.floor((F.col("f") * SLOTS - F.col("slot")) * SLOTS).cast("long")
    queue = queue.select("size", "source_rank", "f", "total", slot.alias("slot")).withColumn("fine", F.least(fine, F.lit(LAST_SLOT)))

    def first_over(df: DataFrame, key: str, base: int) -> tuple[int, int] | None:
        """The first slot at whose end the budget is exceeded, and what is taken before it: one row comes to the driver."""
        run = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        got = df.groupBy(key).agg(F.sum("size").alias("n"), F.max("total").alias("total")).withColumn("upto", F.sum("n").over(run) + F.lit(base)).where("upto > total").orderBy(key).limit(1).collect()
        return (got[0][key], got[0]["upto"] - got[0]["n"]) if got else None

    cut_f, cut_rank = float("inf"), 0
    if (coarse := first_over(queue, "slot", 0)) is not None:
        there = queue.where(F.col("slot") == coarse[0])
        finer = first_over(there, "fine", coarse[1])
        run = Window.orderBy("f", "source_rank").rowsBetween(Window.unboundedPreceding, 0)
        over = there.where(F.col("fine") == finer[0]).withColumn("upto", F.sum("size").over(run) + F.lit(finer[1])).where("upto > total").orderBy("f", "source_rank").limit(1).collect()[0]
        cut_f, cut_rank = over["f"], over["source_rank"]

    def taken_in(e: int) -> F.Column:
        f = finish(F.lit(e))
        return F.when((f < F.lit(cut_f)) | ((f == F.lit(cut_f)) & (F.col("source_rank") < cut_rank)), 1).otherwise(0)

    times = F.when(F.col("size") > 0, sum((taken_in(e) for e in range(max_passes)), F.lit(0))).otherwise(0)
    return placed.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "doc_id", "source", "size", "source_size", "target", times.cast("long").alias("passes"), (times * F.col("size")).cast("long").alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':mix-1')) AS mark
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS source_rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((source_rank - 1) % 3 + 1)::INT] AS w, source_size * 3 AS most,
         sum(source_size) OVER ()::BIGINT AS total FROM src),
walked AS (
  SELECT *, (sum(w) OVER ())::BIGINT AS all_w,
    total - coalesce(sum(most) OVER (ORDER BY source_size::DOUBLE / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_w
  FROM weighed),
caps AS (SELECT *, rest * w > most * rest_w AS capped FROM walked),
targets AS (
  SELECT source, source_size, source_rank, total,
    CASE WHEN capped THEN most::DOUBLE
         ELSE w * (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::BIGINT::DOUBLE
              / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::BIGINT END AS target
  FROM caps),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.source_rank, t.target, t.total,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mark, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT p.*, e, (e * source_size + cum)::DOUBLE / target AS f FROM placed p, (SELECT unnest([0, 1, 2]) AS e) x WHERE size > 0),
run AS (
  SELECT *, sum(size) OVER (ORDER BY f, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM queue),
got AS (SELECT source, cum, doc_id, sum(size)::BIGINT AS taken FROM run WHERE upto <= total GROUP BY source, cum, doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN got g ON p.source IS NOT DISTINCT FROM g.source AND p.cum = g.cum AND p.doc_id = g.doc_id AND p.size > 0
"""
