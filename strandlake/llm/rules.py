"""Quality rules: learned decision lists over native text statistics (DataFrame operations only).

Statistics of every whole text are computed by built-in functions and written once. Sequential covering then learns, from a
bounded sample of labelled rows (SAMPLE rows at most, the first by a seeded hash), an ordered list of threshold conjunctions:
each rule is grown literal by literal for information gain on two thirds of the rows not yet covered, pruned on the other
third, kept while it stays precise, and its rows are removed. The list becomes one ordered CASE expression.

Repeats of 3-word windows are found by sorting (window, position) inside the row: n log n, no row leaves its task.

Defined results: null text has no words (base_failed, not kept); repeated rows are separate; without labels the list is empty and
only the base decides; ties between thresholds go to the first feature and the lower threshold; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_sample, table, written

#: Labelled rows used for learning, at most.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
THRESHOLDS, MAX_LITERALS, MAX_RULES = 24, 4, 16
#: A rule stays in the list if at least this share of what it rejects is labelled low, on either part of the sample.
MIN_PRECISION, MIN_COVER = 0.9, 3

FEATURES = ("n_words", "word_len", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "words_per_line")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_bang.

    A lookahead lists the 3-word windows of the words joined by one space, as exact strings. If they are all distinct nothing
    repeats; otherwise (window, position) pairs are sorted, neighbours compared, and the words of equal ones counted once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "").alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_bang"),
    )
    d = d.withColumn("t", F.regexp_extract_all(F.array_join("w", " "), F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))"), F.lit(1)))
    repeats = F.size(F.array_distinct("t")) < F.size("t")
    d = d.withColumn("s", F.when(repeats, F.sort_array(F.arrays_zip("t", F.expr("sequence(0, size(t) - 1)").alias("i")))))
    d = d.withColumn("j", F.expr("filter(sequence(0, size(s) - 2), j -> s[j].t = s[j + 1].t)"))
    covered = F.expr("size(array_distinct(flatten(transform(j, x -> array(s[x].i, s[x].i + 1, s[x].i + 2, s[x + 1].i, s[x + 1].i + 1, s[x + 1].i + 2)))))")
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_bang",
    )


def with_features(stats: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (
        stats.withColumn("word_len", per("word_chars", "n_words"))
        .withColumn("symbol_ratio", per("n_symbols", "n_words"))
        .withColumn("dup_line_ratio", per("n_dup_lines", "n_lines"))
        .withColumn("repeat_ratio", per("n_repeat_words", "n_words"))
        .withColumn("upper_ratio", per("n_upper", "word_chars"))
        .withColumn("bang_ratio", per("n_bang", "n_words"))
        .withColumn("words_per_line", per("n_words", "n_lines"))
    )


Literal = tuple[int, bool, float]  # feature, above (>=) or below (<), threshold


def learn_rules(rows: list[tuple[tuple[float, ...], int]]) -> list[list[Literal]]:
    """Decision list that rejects label 0. Sets of rows are bit masks, so a literal's counts are two popcounts."""
    n = len(rows)
    bad = sum(1 << i for i, (_, y) in enumerate(rows) if y == 0)
    hold = sum(1 << i for i in range(n) if i % 3 == 2)
    literals: list[tuple[Literal, int]] = []
    for f in range(len(FEATURES)):
        values = sorted(x[f] for x, _ in rows)
        cuts = sorted({values[min(n - 1, n * q // THRESHOLDS)] for q in range(1, THRESHOLDS)} | {values[min(n - 1, int(n * q))] for q in (0.9, 0.925, 0.95, 0.97, 0.98, 0.99)}) if n else []
        for c in cuts:
            above = sum(1 << i for i, (x, _) in enumerate(rows) if x[f] >= c)
            literals += [((f, True, c), above), ((f, False, c), ((1 << n) - 1) ^ above)]

    def counts(mask: int) -> tuple[int, int]:
        p = (mask & bad).bit_count()
        return p, mask.bit_count() - p

    def precision(mask: int) -> float:
        p, m = counts(mask)
        return (p + 1) / (p + m + 2)

    def covered(masks: list[int], at: int) -> int:
        for m in masks:
            at &= m
        return at

    def precise(masks: list[int], grow: int, prune: int) -> bool:
        p, m = counts(covered(masks, grow))
        hp, hm = counts(covered(masks, prune))
        return p >= MIN_COVER and p >= MIN_PRECISION * (p + m) and hp >= MIN_PRECISION * (hp + hm)

    def refined(lit: Literal, at: int, p0: int, n0: int) -> tuple[Literal, int]:
        """The best of all values as threshold, for the feature and side that the grid has chosen."""
        f, above, c = lit
        inside = sorted(((x[f], y == 0) for i, (x, y) in enumerate(rows) if at >> i & 1), reverse=above)
        base, best, gain, p = math.log2(p0 / (p0 + n0)), c, -1.0, 0
        for k, (value, is_bad) in enumerate(inside):
            p += is_bad
            last = k + 1 == len(inside)
            if p and (last or inside[k + 1][0] != value) and (g := p * (math.log2(p / (k + 1)) - base)) > gain + 1e-12:
                best, gain = value if above or last else inside[k + 1][0], g
        mask = sum(1 << i for i, (x, _) in enumerate(rows) if (x[f] >= best if above else x[f] < best))
        return (f, above, best), mask

    def grown(at: int, banned: set[int]) -> list[tuple[Literal, int]]:
        rule: list[tuple[Literal, int]] = []
        while len(rule) < MAX_LITERALS:
            p0, n0 = counts(at)
            if not p0 or not n0:
                break
            best, gain = None, 0.0
            for lit, mask in literals:
                if lit[0] in banned:
                    continue
                p, m = counts(at & mask)
                if p and (g := p * (math.log2(p / (p + m)) - math.log2(p0 / (p0 + n0)))) > gain + 1e-12:
                    best, gain = (lit, mask), g
            if best is None:
                break
            best = refined(best[0], at, p0, n0)
            rule.append(best)
            at &= best[1]
        return rule

    def next_rule(left: int) -> list[tuple[Literal, int]]:
        """Grown and pruned; where the first feature leads to no precise rule, the search starts again without it."""
        grow, prune, banned = left & ~hold, left & hold, set()
        while len(banned) < len(FEATURES):
            rule = grown(grow, banned)
            if not rule:
                return []
            masks = [m for _, m in rule]
            lengths = sorted(range(1, len(rule) + 1), key=lambda k: (-precision(covered(masks[:k], prune)), k))
            for k in lengths:
                if precise(masks[:k], grow, prune):
                    return rule[:k]
            banned.add(rule[0][0][0])
        return []

    rules: list[list[Literal]] = []
    left = (1 << n) - 1
    while len(rules) < MAX_RULES and (rule := next_rule(left)):
        rules.append([lit for lit, _ in rule])
        left &= ~covered([m for _, m in rule], left)
    return rules


def as_expression(rules: list[list[Literal]]) -> F.Column:
    """The decision list as an ordered CASE expression over FEATURES: true keeps."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for f, above, c in rule:
            cond = cond & ((F.col(FEATURES[f]) >= F.lit(c)) if above else (F.col(FEATURES[f]) < F.lit(c)))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def sample_rows(features: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = SAMPLE) -> list[tuple[tuple[float, ...], int]]:
    """At most `limit` labelled rows, the first by a hash of the id; the bound keeps what reaches the driver small."""
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    chosen = bounded_sample(y, "doc_id", limit)
    # `limit` rows at most, so broadcast and result are bounded; of rows that share an id the least counts
    x = F.min(F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES]))
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("order", "doc_id").agg(x.alias("x"), F.min("y").alias("y"))
    got = sorted(rows.select("order", "doc_id", *[f"x.{f}" for f in FEATURES], "y").collect())
    got = [r[2:] for r in got]
    return [(tuple(r[:-1]), r[-1]) for r in got]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, features, base_failed and kept of every document."""
    stats = written(text_stats(docs, id_col, text_col))
    features = with_features(stats)
    rules = learn_rules(sample_rows(features, labels))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return features.withColumn("base_failed", failed).withColumn("kept", ~failed & as_expression(rules))


def op8_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
