"""Scores of a genome as expressions over quality columns; null means not scored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
DUP_SLOPE, DUP_INTERCEPT, DUP_SCALE = 1.448954, 0.009998, 0.125
GEOMETRY = (("rho_outlier", 0.10), ("spe", 0.10), ("contig_outlier_adj", 0.05), ("tnf_minor", 0.10))


def clamp01(c) -> Column:
    # greatest() skips nulls, which would turn "not scored" into 0
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def duplication(excess, mass) -> Column:
    """Duplication contamination from the mass, else from the excess."""
    return F.when(mass.isNotNull(), F.greatest(DUP_SLOPE * mass + DUP_INTERCEPT, F.lit(0.0))).otherwise(excess * DUP_SCALE)


def geometry() -> tuple[Column, Column]:
    """Median of the axes that are present, and how many passed their thresholds."""
    axes = F.array_sort(F.filter(F.array(*[clamp01(F.col(a)) for a, _ in GEOMETRY]), lambda x: x.isNotNull()))
    n = F.size(axes)
    half = F.floor(n / 2).cast("int")
    median = F.when(n == 0, None).when(n % 2 == 1, F.element_at(axes, half + 1)).otherwise((F.element_at(axes, F.greatest(half, F.lit(1))) + F.element_at(axes, half + 1)) / 2)
    fired = sum((F.when(F.col(a) >= t, 1).otherwise(0) for a, t in GEOMETRY), F.lit(0))
    return median, fired


def channels() -> dict[str, Column]:
    """D, S, G, display (noisy or of those present), fired."""
    d, s = clamp01(duplication(F.col("dup_excess"), F.col("dup_mass"))), clamp01(F.col("fmh_minority"))
    g, over = geometry()
    keep = F.coalesce(1 - d, F.lit(1.0)) * F.coalesce(1 - s, F.lit(1.0)) * F.coalesce(1 - g, F.lit(1.0))
    fired = F.when(d >= 0.05, 1).otherwise(0) + F.when(s >= 0.10, 1).otherwise(0) + F.when(over >= 2, 1).otherwise(0)
    return {"D": d, "S": s, "G": g, "display": F.when(F.coalesce(d, s, g).isNotNull(), 1 - keep), "fired": fired}


def completeness_effective() -> Column:
    """Marker, else core coverage, else decontaminated share; pulled down where the relative one disagrees strongly."""
    intrinsic, cr = F.coalesce(F.col("marker"), F.col("aamer_core"), F.col("post_decontam")), F.col("cluster_relative")
    return F.when(intrinsic.isNull(), cr).when((intrinsic < 0.5) & (cr < intrinsic) & (intrinsic - cr > 0.3), F.sqrt(intrinsic * cr)).otherwise(intrinsic)


def quality_tier(ce: Column, d: Column) -> Column:
    only_core = F.col("post_decontam").isNull() & F.col("cluster_relative").isNull() & F.col("aamer_core").isNotNull()
    return F.when(ce.isNull() | (ce < 0.5), "LQ").when(ce < 0.9, "MQ").when(only_core | F.coalesce(d >= 0.05, F.lit(False)), "MQ").otherwise("HQ")


def assembly_tier(ce: Column, contamination: Column) -> Column:
    return F.when((ce >= 0.9) & (contamination < 0.05), "HQ").when((ce >= 0.5) & (contamination < 0.10), "MQ").otherwise("LQ")


def leakage_excess(c: list[Column], k: list[int]) -> Column:
    """Held-out fit: ln c through the origin over all but the largest k; excess of the expectation at the largest."""
    small = list(zip(k[:-1], c[:-1], strict=True))
    beta = sum((F.lit(float(ki)) * F.ln(ci) for ki, ci in small), F.lit(0.0)) / float(sum(ki * ki for ki in k[:-1]))
    expected = F.exp(beta * k[-1])
    low = F.least(*c) < 0.01
    return F.when(~low, F.greatest(expected - c[-1], F.lit(0.0)) / F.greatest(expected, F.lit(0.01)))


def leakage_build(containments: list, ks: list[int]) -> F.Column:
    """The build-time form: the line through the logarithms takes in the largest k, too."""
    logs = [k * F.ln(c) for c, k in zip(containments, ks, strict=True)]
    beta = sum(logs[1:], logs[0]) / float(sum(k * k for k in ks))
    expected = F.exp(beta * float(ks[-1]))
    excess = F.greatest(expected - containments[-1], F.lit(0.0)) / F.greatest(expected, F.lit(0.01))
    return F.when(F.least(*containments) >= 0.01, excess)


def quantised_prevalence(count, members) -> F.Column:
    """A byte: 255 times the logarithm of the count to the base of the members, halves up; 0 for one, 255 for all."""
    q = F.floor(255.0 * F.ln(count.cast("double")) / F.ln(members.cast("double")) + 0.5 + 1e-9)
    return F.when((members <= 1) | (count >= members), 255).when(count <= 1, 0).otherwise(F.least(F.greatest(q, F.lit(1)), F.lit(255))).cast("int")


def dequantised_prevalence(q, members) -> F.Column:
    return F.when(members <= 1, 1.0).otherwise(F.pow(members.cast("double"), q / 255.0 - 1.0))


def needs_scan(leakage, excess, relative, scan_all: bool = False, leakage_over: float = 0.02, excess_over: float = 0.0, relative_under: float = 0.70) -> tuple[F.Column, F.Column]:
    """Whether a genome goes to the contig scan, and whether it needs the full one (leakage or completeness, not composition alone)."""
    by_leakage, by_excess = F.coalesce(leakage > leakage_over, F.lit(False)), F.coalesce(excess > excess_over, F.lit(False))
    by_completeness = F.coalesce(relative < relative_under, F.lit(False))
    flagged = F.lit(True) if scan_all else by_leakage | by_excess | by_completeness
    return flagged, by_leakage | by_completeness


def stale(post_decontam, fmh_minority, marker, scored, with_fmh: bool, with_markers: bool) -> F.Column:
    """Whether a genome must be scored again: one of the four cached signals is missing (0 counts as missing for bytes)."""
    gone = post_decontam.isNull() | ~F.coalesce(scored, F.lit(False))
    if with_fmh:
        gone = gone | (F.coalesce(fmh_minority, F.lit(0)) == 0)
    if with_markers:
        gone = gone | (F.coalesce(marker, F.lit(0)) == 0)
    return gone
