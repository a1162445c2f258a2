"""Per-group and per-genome numerics: consensus votes, covariance models, mixtures, graph cuts, isotonic calibration, greedy clusters.

Groups are taxa. Covariance is accumulated by partial sums, so a taxon of any size never meets in one task; the operators that
need a group's rows together are those whose groups are bounded by a genome's contigs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_vote(members: DataFrame, key: str, order: str, sig: str, bins: int) -> DataFrame:
    """Running majority vote of each signature bin over a key's members in `order`: key, bin, consensus, n.

    A bin's candidate gains a vote from an equal value, loses one to another, and gives way to the next value when it has none: where a
    strict majority exists the candidate is it, else the last one standing. The result depends on the order, so a key's rows pass
    through one task in order; the task holds one row of counts, however many members there are.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, candidate, votes = None, 0, None, None

        def row():
            return pd.DataFrame({"k": now, "bin": np.arange(bins), "consensus": candidate, "n": n})

        for p in parts:
            for k, x in zip(p["k"], p["x"], strict=True):
                if k != now:
                    if n:
                        yield row()
                    now, n, candidate, votes = k, 0, np.zeros(bins, np.int64), np.zeros(bins, np.int64)
                x = np.asarray(x, np.int64)
                fresh, same = votes == 0, candidate == x
                candidate = np.where(fresh, x, candidate)
                votes += np.where(fresh | same, 1, -1)
                n += 1
        if n:
            yield row()

    given = members.where(F.col(key).isNotNull() & F.col(sig).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(sig).alias("x"))
    return given.repartition("k").sortWithinPartitions("k", "o").mapInPandas(run, "k string, bin int, consensus long, n long").withColumnRenamed("k", key)


#: What the distance of a profile from its own model is expected to be, about the square root of its 136 dimensions (fixed value).
EXPECTED_DISTANCE = 11.63


def shrunk_model(profiles: DataFrame, key: str, vector: str, least: int = 3) -> DataFrame:
    """key, n, mean, alpha, lower (row by row): the covariance of a key's profiles, shrunk towards its mean variance by the oracle
    approximating weight, as a Cholesky factor; keys with fewer than `least` profiles have none.

    Partitions send sums and outer products; those add up, whatever the key's size.
    """

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for p in parts:
            for k, g in p.groupby("k", sort=False):
                x = np.stack(g["x"].to_numpy()).astype(float)
                n, s, o = state.get(k, (0, 0.0, 0.0))
                state[k] = (n + len(x), s + x.sum(axis=0), o + x.T @ x)
        yield pd.DataFrame([(k, n, s.tolist(), o.ravel().tolist()) for k, (n, s, o) in state.items()], columns=["k", "n", "s", "o"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        n, s = int(g["n"].sum()), np.sum(np.stack(g["s"].to_numpy()), axis=0)
        mean = s / n
        if n < least:
            return pd.DataFrame([(g["k"].iloc[0], n, mean.tolist(), None, None)], columns=["k", "n", "mean", "alpha", "lower"])
        p = len(s)
        cov = (np.sum(np.stack(g["o"].to_numpy()), axis=0).reshape(p, p) - n * np.outer(mean, mean)) / (n - 1)
        alpha = oracle_weight(np.trace(cov), float((cov**2).sum()), n, p)
        try:
            lower = np.linalg.cholesky((1 - alpha) * cov + alpha * np.trace(cov) / p * np.eye(p)).ravel().tolist()
        except np.linalg.LinAlgError:  # all profiles equal
            lower = None
        return pd.DataFrame([(g["k"].iloc[0], n, mean.tolist(), alpha, lower)], columns=["k", "n", "mean", "alpha", "lower"])

    given = profiles.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("x"))
    sums = given.mapInPandas(partial, "k string, n long, s array<double>, o array<double>")
    return sums.groupBy("k").applyInPandas(solve, "k string, n long, mean array<double>, alpha double, lower array<double>").withColumnRenamed("k", key)


def oracle_weight(trace: float, trace_squared: float, n: int, p: int) -> float:
    """Weight of the identity in oracle approximating shrinkage, from the traces of the covariance and of its square."""
    below = (n + 1 - 2 / p) * (trace_squared - trace**2 / p)
    return 1.0 if abs(below) < 1e-12 else float(np.clip(((1 - 2 / p) * trace_squared + trace**2) / below, 0.0, 1.0))


def profile_excess(profiles: DataFrame, models: DataFrame, key: str, vector: str) -> DataFrame:
    """id, excess, excess_build. excess: how far the Mahalanobis distance from the key's model exceeds what is expected, as a share of
    that; null without a model. excess_build: the distance from the mean, as a share of the mean's length, less one; never below 0."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out, build = [], []
            for x, mean, lower in zip(p["x"], p["mean"], p["lower"], strict=True):
                mean = np.asarray(mean, float)
                off = np.asarray(x, float) - mean
                size = float(np.linalg.norm(mean))
                build.append(max(0.0, float(np.linalg.norm(off)) / size - 1.0) if size > 0 else None)
                if lower is None:
                    out.append(None)
                    continue
                d = float(np.linalg.norm(np.linalg.solve(np.asarray(lower, float).reshape(len(mean), -1), off)))
                out.append(max(0.0, (d - EXPECTED_DISTANCE) / EXPECTED_DISTANCE))
            yield p[["id"]].assign(excess=pd.array(out, "Float64"), excess_build=pd.array(build, "Float64"))

    j = profiles.where(F.col(vector).isNotNull()).join(models.select(key, "mean", "lower"), key)
    return j.select("id", F.col(vector).cast("array<double>").alias("x"), "mean", "lower").mapInPandas(run, "id long, excess double, excess_build double")


def two_gaussians(points: np.ndarray, weights: np.ndarray, rounds: int = 50, tolerance: float = 1e-4, least: int = 10) -> tuple[float, float, bool] | None:
    """Minority share, gain in the Bayesian information criterion, and whether two diagonal Gaussians explain the weighted points better
    than one; None for fewer than `least` points. The two start half a deviation either side along the widest axis; a component of less
    than a twentieth ends the iteration."""
    total = float(weights.sum())
    if len(points) < least or total < 1e-12:
        return None

    def density(mu, var):
        return -0.5 * (((points - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=1)

    def moments(w):
        mu = w @ points
        return mu, np.maximum(w @ (points - mu) ** 2, 1e-8)

    mu, var = moments(weights / total)
    one = float(weights @ density(mu, var))
    step = np.zeros(points.shape[1])
    step[int(np.argmax(var))] = 0.5 * np.sqrt(var.max())
    a, b, share, two = (mu + step, var), (mu - step, var), 0.5, -1e30
    for _ in range(rounds):
        la, lb = np.log(share) + density(*a), np.log(1 - share) + density(*b)
        both = np.logaddexp(la, lb)
        r, now = np.exp(la - both), float(weights @ both)
        wa = float(weights @ r)
        if wa / total < 0.05 or 1 - wa / total < 0.05:
            two = now
            break
        a, b, share = moments(weights * r / wa), moments(weights * (1 - r) / (total - wa)), wa / total
        done, two = now - two < tolerance, now
        if done:
            break
    axes, log_n = points.shape[1], np.log(len(points))
    gain = (-2 * one + 2 * axes * log_n) - (-2 * two + (4 * axes + 1) * log_n)
    return (min(share, 1 - share) if gain > 0 else 0.0), float(gain), bool(gain > 0)


def self_outlier(signatures: np.ndarray, real: np.ndarray, bp: np.ndarray) -> float | None:
    """bp share of contigs whose agreement with the running vote of a bin's contigs, over real bins, lies two deviations below the
    mean; None for fewer than three contigs. signatures, real: contigs by bins, in order."""
    if len(bp) < 3:
        return None
    candidate, votes = np.zeros(signatures.shape[1], signatures.dtype), np.zeros(signatures.shape[1], np.int64)
    for sig, there in zip(signatures, real, strict=True):
        fresh = there & (votes == 0)
        votes += np.where(there, np.where(fresh | (candidate == sig), 1, -1), 0)
        candidate = np.where(fresh, sig, candidate)
    agree = ((signatures == candidate) & real).sum(axis=1) / np.maximum(real.sum(axis=1), 1)
    low = agree < agree.mean() - 2 * agree.std()
    return float(bp[low].sum() / bp.sum())


def reference_minority(signatures: np.ndarray, real: np.ndarray, bp: np.ndarray, models: dict[str, np.ndarray], host: str) -> float | None:
    """bp share of contigs that agree best, over real bins, with another model than the host's; None for fewer than two models. The
    first model of the greatest agreement counts."""
    if len(models) < 2 or not len(bp):
        return None
    names = list(models)
    agree = np.stack([((signatures == models[k]) & real).sum(axis=1) / np.maximum(real.sum(axis=1), 1) for k in names])
    other = np.array([names[i] != host for i in agree.argmax(axis=0)])
    return float(bp[other].sum() / bp.sum())


def covariance_model(profiles: DataFrame, key: str, vector: str, top: int = 15, least: int = 3) -> DataFrame:
    """key, n, mean, eigenvalues, eigenvectors, residual variance: shrunk covariance of a taxon's profiles.

    Partitions send sums and outer products; those add up, whatever the taxon's size.
    """

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for p in parts:
            for k, g in p.groupby("k", sort=False):
                x = np.stack(g["x"].to_numpy()).astype(float)
                n, s, o = state.get(k, (0, 0.0, 0.0))
                state[k] = (n + len(x), s + x.sum(axis=0), o + x.T @ x)
        yield pd.DataFrame([(k, n, s.tolist(), o.ravel().tolist()) for k, (n, s, o) in state.items()], columns=["k", "n", "s", "o"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["n"].sum())
        s = np.sum(np.stack(g["s"].to_numpy()), axis=0)
        d = len(s)
        cov = np.sum(np.stack(g["o"].to_numpy()), axis=0).reshape(d, d) / n - np.outer(s / n, s / n)
        shrink = min(1.0, (d + 2) / ((n - 1) * (d + 2) + 2)) if n > 1 else 1.0
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / d * np.eye(d)
        w, v = np.linalg.eigh(cov)
        w, v = w[::-1], v[:, ::-1]
        rest = float(w[top:].mean()) if d > top else 0.0
        return pd.DataFrame([(g["k"].iloc[0], n, (s / n).tolist(), w[:top].tolist(), v[:, :top].T.tolist(), rest)], columns=["k", "n", "mean", "eigenvalues", "eigenvectors", "residual"])

    given = profiles.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("x"))
    sums = given.mapInPandas(partial, "k string, n long, s array<double>, o array<double>")
    out = sums.groupBy("k").applyInPandas(solve, "k string, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<array<double>>, residual double")
    return out.where(F.col("n") >= least).withColumnRenamed("k", key)


def _weighted_sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, w, x) -> for each k: rows, weights, weighted sums and outer products of this partition."""
    state: dict = {}
    for p in parts:
        for k, g in p.groupby("k", sort=False):
            x, w = np.stack(g["x"].to_numpy()).astype(float), g["w"].to_numpy(float)
            rows, weight, s, o = state.get(k, (0, 0.0, 0.0, 0.0))
            state[k] = (rows + len(x), weight + w.sum(), s + w @ x, o + (x * w[:, None]).T @ x)
    yield pd.DataFrame([(k, n, w, s.tolist(), o.ravel().tolist()) for k, (n, w, s, o) in state.items()], columns=["k", "n", "w", "s", "o"])


def _shrunk(g: pd.DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Rows, independent units (the sum of weights), weighted mean, and covariance shrunk by the number of units."""
    units = round(float(g["w"].sum()))
    mean = np.sum(np.stack(g["s"].to_numpy()), axis=0) / units
    d = len(mean)
    cov = np.sum(np.stack(g["o"].to_numpy()), axis=0).reshape(d, d) / units - np.outer(mean, mean)
    alpha = min(1.0, (d + 2) / ((units - 1) * (d + 2) + 2))
    return int(g["n"].sum()), units, mean, (1 - alpha) * cov + alpha * np.trace(cov) / d * np.eye(d)


#: Contigs that meet a copy of their taxon's model at once, about.
MODEL_CHUNK = 4096


def balanced_model(contigs: DataFrame, key: str, genome: str, vector: str, rho: str, bp: str, top: int = 15, least: int = 20, points: int = 128) -> DataFrame:
    """key, n_genomes, n_contigs, valid, mean, eigenvalues, eigenvectors, residual, rho_mean, rho_precision and quantiles of the distances
    of the key's own contigs: t2_quantiles (square root within the leading axes), spe_quantiles (squares outside), rho_quantiles.

    Every genome weighs the same, however many contigs it has: a contig's profile counts one over its genome's contigs, dinucleotide
    odds are averaged by length within a genome first, and shrinkage counts genomes. Keys of fewer than `least` genomes are not valid
    and have nulls; contigs without key, profile or odds are left out, null lengths weigh nothing.

    Covariances come from sums that add up; distances meet the model in chunks of a key's contigs, and quantiles are ranks by ranges
    of value, so no key is held by a task.
    """
    from .models import quantile_table

    named = contigs.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col(rho).isNotNull())
    given = named.select(F.col(key).cast("string").alias("k"), F.col(genome).alias("g"), F.col(vector).cast("array<double>").alias("x"), F.col(rho).cast("array<double>").alias("r"), F.coalesce(F.col(bp).cast("double"), F.lit(0.0)).alias("bp"))
    odds = F.array(*[F.coalesce(F.try_divide(F.sum(F.col("r")[i] * F.col("bp")), F.sum("bp")), F.lit(0.0)) for i in range(16)])
    per_genome = given.groupBy("k", "g").agg((1 / F.count(F.lit(1))).alias("w"), odds.alias("r"))
    sums = "k string, n long, w double, s array<double>, o array<double>"
    weights = per_genome.select(F.col("k").alias("wk"), F.col("g").alias("wg"), "w")
    weighted = given.select("k", "g", "x").join(weights, (F.col("k") == F.col("wk")) & F.col("g").eqNullSafe(F.col("wg"))).select("k", "w", "x")

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        k, (n, units, mean, cov) = p["k"].iloc[0], _shrunk(p)
        if units < least:
            return pd.DataFrame([(k, units, n, False, None, None, None, None)], columns=["k", "n_genomes", "n_contigs", "valid", "mean", "eigenvalues", "eigenvectors", "residual"])
        w, v = np.linalg.eigh(cov)
        w, v = w[::-1], v[:, ::-1]
        rest = float(w[top:].mean()) if len(w) > top else 0.0
        return pd.DataFrame([(k, units, n, True, mean.tolist(), w[:top].tolist(), v[:, :top].T.tolist(), rest)], columns=["k", "n_genomes", "n_contigs", "valid", "mean", "eigenvalues", "eigenvectors", "residual"])

    def solve_rho(p: pd.DataFrame) -> pd.DataFrame:
        _, units, mean, cov = _shrunk(p)
        none = units < least or np.trace(cov) <= 0
        return pd.DataFrame([(p["k"].iloc[0], None if units < least else mean.tolist(), None if none else np.linalg.inv(cov).ravel().tolist())], columns=["k", "rho_mean", "rho_precision"])

    shape = "k string, n_genomes long, n_contigs long, valid boolean, mean array<double>, eigenvalues array<double>, eigenvectors array<array<double>>, residual double"
    model = weighted.mapInPandas(_weighted_sums, sums).groupBy("k").applyInPandas(solve, shape)
    odd = per_genome.select("k", F.lit(1.0).alias("w"), F.col("r").alias("x")).mapInPandas(_weighted_sums, sums).groupBy("k").applyInPandas(solve_rho, "k string, rho_mean array<double>, rho_precision array<double>")
    model = model.join(odd, "k")

    def far(of, rows: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        names = ["k", "t2", "spe", "rho"]
        if rows.empty or m.empty:
            return pd.DataFrame(columns=names)
        m = m.iloc[0]
        off, w, v = np.stack(rows["x"].to_numpy()) - np.asarray(m["mean"]), np.asarray(m["eigenvalues"]), np.stack(m["eigenvectors"])
        y = off @ v.T
        used = w >= 1e-9
        t2, spe = np.sqrt((y[:, used] ** 2 / w[used]).sum(axis=1)), np.maximum((off**2).sum(axis=1) - (y**2).sum(axis=1), 0)
        z = np.stack(rows["r"].to_numpy()) - np.asarray(m["rho_mean"])
        by = None if m["rho_precision"] is None else np.sqrt(np.maximum(((z @ np.asarray(m["rho_precision"]).reshape(16, 16)) * z).sum(axis=1), 0))
        return pd.DataFrame({"k": rows["k"].to_numpy(), "t2": t2, "spe": spe, "rho": pd.array([None] * len(rows) if by is None else by, "Float64")}, columns=names)

    chunks = F.ceil(F.col("n_contigs") / MODEL_CHUNK).cast("int")
    valid = model.where("valid")
    spread = given.join(valid.select("k", chunks.alias("chunks")), "k").select("k", F.pmod(F.xxhash64("g", "x"), F.col("chunks")).cast("int").alias("c"), "x", "r")
    copies = valid.select("k", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"), "mean", "eigenvalues", "eigenvectors", "rho_mean", "rho_precision")
    dist = spread.groupBy("k", "c").cogroup(copies.groupBy("k", "c")).applyInPandas(far, "k string, t2 double, spe double, rho double")
    for name in ("t2", "spe", "rho"):
        model = model.join(quantile_table(dist, "k", name, points).withColumnRenamed("quantiles", f"{name}_quantiles"), "k", "left")
    return model.withColumnRenamed("k", key)


def distances(profiles: DataFrame, models: DataFrame, key: str, vector: str) -> DataFrame:
    """t2 (within the leading eigenvectors) and spe (outside them) of each profile against its taxon's model."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t2, spe = [], []
            for x, m, w, v in zip(p["x"], p["mean"], p["eigenvalues"], p["eigenvectors"], strict=True):
                d = np.asarray(x, float) - np.asarray(m, float)
                y = np.stack(v) @ d
                t2.append(float((y**2 / np.maximum(w, 1e-12)).sum()))
                spe.append(float(max(0.0, d @ d - y @ y)))
            yield p[["id"]].assign(t2=t2, spe=spe)

    j = profiles.where(F.col(vector).isNotNull()).join(models.select(key, "mean", "eigenvalues", "eigenvectors"), key)
    return j.select("id", F.col(vector).cast("array<double>").alias("x"), "mean", "eigenvalues", "eigenvectors").mapInPandas(run, "id long, t2 double, spe double")


def mixture_minor(x: np.ndarray, bp: np.ndarray, least_gap: float = 1.6, least_minor: float = 0.03) -> float | None:
    """Share of bp in the smaller of two one-dimensional Gaussians, if they are apart and it spans two contigs or more (one alone may be
    a plasmid or an island); None for fewer than two contigs."""
    if len(x) < 2:
        return None
    mu = np.quantile(x, [0.1, 0.9])
    var, weight = np.full(2, max(x.var(), 1e-12)), np.full(2, 0.5)
    for _ in range(50):
        ll = -0.5 * ((x[:, None] - mu) ** 2 / var + np.log(var)) + np.log(weight)
        r = np.exp(ll - ll.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0) + 1e-12
        mu, weight = (r * x[:, None]).sum(axis=0) / n, n / n.sum()
        var = np.maximum((r * (x[:, None] - mu) ** 2).sum(axis=0) / n, 1e-9)
    first = r.argmax(axis=1) == 0
    share = float(bp[first].sum() / bp.sum())
    minor = min(share, 1 - share)
    spans = int((first if share <= 0.5 else ~first).sum())
    apart = abs(mu[0] - mu[1]) / np.sqrt((var * weight).sum()) >= least_gap
    return minor if apart and minor >= least_minor and spans >= 2 else 0.0


def fiedler_minor(similarity: np.ndarray, bp: np.ndarray) -> float | None:
    """Share of bp on the smaller side of the sign of the second Laplacian eigenvector."""
    if len(bp) < 3:
        return None
    lap = np.diag(similarity.sum(axis=1)) - similarity
    side = np.linalg.eigh(lap)[1][:, 1] >= 0
    share = float(bp[side].sum() / bp.sum())
    return min(share, 1 - share)


def pooled(blocks) -> list[list[float]]:
    """Pool adjacent violators over blocks (lo, hi, sum of y, n) in order of lo. Blocks of a stretch may be pooled before those of the whole."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, s, n = out.pop()
            out[-1] = [out[-1][0], hi, out[-1][2] + s, out[-1][3] + n]
    return out


def knots(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Ends and fitted values of pooled blocks; a block of one x is one knot."""
    at = [(x, s / n) for lo, hi, s, n in blocks for x in ((lo,) if lo == hi else (lo, hi))]
    return np.array([x for x, _ in at]), np.array([y for _, y in at])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and fitted values; interpolation clamps at the ends. Rows of one x count as their mean."""
    at, which, n = np.unique(x, return_inverse=True, return_counts=True)
    return knots(pooled(zip(at, at, np.bincount(which, weights=y), n, strict=True)))


def calibrate(df: DataFrame, x: str, y: str, features: list[str], ridge: float = 1e-4) -> tuple[DataFrame, dict]:
    """Isotonic fit of y on x plus a ridge fit of its residual on features, over all rows with both; estimate column and report.

    Sums per distinct x are pooled within ranges of x, then those blocks on the driver; the ridge fit needs sums of products alone.
    """
    real = lambda c: F.col(c).cast("double")
    rows = df.select(real(x).alias("x"), real(y).alias("y"), F.array(*[F.coalesce(F.nanvl(real(f), F.lit(None)), F.lit(0.0)) for f in features], F.lit(1.0)).alias("f")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def stretch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = (b for p in parts for b in zip(p["x"], p["x"], p["s"], p["n"], strict=True))
        yield pd.DataFrame(pooled(given), columns=["lo", "hi", "s", "n"]).astype({"n": "int64"})

    each = rows.groupBy("x").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    blocks = each.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(stretch, "lo double, hi double, s double, n long").orderBy("lo").collect()
    if not blocks:
        return df.withColumn("estimate", F.lit(None).cast("double")), {"n": 0}
    kx, ky = knots(pooled(blocks))
    wide = len(features) + 1

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aa, ay = np.zeros((wide, wide)), np.zeros(wide)
        for p in parts:
            if len(p):
                a = np.stack(p["f"].to_numpy())
                aa += a.T @ a
                ay += a.T @ (p["y"].to_numpy() - np.interp(p["x"].to_numpy(), kx, ky))
        yield pd.DataFrame({"i": np.arange(wide * wide + wide), "v": np.concatenate([aa.ravel(), ay])})

    # summed by place, so the driver gets as many rows as the sums have numbers
    sums = np.array([r["v"] for r in rows.mapInPandas(products, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    w = np.linalg.solve(sums[: wide * wide].reshape(wide, wide) + ridge * np.eye(wide), sums[wide * wide :])

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s.to_numpy(float), kx, ky)).where(s.notna())

    iso = F.pandas_udf(run, "double")(F.col(x).cast("double"))
    linear = sum((F.coalesce(F.nanvl(real(f), F.lit(None)), F.lit(0.0)) * float(c) for f, c in zip(features, w, strict=False)), F.lit(float(w[-1])))
    out = df.withColumn("estimate", F.least(F.greatest(iso + linear, F.lit(0.0)), F.lit(1.0)))
    off = F.col("estimate") - real(y)
    report = out.where(real(x).isNotNull() & real(y).isNotNull() & ~F.isnan(real(x)) & ~F.isnan(real(y))).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse")).first()
    fit = {"isotonic_x": kx.tolist(), "isotonic_y": ky.tolist(), "ols_weights": w.tolist(), "feature_names": [*features, "1"]}
    return out, fit | {"n": report["n"], "rmse": report["rmse"], "weights": w.tolist(), "training_rmse": report["rmse"], "n_samples": report["n"]}


def greedy_clusters(vectors: np.ndarray, threshold: float = 0.97) -> np.ndarray:
    """First representative, in order, whose cosine reaches the threshold; else the row founds a cluster."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    reps: list[int] = []
    out = np.empty(len(unit), int)
    for i, v in enumerate(unit):
        hit = np.flatnonzero(unit[reps] @ v >= threshold) if reps else []
        if len(hit):
            out[i] = reps[hit[0]]
        else:
            reps.append(i)
            out[i] = i
    return out


def log_likelihoods(profiles: DataFrame, models: DataFrame, host: str, candidates: str) -> DataFrame:
    """id, host, other, own_ll, best_ll, flagged: whether any candidate taxon explains a profile better than its host.

    profiles: id, host, candidates (array of taxa: a family's, so a short list), x. Models, one row a taxon, come as they are needed
    through a join on the taxon; no profile meets a model outside its list.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for x, m, w, v, rest in zip(p["x"], p["mean"], p["eigenvalues"], p["eigenvectors"], p["residual"], strict=True):
                d = np.asarray(x, float) - np.asarray(m, float)
                w = np.maximum(np.asarray(w, float), 1e-12)
                y = np.stack(v) @ d
                noise = max(float(rest), 1e-12)
                spe = max(0.0, float(d @ d - y @ y))
                log_det = float(np.log(w).sum() + (len(d) - len(w)) * np.log(noise))
                out.append(-0.5 * (float((y**2 / w).sum()) + spe / noise + log_det))
            yield p[["id", "host", "taxon"]].assign(ll=out)

    each = profiles.select("id", F.col(host).alias("host"), F.explode(F.array_union(F.array(F.col(host)), F.col(candidates))).alias("taxon"), F.col("x").cast("array<double>").alias("x"))
    m = models.select(F.col(models.columns[0]).alias("taxon"), "mean", "eigenvalues", "eigenvectors", "residual")
    scored = each.join(m, "taxon").select("id", "host", "taxon", "x", "mean", "eigenvalues", "eigenvectors", "residual").mapInPandas(run, "id long, host string, taxon string, ll double")
    own = F.max(F.when(F.col("taxon") == F.col("host"), F.col("ll"))).alias("own_ll")
    other = F.when(F.col("taxon") != F.col("host"), F.struct("ll", "taxon"))
    g = scored.groupBy("id", "host").agg(own, F.max(other).alias("o"))
    return g.select("id", "host", F.col("o.taxon").alias("other"), "own_ll", F.col("o.ll").alias("best_ll"), (F.col("o.ll") > F.col("own_ll")).alias("flagged"))
