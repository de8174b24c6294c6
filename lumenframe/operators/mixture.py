"""Gaussian mixtures of colour fractions, robust covariances, assignment, separability.

Fits are loops of one aggregation each: responsibilities are column
expressions with the parameters as literals, sufficient statistics come back
as one row for each component.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.functions.exprs import weighted_mean
from lumenframe.operators import cluster
from lumenframe.runtime import checkpointed


@dataclass(frozen=True)
class Mixture:
    """Weights, means (k, d) and covariances (k, d, d) over named columns."""

    columns: tuple[str, ...]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    converged: bool = True

    @property
    def k(self) -> int:
        return len(self.weights)


def _squared(columns: Sequence[Column], mean: np.ndarray, covariance: np.ndarray) -> Column:
    """Squared Mahalanobis distance."""
    inv = np.linalg.inv(covariance)
    d = [c - float(m) for c, m in zip(columns, mean)]
    out = F.lit(0.0)
    for i, a in enumerate(d):
        for j, b in enumerate(d):
            out = out + a * b * float(inv[i, j])
    return out


def log_densities(model: Mixture) -> list[Column]:
    """log(weight * density) of each component."""
    columns = [F.col(c) for c in model.columns]
    out = []
    for w, m, s in zip(model.weights, model.means, model.covariances):
        norm = math.log(max(float(w), 1e-300)) - 0.5 * (len(m) * math.log(2 * math.pi) + float(np.linalg.slogdet(s)[1]))
        out.append(norm - 0.5 * _squared(columns, m, s))
    return out


def with_posteriors(rows: DataFrame, model: Mixture) -> DataFrame:
    """Add ``posterior`` (array), ``likely`` (arg max, ties to the first) and ``confidence``."""
    logs = F.array(*log_densities(model))
    out = rows.withColumn("l__", logs).withColumn("top__", F.array_max("l__"))
    out = out.withColumn("z__", F.aggregate("l__", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top__"))))
    post = F.transform("l__", lambda x: F.exp(x - F.col("top__")) / F.col("z__"))
    out = out.withColumn("posterior", post)
    return out.withColumns({"likely": (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"), "confidence": F.array_max("posterior")}).drop("l__", "top__", "z__")


def _moments(resp: Sequence[Column], columns: Sequence[str], centre: np.ndarray | None = None) -> list[Column]:
    out = []
    for k, r in enumerate(resp):
        out.append(F.sum(r).alias(f"n_{k}"))
        for i, a in enumerate(columns):
            out.append(F.sum(r * F.col(a)).alias(f"s_{k}_{i}"))
            for j in range(i, len(columns)):
                x = F.col(a) - (float(centre[k, i]) if centre is not None else 0.0)
                y = F.col(columns[j]) - (float(centre[k, j]) if centre is not None else 0.0)
                out.append(F.sum(r * x * y).alias(f"q_{k}_{i}_{j}"))
    return out


def _read(row, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([row[f"n_{c}"] or 0.0 for c in range(k)])
    s = np.array([[row[f"s_{c}_{i}"] or 0.0 for i in range(d)] for c in range(k)])
    q = np.zeros((k, d, d))
    for c in range(k):
        for i in range(d):
            for j in range(i, d):
                q[c, i, j] = q[c, j, i] = row[f"q_{c}_{i}_{j}"] or 0.0
    return n, s, q


def fit_em(rows: DataFrame, columns: Sequence[str], means: np.ndarray, covariance_type: str = "full", rounds: int = 100, tolerance: float = 1e-6, weight: str | None = None, fixed_means: bool = False, covariances: np.ndarray | None = None, floor: float = 1e-6) -> Mixture:
    """Expectation maximisation; ``fixed_means`` moves weights and covariances only, with an eigenvalue floor."""
    columns = tuple(columns)
    means = np.asarray(means, dtype=float)
    k, d = means.shape
    data = checkpointed(rows.select(*columns, *([weight] if weight else [])).dropna())
    n_all = data.count()
    if not n_all:
        return Mixture(columns, np.full(k, 1 / k), means, np.tile(np.eye(d) * 0.005, (k, 1, 1)), False)
    if covariances is None:
        spread = data.agg(*[F.var_pop(c) for c in columns]).first()
        covariances = np.tile(np.diag([max(v, floor) for v in spread]), (k, 1, 1)) if not fixed_means else np.tile(np.eye(d), (k, 1, 1))
    model, last, converged = Mixture(columns, np.full(k, 1 / k), means, np.asarray(covariances, dtype=float)), -math.inf, False
    for _ in range(rounds):
        post = with_posteriors(data, model)
        w = F.col(weight) if weight else F.lit(1.0)
        logs = F.array(*log_densities(model))
        likelihood = F.sum(w * (F.array_max(logs) + F.ln(F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(logs))))))
        resp = [F.col("posterior")[c] * w for c in range(k)]
        row = post.agg(*_moments(resp, columns, model.means if fixed_means else None), likelihood.alias("ll"), F.sum(w).alias("w")).first()
        n, s, q = _read(row, k, d)
        safe = np.maximum(n, 1e-12)
        if fixed_means:
            new_means, new_cov = model.means, q / safe[:, None, None]
        else:
            new_means = s / safe[:, None]
            new_cov = q / safe[:, None, None] - np.einsum("ki,kj->kij", new_means, new_means)
        model = Mixture(columns, n / row.w, new_means, np.array([_shaped(c, covariance_type, floor) for c in new_cov]))
        if abs(row.ll - last) <= tolerance * max(1.0, abs(row.ll)):
            converged = True
            break
        last = row.ll
    return Mixture(columns, model.weights, model.means, model.covariances, converged)


def _shaped(c: np.ndarray, kind: str, floor: float) -> np.ndarray:
    if kind == "diag":
        c = np.diag(np.diag(c))
    elif kind == "spherical":
        c = np.eye(len(c)) * np.trace(c) / len(c)
    value, vector = np.linalg.eigh((c + c.T) / 2)
    return (vector * np.maximum(value, floor)) @ vector.T


def fit_em_weighted(rows: DataFrame, columns: Sequence[str], means: np.ndarray, error: str, rounds: int = 2, **options) -> Mixture:
    """EM, then refits in which rows count round(10 / error) times, normalised inside their likeliest component."""
    model = fit_em(rows, columns, means, **options)
    for _ in range(rounds):
        labelled = with_posteriors(rows.dropna(subset=[*columns, error]), model)
        best = labelled.groupBy("likely").agg(F.max(1.0 / F.col(error)).alias("most__"))
        counted = labelled.join(F.broadcast(best), "likely").withColumn("times__", F.greatest(F.lit(1.0), F.bround(10.0 / F.col(error) / F.col("most__"))))
        model = fit_em(counted, columns, model.means, weight="times__", covariances=model.covariances, **options)
    return model


def fit_deconvolved(rows: DataFrame, columns: Sequence[str], errors: Sequence[str], means: np.ndarray, rounds: int = 100, tolerance: float = 1e-6, cutoff: float = 5.0) -> Mixture:
    """Mixture of the true values behind rows with known errors: each row's density adds diag(error^2).

    Two dimensions; the per-row inverse is closed form.  Rows beyond
    ``cutoff`` of every component take no part.
    """
    a, b = columns
    ea, eb = errors
    data = checkpointed(rows.select(a, b, ea, eb).dropna())
    start = initial_covariances(data, columns, means)
    k = len(means)
    weights, means, cov, last = np.full(k, 1 / k), np.asarray(means, dtype=float), start, -math.inf
    for _ in range(rounds):
        logs, parts, near = [], [], F.lit(False)
        for w, m, s in zip(weights, means, cov):
            t00, t11, t01 = F.col(ea) ** 2 + float(s[0, 0]), F.col(eb) ** 2 + float(s[1, 1]), F.lit(float(s[0, 1]))
            det = t00 * t11 - t01 * t01
            dx, dy = F.col(a) - float(m[0]), F.col(b) - float(m[1])
            u, v = (t11 * dx - t01 * dy) / det, (t00 * dy - t01 * dx) / det
            squared = dx * u + dy * v
            near = near | (squared < cutoff**2)
            logs.append(math.log(max(w, 1e-300)) - math.log(2 * math.pi) - 0.5 * F.ln(det) - 0.5 * squared)
            # mean and spread of the true value given the row
            s00, s01, s11 = float(s[0, 0]), float(s[0, 1]), float(s[1, 1])
            x, y = float(m[0]) + s00 * u + s01 * v, float(m[1]) + s01 * u + s11 * v
            i00, i11, i01 = t11 / det, t00 / det, -t01 / det
            c00 = s00 - (s00 * s00 * i00 + 2 * s00 * s01 * i01 + s01 * s01 * i11)
            c11 = s11 - (s01 * s01 * i00 + 2 * s01 * s11 * i01 + s11 * s11 * i11)
            c01 = s01 - (s00 * s01 * i00 + (s00 * s11 + s01 * s01) * i01 + s01 * s11 * i11)
            parts.append((x, y, c00, c01, c11))
        top = F.greatest(*logs) if k > 1 else logs[0]
        total = sum((F.exp(x - top) for x in logs), F.lit(0.0))
        out = [F.sum(top + F.ln(total)).alias("ll"), F.count("*").alias("n")]
        for i, (lg, (x, y, c00, c01, c11)) in enumerate(zip(logs, parts)):
            r = F.exp(lg - top) / total
            out += [F.sum(r).alias(f"n_{i}"), F.sum(r * x).alias(f"x_{i}"), F.sum(r * y).alias(f"y_{i}"), F.sum(r * (x * x + c00)).alias(f"xx_{i}"), F.sum(r * (x * y + c01)).alias(f"xy_{i}"), F.sum(r * (y * y + c11)).alias(f"yy_{i}")]
        row = data.where(near).agg(*out).first()
        if not row.n:
            return Mixture(tuple(columns), weights, means, cov, False)
        n = np.maximum([row[f"n_{i}"] for i in range(k)], 1e-12)
        means = np.array([[row[f"x_{i}"], row[f"y_{i}"]] for i in range(k)]) / n[:, None]
        second = np.array([[[row[f"xx_{i}"], row[f"xy_{i}"]], [row[f"xy_{i}"], row[f"yy_{i}"]]] for i in range(k)]) / n[:, None, None]
        cov = np.array([_shaped(q - np.outer(m, m), "full", 1e-9) for q, m in zip(second, means)])
        weights = n / row.n
        if abs(row.ll - last) <= tolerance * max(1.0, abs(row.ll)):
            break
        last = row.ll
    return Mixture(tuple(columns), weights, means, cov)


def nearest_mean(columns: Sequence[str], means: np.ndarray) -> Column:
    """Index of the nearest mean (Euclid), ties to the first."""
    d = F.array(*[sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, m)), F.lit(0.0)) for m in means])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def robust_covariances(rows: DataFrame, columns: Sequence[str], means: np.ndarray, start: np.ndarray | None = None, estimator: str = "huber", rounds: int = 50, tolerance: float = 1e-4) -> Mixture:
    """Covariances about fixed means by M-estimation: Huber 1.345 or Tukey 4.685 on scaled distances."""
    means = np.asarray(means, dtype=float)
    k, d = means.shape
    data = checkpointed(rows.select(*columns).dropna().withColumn("own__", nearest_mean(columns, means)))
    cov = np.asarray(start, dtype=float) if start is not None else initial_covariances(data, columns, means)
    scale = math.sqrt(0.6744897501960817)  # square root of the normal upper quartile
    for _ in range(rounds):
        distance = F.lit(None).cast("double")
        for i in range(k):
            distance = F.when(F.col("own__") == i, F.sqrt(_squared([F.col(c) for c in columns], means[i], cov[i]))).otherwise(distance)
        scored = data.withColumn("d__", distance)
        medians = {r.own__: max(r.m / scale, 1e-12) for r in scored.groupBy("own__").agg(F.percentile("d__", F.lit(0.5)).alias("m")).collect()}
        u = F.lit(None).cast("double")
        for i, m in medians.items():
            u = F.when(F.col("own__") == i, F.col("d__") / m).otherwise(u)
        w = F.when(u <= 1.345, 1.0).otherwise(1.345 / u) if estimator == "huber" else F.when(u < 4.685, (1 - (u / 4.685) ** 2) ** 2).otherwise(0.0)
        resp = [F.when(F.col("own__") == i, w).otherwise(0.0) for i in range(k)]
        n, _, q = _read(scored.agg(*_moments(resp, columns, means)).first(), k, d)
        new = np.array([_shaped(q[i] / n[i], "full", 1e-6) if n[i] > d else cov[i] for i in range(k)])
        done = np.abs(new - cov).max() <= tolerance * max(np.abs(cov).max(), 1e-12)
        cov = new
        if done:
            break
    share = {r.own__: r["count"] for r in data.groupBy("own__").count().collect()}
    total = max(1, sum(share.values()))
    return Mixture(tuple(columns), np.array([share.get(i, 0) / total for i in range(k)]), means, cov)


def initial_means(rows: DataFrame, columns: Sequence[str], k: int, method: str = "kmeans", sample: int = 20_000, seed: int = 42) -> np.ndarray:
    """Start means: k-means on a bounded seeded sample, or peaks of each axis's histogram.

    With two components the peaks of the first axis, rising, go with
    those of the second, falling.
    """
    if method == "kmeans":
        key = F.xxhash64(*[F.col(c) for c in columns])
        held = rows.select(*columns).dropna().orderBy(key).limit(sample).collect()
        points = np.array([list(r) for r in held], dtype=float).reshape(-1, len(columns))
        if len(points) < k:  # too few to part: spread around what there is
            middle = points.mean(axis=0) if len(points) else np.full(len(columns), 1 / 3)
            return middle + 0.05 * (np.arange(k) - (k - 1) / 2)[:, None]
        return numeric.kmeans(points, k, seed=seed)
    axes = [axis_peaks(rows, c, k) for c in columns]
    return np.array([[axes[0][i], *[a[::-1][i] if k == 2 else a[i] for a in axes[1:]]] for i in range(k)])


def axis_peaks(rows: DataFrame, column: str, n: int, bins: int = 50) -> list[float]:
    """Centres of the highest peaks of a histogram, rising; quantiles 0.2 to 0.8 if there are fewer."""
    from lumenframe.operators.aggregate import histogram
    from lumenframe.operators.sequence import histogram_peaks

    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or high <= low:
        return [float(low or 0.0)] * n
    peaks = histogram_peaks(histogram(rows, column, low, high, bins), n).collect()
    if len(peaks) < n:
        return list(rows.agg(F.percentile(column, F.array(*[F.lit(float(q)) for q in np.linspace(0.2, 0.8, n)]))).first()[0])
    return sorted(low + (p.bin + 0.5) * (high - low) / bins for p in peaks)


def initial_covariances(rows: DataFrame, columns: Sequence[str], means: np.ndarray, errors: Sequence[str] = (), core: float | None = None, scale: float = 1.0) -> np.ndarray:
    """Second moments about the start means of the rows nearest to each.

    Over 20 rows, else 0.005 on the diagonal; over 50 only the ``core``
    share closest to the mean; plus the mean squared error, capped at half.
    """
    means = np.asarray(means, dtype=float)
    k, d = means.shape
    own = rows.select(*columns, *errors).dropna(subset=list(columns)).withColumn("own__", nearest_mean(columns, means))
    distance = F.lit(0.0)
    for i in range(k):
        distance = F.when(F.col("own__") == i, F.sqrt(sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, means[i])), F.lit(0.0)))).otherwise(distance)
    own = own.withColumn("d__", distance)
    if core is not None:
        limits = own.groupBy("own__").agg(F.count("*").alias("n__"), F.percentile("d__", F.lit(core)).alias("p__"))
        own = own.join(F.broadcast(limits), "own__").where((F.col("n__") <= 50) | (F.col("d__") <= F.col("p__")))
    resp = [F.when(F.col("own__") == i, 1.0).otherwise(0.0) for i in range(k)]
    extra = [F.avg(F.when(F.col("own__") == i, F.col(e) ** 2)).alias(f"e_{i}_{j}") for i in range(k) for j, e in enumerate(errors)]
    row = own.agg(*_moments(resp, columns, means), *extra).first()
    n, _, q = _read(row, k, d)
    out = []
    for i in range(k):
        c = q[i] / n[i] if n[i] > 20 else np.eye(d) * 0.005
        for j in range(len(errors)):
            c[j, j] += min(row[f"e_{i}_{j}"] or 0.0, 0.5 * c[j, j])
        out.append(_shaped(c * scale, "full", 1e-6))
    return np.array(out)


FITS = ("EM", "EM_weighted", "fixed", "deconvolution")


def unmix(locs: DataFrame, k: int, columns: Sequence[str] = ("A_R", "A_G"), confidence: float | None = 0.9, false_positive_rate: float | None = None, method: str = "EM", start: str = "kmeans", means: np.ndarray | None = None) -> tuple[DataFrame, Mixture]:
    """Assign rows to dyes: ``channel`` (-1 below the confidence or beyond the 0.999 quantile), posteriors, distance.

    Errors that the table lacks are sqrt(max(photons, 1)) / photons or 5 %.
    """
    errors = [f"{c}_err" for c in columns]
    for c, e in zip(columns, errors):
        if e not in locs.columns:
            made = F.sqrt(F.greatest(F.col("photons"), F.lit(1.0))) / F.greatest(F.col("photons"), F.lit(1.0)) if "photons" in locs.columns else F.abs(c) * 0.05
            locs = locs.withColumn(e, made)
    means = initial_means(locs, columns, k, start) if means is None else np.asarray(means, dtype=float)
    if method == "EM":
        model = fit_em(locs, columns, means)
    elif method == "EM_weighted":
        spread = F.sqrt(sum((F.col(e) ** 2 for e in errors), F.lit(0.0)))
        model = fit_em_weighted(locs.withColumn("spread__", spread), columns, means, "spread__")
    elif method == "fixed":
        model = fit_em(locs, columns, means, fixed_means=True, covariances=initial_covariances(locs, columns, means, errors))
    elif method == "deconvolution":
        model = fit_deconvolved(locs, columns, errors, means)
    else:
        raise ValueError(f"unknown fit {method}; known: {', '.join(FITS)}")
    limit = confidence if false_positive_rate is None else 1 - false_positive_rate / k
    scored = with_posteriors(locs, model)
    squared = F.lit(0.0)
    for i in range(k):
        squared = F.when(F.col("likely") == i, _squared([F.col(c) for c in columns], model.means[i], model.covariances[i])).otherwise(squared)
    sure = F.col("confidence") >= limit
    out = scored.withColumn("mahalanobis", F.when(sure, F.sqrt(squared)).otherwise(0.0))
    far = F.col("mahalanobis") > math.sqrt(numeric.chi2_quantile(0.999, len(columns)))
    return out.withColumn("channel", F.when(sure & ~far, F.col("likely")).otherwise(-1)), model


def unmix_by_cluster(locs: DataFrame, k: int, d: float, least: int, columns: Sequence[str] = ("A_R", "A_G"), confidence: float = 0.9, keys: Sequence[str] = ("fov_index",)) -> tuple[DataFrame, Mixture]:
    """Joint clusters are unmixed by their mean colour and pass it to their rows.

    ``assignment_code``: 0 by cluster, 1 an isolated row that is sure, 2 not assigned.
    """
    rows = cluster.joint_clusters(locs, d, least, spectral=columns, keys=keys)
    means = rows.where("cluster_id >= 0").groupBy(*keys, "cluster_id").agg(*[weighted_mean(F.col(c), 1.0 / F.col(f"{c}_err") ** 2).alias(c) for c in columns])
    means = checkpointed(means)
    start = initial_means(means, columns, k)
    model = fit_em(means, columns, start)
    labelled = with_posteriors(means, model).select(*keys, "cluster_id", F.col("likely").alias("by_cluster"))
    own = with_posteriors(rows, model).join(labelled, [*keys, "cluster_id"], "left")
    code = F.when(F.col("by_cluster").isNotNull(), 0).when(F.col("confidence") >= confidence, 1).otherwise(2)
    out = own.withColumn("assignment_code", code)
    channel = F.when(F.col("assignment_code") == 0, F.col("by_cluster")).when(F.col("assignment_code") == 1, F.col("likely")).otherwise(-1)
    return out.withColumn("channel", channel).drop("by_cluster"), model


def sampled_confusion(spark: SparkSession, model: Mixture, n: int = 100_000, seed: int = 42) -> DataFrame:
    """Seeded draws of each component and where Bayes puts them: ``true``, ``assigned``, ``share``."""
    base = spark.range(n, numPartitions=8)
    d = len(model.columns)
    parts = None
    for i, (m, s) in enumerate(zip(model.means, model.covariances)):
        low = np.linalg.cholesky(s)
        z = [F.randn(seed * 1000 + i * d + j).alias(f"z{j}") for j in range(d)]
        part = base.select(F.lit(i).alias("true"), *z)
        cols = [(sum((F.col(f"z{b}") * float(low[a, b]) for b in range(a + 1)), F.lit(0.0)) + float(m[a])).alias(c) for a, c in enumerate(model.columns)]
        part = part.select("true", *cols)
        parts = part if parts is None else parts.union(part)
    counts = with_posteriors(parts, model).groupBy("true", F.col("likely").alias("assigned")).agg(F.count("*").alias("n"))
    return counts.select("true", "assigned", (F.col("n") / n).alias("share"))


def accuracy(confusion: DataFrame, model: Mixture) -> float:
    """Share of right assignments, weighted by the components."""
    return float(sum(r.share * model.weights[r.true] for r in confusion.where(F.col("true") == F.col("assigned")).collect()))


def misidentification_by_photons(accumulated: DataFrame, model: Mixture, bins: Sequence[float], n: int = 20_000, earliest: bool = True, estimator: str = "huber") -> DataFrame:
    """One row for each photon bin: rows, accuracy of assignment with the bin's own covariances."""
    from lumenframe.operators.sequence import photon_bins

    spark = accumulated.sparkSession
    chosen = checkpointed(photon_bins(accumulated, bins, earliest=earliest))
    out = []
    for b in range(len(bins) - 1):
        part = chosen.where(F.col("photon_bin") == b)
        rows = part.count()
        if rows < 5 * model.k:
            out.append((b, float(bins[b]), float(bins[b + 1]), rows, None))
            continue
        own = robust_covariances(part, model.columns, model.means, model.covariances, estimator)
        out.append((b, float(bins[b]), float(bins[b + 1]), rows, accuracy(sampled_confusion(spark, own, n), own)))
    return spark.createDataFrame(out, "photon_bin int, low double, high double, n_molecules long, accuracy double")


def dye_gaussians(colours: DataFrame, columns: Sequence[str] = ("A_R", "A_G"), dye: str = "dye_name") -> tuple[list[str], Mixture]:
    """Mean and covariance of each dye's colours, with equal weights."""
    out = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)] + [F.covar_samp(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    rows = colours.groupBy(dye).agg(*out).orderBy(dye).collect()
    d = len(columns)
    means = np.array([[r[f"m_{i}"] for i in range(d)] for r in rows])
    cov = np.array([[[r[f"c_{i}_{j}"] for j in range(d)] for i in range(d)] for r in rows])
    return [r[dye] for r in rows], Mixture(tuple(columns), np.full(len(rows), 1 / max(1, len(rows))), means, np.array([_shaped(c, "full", 1e-9) for c in cov]))


def separability(spark: SparkSession, names: Sequence[str], model: Mixture, n: int = 20_000, seed: int = 42) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """Confusion of all dyes, and accuracy of each pair from its own rows and columns of it."""
    table = sampled_confusion(spark, model, n, seed)
    share = {(r.true, r.assigned): r.share for r in table.collect()}
    pairs = {}
    for i, j in itertools.combinations(range(model.k), 2):
        right = [share.get((a, a), 0.0) / max(1e-12, share.get((a, i), 0.0) + share.get((a, j), 0.0)) for a in (i, j)]
        pairs[names[i], names[j]] = sum(right) / 2
    return table, pairs


def best_dyes(names: Sequence[str], pairs: dict[tuple[str, str], float], k: int) -> tuple[tuple[str, ...], float]:
    """The k dyes whose worst pair is best; of several such sets the first in the order of ``names``.

    The answer's worst pair is one of the pairs' values: the largest for which
    k dyes exist that all reach it, pair by pair.
    """
    of = lambda a, b: pairs.get((a, b), pairs.get((b, a), 0.0))
    worst = lambda s: min(of(a, b) for a, b in itertools.combinations(s, 2))
    if k < 2:
        return tuple(names[:k]), 1.0
    n, values = len(names), sorted({of(a, b) for a, b in itertools.combinations(names, 2)})

    def reaching(least: float) -> tuple[str, ...] | None:
        """The first k dyes whose pairs all reach ``least``, by going back where too few are left."""
        friends = [{j for j in range(n) if j > i and of(names[i], names[j]) >= least} for i in range(n)]

        def go(chosen: list[int], rest: set[int]) -> list[int] | None:
            if len(chosen) == k:
                return chosen
            for i in sorted(rest):
                if len(chosen) + len(rest) < k:
                    return None
                found = go([*chosen, i], rest & friends[i])
                if found:
                    return found
                rest = rest - {i}
            return None

        found = go([], set(range(n)))
        return found and tuple(names[i] for i in found)

    low, high, best = 0, len(values) - 1, tuple(names[:k])
    while low <= high:
        mid = (low + high) // 2
        found = reaching(values[mid])
        low, high, best = (mid + 1, high, found) if found else (low, mid - 1, best)
    return best, worst(best)


def nena(histogram: DataFrame, bin_size: float = 0.001, d_max: float = 1.0) -> tuple[float, float]:
    """Localisation precision from next-frame distances: fits the density of
    distances between repeats of a molecule plus a Gaussian for its neighbours; returns the
    precision and the spread of residuals.  NaN without counts."""
    counts = np.zeros(int(round(d_max / bin_size)))
    for r in histogram.collect():
        counts[r.bin] = r.n
    if counts.sum() == 0:
        return math.nan, math.nan
    d = (np.arange(len(counts)) + 0.5) * bin_size
    area, start = counts.sum() * bin_size, d[int(np.argmax(counts))] or bin_size

    def model(p: np.ndarray) -> np.ndarray:
        s, a, b, ac, dc, sc = p
        return a * d / (2 * s * s) * np.exp(-d * d / (4 * s * s)) + ac / (abs(sc) * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((d - dc) / sc) ** 2) + b * d

    p, _ = numeric.least_squares(lambda q: model(q) - counts, np.array([start, area, counts[-1] / d[-1] if d[-1] else 0.0, area / 10, d_max / 2, d_max / 4]))
    return abs(float(p[0])), float(np.std(model(p) - counts))
