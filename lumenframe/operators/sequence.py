"""Ordered operators: running sums, segments, gaps, change points, displacements."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.schema import AMPLITUDES


def photon_accumulation(locs: DataFrame, molecule: str = "molecular_index", keys: Sequence[str] = ()) -> DataFrame:
    """One row for each molecule and number of frames so far.

    Running photon sum; amplitudes weighted by 1/(error^2 + 1e-12) and their
    errors; running means and population spreads of positions and widths.
    """
    order = Window.partitionBy(*keys, molecule).orderBy("frame", "loc_id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.row_number().over(order).cast("int").alias("frames_accumulated"), F.sum("photons").over(run).alias("photons_accumulated")]
    for c in AMPLITUDES:
        w = 1.0 / (F.col(f"{c}_err") * F.col(f"{c}_err") + 1e-12)
        out += [(F.sum(F.col(c) * w).over(run) / F.sum(w).over(run)).alias(c), (1.0 / F.sqrt(F.sum(w).over(run))).alias(f"{c}_err")]
    for c in ("xc", "yc"):
        out += [F.avg(c).over(run).alias(f"{c}_mean"), F.stddev_pop(c).over(run).alias(f"{c}_std")]
    for c in ("s_x", "s_y"):
        out.append(F.avg(c).over(run).alias(f"{c}_mean"))
    kept = [*keys, molecule, "frame", "loc_id", *[c for c in ("fov_index", "fov_name") if c in locs.columns and c not in keys]]
    return locs.select(*kept, *out)


def global_index(locs: DataFrame, fov: str = "fov_index", local: str = "molecular_index") -> DataFrame:
    """Number molecules of all fields of view without gaps between them.

    Each field's molecules are shifted by the count of those before; only
    counts, a row for each field, are ordered together.
    """
    local_ids = locs.where(F.col(local) >= 0).groupBy(fov, local).agg(F.lit(1).alias("one"))
    within = F.row_number().over(Window.partitionBy(fov).orderBy(local)) - 1
    numbered = local_ids.select(fov, local, within.alias("within__"))
    counts = numbered.groupBy(fov).agg(F.count("*").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy(fov).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.select(fov, before.alias("start__"))
    ids = numbered.join(start, fov).select(fov, local, (F.col("start__") + F.col("within__")).alias("global__"))
    return locs.join(ids, [fov, local]).withColumn(local, F.col("global__")).drop("global__")


def segment_bounds(spark, n_frames: int, size: int) -> DataFrame:
    """Bounds 0, s, 2s ... n as rows ``segment``, ``start``, ``stop``."""
    n = n_segments(n_frames, size)
    edges = [int(x) for x in np.linspace(0, n_frames - 1, n + 1)]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))], "segment int, start int, stop int")


def n_segments(n_frames: int, size: int) -> int:
    """Rounded half to even."""
    return round(n_frames / size)


def frame_segment(frame: Column, size: int) -> Column:
    return F.floor(frame / size).cast("int")


def sliding_segments(locs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each row in every window of ``size`` frames that holds it; windows start every ``size - overlap``."""
    step = size - overlap
    if step <= 0:
        raise ValueError("windows must advance")
    first = F.greatest(F.ceil((F.col("frame") - size + 1) / step), F.lit(0))
    return locs.withColumn("segment", F.explode(F.sequence(first, F.floor(F.col("frame") / step))))


def standard_frames(locs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frames from 1 on."""
    return locs.withColumn("frame", F.col("frame") + 1 - F.min("frame").over(Window.partitionBy(*keys)))


def offset_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Files one after another: each one's frames follow the last of the files before."""
    out, shift = None, 0
    for part in parts:
        moved = part.withColumn("frame", (F.col("frame") + shift).cast("int"))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        top = part.agg(F.max("frame")).first()[0]
        shift += int(top) + 1 if top is not None else 0
    return out


def offset_fields(locs: DataFrame, key: str = "fov_index") -> DataFrame:
    """``offset_union`` of any number of fields of view held in one table, in the order of ``key``.

    Only the last frames, a row for each field, are ordered together.
    """
    tops = locs.groupBy(key).agg((F.max("frame") + 1).alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = tops.select(key, before.alias("start__"))
    return locs.join(start, key).withColumn("frame", (F.col("frame") + F.col("start__")).cast("int")).drop("start__")


def fill_linear(values: DataFrame, order: str, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fill nulls between known rows by a straight line; ends hold the nearest, all null gives 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(column).isNotNull() & ~F.isnan(column), F.struct(F.col(order).alias("o"), F.col(column).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = F.when(before["o"] == after["o"], before["v"]).otherwise(before["v"] + (after["v"] - before["v"]) * (F.col(order) - before["o"]) / (after["o"] - before["o"]))
    return values.withColumn(column, F.coalesce(line, before["v"], after["v"], F.lit(0.0)))


def interpolate(values: DataFrame, targets: DataFrame, order: str, column: str, method: str = "linear", keys: Sequence[str] = ()) -> DataFrame:
    """Values at target positions; outside the known range the ends hold.

    ``nearest`` takes the next known position at or after the target.
    ``cubic`` needs four points of a key, else it is linear.
    """
    if method == "cubic":
        return _spline(values, targets, order, column, keys)
    rows = values.select(*keys, order, column, F.lit(0).alias("asked__")).unionByName(targets.select(*keys, order, F.lit(None).cast("double").alias(column), F.lit(1).alias("asked__")))
    if method == "nearest":
        w = Window.partitionBy(*keys).orderBy(order, F.col("asked__").desc())
        ahead = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        behind = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        filled = rows.withColumn(column, F.coalesce(ahead, behind))
    else:
        filled = fill_linear(rows, order, column, keys)
    return filled.where("asked__ = 1").drop("asked__")


def _spline(values: DataFrame, targets: DataFrame, order: str, column: str, keys: Sequence[str]) -> DataFrame:
    keys = list(keys) or ["all__"]
    a, b = (d if "all__" not in keys else d.withColumn("all__", F.lit(0)) for d in (values, targets))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.select(*keys, order).schema)

    def evaluate(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = known.dropna(subset=[column]).sort_values(order)
        at = np.clip(asked[order].to_numpy(float), known[order].min(), known[order].max()) if len(known) else asked[order].to_numpy(float)
        return asked[[*keys, order]].assign(**{column: numeric.spline(known[order], known[column], at)})

    out = a.select(*keys, order, column).groupBy(*keys).cogroup(b.select(*[F.col(c).alias(c) for c in (*keys, order)]).groupBy(*keys)).applyInPandas(evaluate, f"{fields}, `{column}` double")
    return out.drop("all__")


# change points


def poisson_split(series: DataFrame, keys: Sequence[str] = ("trace",)) -> DataFrame:
    """Best single split of counts by the Poisson likelihood ratio: ``split`` (rows before it), ``score``."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = series.select(*keys, "t", F.row_number().over(w.orderBy("t")).alias("k"), F.sum("value").over(order).alias("s"), F.count("*").over(w).alias("n"), F.sum("value").over(w).alias("total"))
    part = lambda s, n: F.when(s > 0, s * F.ln(s / n)).otherwise(0.0)
    s, k, n, total = F.col("s"), F.col("k"), F.col("n"), F.col("total")
    score = 2 * (part(s, k) + part(total - s, n - k) - part(total, n))
    return _best_split(run.where(k < n).withColumn("score", score), keys)


def gaussian_split(series: DataFrame, keys: Sequence[str] = ("trace",), least: int = 2) -> DataFrame:
    """Best single split by the change of variance (with n - 1)."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("value") * F.col("value")
    run = series.select(*keys, "t", F.row_number().over(w.orderBy("t")).alias("k"), F.sum("value").over(order).alias("s"), F.sum(square).over(order).alias("q"), F.count("*").over(w).alias("n"), F.sum("value").over(w).alias("ts"), F.sum(square).over(w).alias("tq"))
    var = lambda q, s, n: F.greatest((q - s * s / n) / (n - 1), F.lit(1e-12))
    s, q, k, n, ts, tq = (F.col(c) for c in ("s", "q", "k", "n", "ts", "tq"))
    inner = run.where((k >= least) & (n - k >= least))
    score = n * F.ln(var(tq, ts, n)) - k * F.ln(var(q, s, k)) - (n - k) * F.ln(var(tq - q, ts - s, n - k))
    return _best_split(inner.withColumn("score", score), keys)


def _best_split(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first split whose score, to nine places, is the largest: mirrored splits differ in the last bits alone."""
    best = F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("k")).alias("m"))).alias("best")
    return scored.groupBy(*keys).agg(best, F.max("score").alias("score")).select(*keys, (-F.col("best.m")).alias("split"), "score")


def scan_threshold(n: int, alpha: float = 0.05, d: int = 1) -> float:
    """Critical value of the maximal likelihood ratio over splits, by bisection of its tail bound."""
    if n < 4:
        return math.inf
    h = math.log(n) ** 1.5 / n
    t = math.log(max((1 - h) ** 2 / h**2, 1.0 + 1e-9))

    def tail(x: float) -> float:
        return x**d * math.exp(-x * x / 2) / (2 ** (d / 2) * math.gamma(d / 2)) * (t - d * t / (x * x) + 4 / (x * x)) - alpha

    return numeric.bisect(tail, max(1.0, math.sqrt(d) + 0.5), 60.0) ** 2


def gaussian_threshold(n: Column, alpha: float = 0.05) -> Column:
    """Closed form by the extreme-value limit of the scan statistic."""
    ll = F.ln(F.ln(n))
    a, b = F.sqrt(2 * ll), 2 * ll + 0.5 * F.ln(ll) - 0.5 * math.log(math.pi)
    return ((-math.log(-0.5 * math.log(1 - alpha)) + b) / a) ** 2


def change_points(series: DataFrame, keys: Sequence[str] = ("trace",), method: str = "binary", least: int = 3, alpha: float = 0.05, penalty: float | None = None) -> DataFrame:
    """Change points of each trace as an array that ends with its length.

    ``binary`` splits recursively where the Poisson likelihood ratio passes
    the threshold of the part's length; ``pelt`` is optimal for Poisson
    cost with that threshold as penalty; ``level`` is PELT on squared error
    with penalty n * variance * ``penalty``, the variance from the last
    min(100, n / 2) samples.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*keys).schema)

    def detect(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("t")["value"].to_numpy(float)
        found = find_change_points(y, method, least, alpha, penalty)
        return pd.DataFrame([{**{k: part[k].iloc[0] for k in keys}, "change_points": found}])

    return series.groupBy(*keys).applyInPandas(detect, f"{fields}, change_points array<int>")


def find_change_points(y: np.ndarray, method: str = "binary", least: int = 3, alpha: float = 0.05, penalty: float | None = None) -> list[int]:
    n = len(y)
    if method == "pelt":
        return numeric.pelt(y, numeric.poisson_cost(y), scan_threshold(n, alpha) / 2, least)
    if method == "level":
        tail = y[-max(2, min(100, n // 2)) :]
        return numeric.pelt(y, numeric.l2_cost(y), n * float(np.var(tail)) * (penalty if penalty is not None else 1.0), least)
    cost, found = numeric.poisson_cost(y), {n}

    def split(a: int, b: int) -> None:
        if b - a < 2 * least:
            return
        scores = [2 * (cost(a, b) - cost(a, i) - cost(i, b)) for i in range(a + least, b - least + 1)]
        i = int(np.argmax(scores))
        if scores[i] > scan_threshold(b - a, alpha):
            found.add(a + least + i)
            split(a, a + least + i)
            split(a + least + i, b)

    split(0, n)
    return sorted(found)


def segment_means(series: DataFrame, points: DataFrame, keys: Sequence[str] = ("trace",)) -> DataFrame:
    """Each sample with the mean of its segment."""
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1).alias("k__")
    rows = series.select("*", place).join(points.select(*keys, "change_points"), list(keys))
    rows = rows.withColumn("segment", F.size(F.filter("change_points", lambda c: c <= F.col("k__"))))
    return rows.withColumn("segment_mean", F.avg("value").over(Window.partitionBy(*keys, "segment"))).drop("k__", "change_points")


def frames_before_last_change(points: DataFrame, keys: Sequence[str] = ("trace",)) -> DataFrame:
    """Frames [0, last change) of traces that change at all."""
    changed = points.where(F.size("change_points") > 1).withColumn("last__", F.element_at("change_points", -2))
    return changed.select(*keys, F.explode(F.sequence(F.lit(0), F.col("last__") - 1)).alias("frame"))


def roi_traces(pixels: DataFrame, puncta: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the window around each punctum in each frame.

    Windows are dealt to their pixels, so the join is on equal pixels; ``keys``
    (a file, a field of view) are columns of both sides that must agree too.
    """
    half = size // 2
    span = F.sequence(F.lit(-half), F.lit(size - 1 - half))
    at = puncta.select(*keys, "punctum", F.floor("yc").cast("int").alias("y0"), F.floor("xc").cast("int").alias("x0")).withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    wanted = at.select(*keys, "punctum", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))
    return pixels.join(wanted, [*keys, "y", "x"]).groupBy(*keys, "punctum", "frame").agg(F.sum("value").alias("value"))


def molecule_traces(pixels: DataFrame, locs: DataFrame, size: int, label: str = "cluster_id") -> DataFrame:
    """The same around the mean position of each molecule, truncated to whole pixels."""
    centres = locs.where(F.col(label) >= 0).groupBy(label).agg(F.avg("xc").alias("xc"), F.avg("yc").alias("yc")).withColumnRenamed(label, "punctum")
    return roi_traces(pixels, centres, size)


# displacements


def msd(trajectories: DataFrame, keys: Sequence[str] = ("molecule",), max_lag: int | None = None) -> DataFrame:
    """Mean square displacement by lag over overlapping pairs; by default up to a quarter of the rows."""
    w = Window.partitionBy(*keys)
    rows = trajectories.select(*keys, "x", "y", F.row_number().over(w.orderBy("t")).alias("i"), F.count("*").over(w).alias("n"))
    lags = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int") if max_lag is None else F.lit(max_lag)))
    later = rows.select(*keys, F.col("i").alias("j"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = rows.select(*keys, "i", "x", "y", F.explode(lags).alias("lag")).withColumn("j", F.col("i") + F.col("lag")).join(later, [*keys, "j"])
    return pairs.groupBy(*keys, "lag").agg(F.avg((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2).alias("msd"), F.count("*").alias("n_pairs"))


def msd_all_lags(trajectories: DataFrame, keys: Sequence[str] = ("molecule",)) -> DataFrame:
    """All lags at once by FFT, a trajectory to a task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trajectories.select(*keys).schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = numeric.msd_fft(part.sort_values("t")[["x", "y"]].to_numpy(float))
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "lag": np.arange(len(out)), "msd": out})

    return trajectories.groupBy(*keys).applyInPandas(run, f"{fields}, lag int, msd double")


def diffusion_from_msd(msds: DataFrame, dt: float, dims: int = 2, points: int = 4, keys: Sequence[str] = ("molecule",)) -> DataFrame:
    """Slope of the first points over 2 * dims."""
    return msds.where(F.col("lag").between(1, points)).groupBy(*keys).agg((F.regr_slope(F.col("msd"), F.col("lag") * dt) / (2 * dims)).alias("D"))


def diffusion_optimal(trajectories: DataFrame, dt: float, blur: float = 1 / 6, dims: int = 2, rounds: int = 100, least: int = 5, keys: Sequence[str] = ("molecule",)) -> DataFrame:
    """Least squares on the optimal number of lags, found by iteration; NaN if short or not settled."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trajectories.select(*keys).schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r = part.sort_values("t")[["x", "y"]].to_numpy(float)
        d, error = optimal_fit(r, dt, blur, dims, rounds, least)
        return pd.DataFrame([{**{k: part[k].iloc[0] for k in keys}, "D": d, "localisation_error": error}])

    return trajectories.groupBy(*keys).applyInPandas(run, f"{fields}, D double, localisation_error double")


def optimal_points(x: float, n: int) -> tuple[int, int]:
    """Numbers of lags that fit intercept and slope best, by reduced localisation error."""
    if not math.isfinite(x) or x < 0:
        x = 0.0 if x < 0 else 1e6
    la, lb = 3 + math.sqrt(max(0.0, 4.5 * n**0.4 - 8.5)), 0.8 + 0.564 * n
    fa, fb = 2 + 1.6 * x**0.51, 2 + 1.35 * x**0.6
    a = math.floor(fa * la / (fa**3 + la**3) ** (1 / 3))
    b = min(math.floor(lb), math.floor(fb * lb / (fb**3 + lb**3) ** (1 / 3)))
    return max(2, a), max(2, b)


def optimal_fit(r: np.ndarray, dt: float, blur: float, dims: int, rounds: int, least: int) -> tuple[float, float]:
    n = len(r)
    if n < least:
        return math.nan, math.nan
    m = numeric.msd_fft(r)
    p, seen = max(2, n // 10), []
    for _ in range(rounds):
        lags = np.arange(1, min(p, n - 1) + 1)
        if len(lags) < 2:
            return math.nan, math.nan
        slope, intercept = np.polyfit(lags, m[lags], 1)
        x = math.inf if slope <= 0 else max(0.0, intercept / slope + 2 * blur)
        _, new = optimal_points(x, n)
        if new == p or new in seen:
            return slope / (2 * dims * dt), math.sqrt(max(0.0, (intercept + 2 * blur * slope) / (2 * dims)))
        seen.append(p)
        p = new
    return math.nan, math.nan


def drift_reference(frame: Column, n: int) -> Column:
    """Frame held inside the corrected range."""
    return F.least(F.greatest(frame, F.lit(0)), F.lit(n - 1))


def photon_bins(rows: DataFrame, bins: Sequence[float], molecule: str = "molecular_index", earliest: bool = True) -> DataFrame:
    """One row for each molecule and half-open photon bin: the earliest, or the closest to the bin's middle."""
    spark = rows.sparkSession
    edges = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bins[:-1], bins[1:]))], "photon_bin int, low double, high double")
    p = F.col("photons_accumulated")
    met = rows.join(F.broadcast(edges), (p >= F.col("low")) & (p < F.col("high")))
    order = [F.col("frames_accumulated")] if earliest else [F.abs(p - (F.col("low") + F.col("high")) / 2), F.col("frames_accumulated")]
    place = F.row_number().over(Window.partitionBy(molecule, "photon_bin").orderBy(*order))
    return met.withColumn("place__", place).where("place__ = 1").drop("place__")


def histogram_peaks(hist: DataFrame, n_peaks: int, apart: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The highest local maxima of a histogram (``bin``, ``n``), taller first, at least ``apart`` bins apart."""
    w = Window.partitionBy(*keys).orderBy("bin")
    near = w.rangeBetween(-apart + 1, apart - 1)
    tallest = F.max(F.struct("n", (-F.col("bin")).alias("m"))).over(near)
    peaks = hist.withColumn("t__", tallest).where((F.col("t__.n") == F.col("n")) & (F.col("t__.m") == -F.col("bin"))).drop("t__")
    return peaks.orderBy(F.col("n").desc(), "bin").limit(n_peaks)


def reference_rows(rows: DataFrame, threshold: float, molecule: str = "molecular_index") -> DataFrame:
    """The row with most accumulated photons of each molecule that reaches the threshold."""
    best = F.max_by(F.struct(*rows.columns), F.struct("photons_accumulated", "frames_accumulated")).alias("r")
    return rows.where(F.col("photons_accumulated") >= threshold).groupBy(molecule).agg(best).select("r.*")


def closest_share(rows: DataFrame, group: str = "group", share: float = 0.9, least: int | None = None) -> DataFrame:
    """The closest floor(share * n) rows to each region's mean; regions under ``least`` rows go."""
    w = Window.partitionBy(group)
    d = F.sqrt((F.col("xc") - F.avg("xc").over(w)) ** 2 + (F.col("yc") - F.avg("yc").over(w)) ** 2)
    out = rows.withColumns({"distance": d, "n__": F.count("*").over(w)})
    place = F.row_number().over(w.orderBy("distance", "loc_id"))
    out = out.withColumn("place__", place).where(F.col("place__") <= F.floor(F.col("n__") * share))
    if least is not None:
        out = out.where(F.col("n__") >= least)
    return out.drop("place__", "n__")
