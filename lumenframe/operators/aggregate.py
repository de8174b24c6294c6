"""Aggregations: molecules, linked events, grids, calibration, fit statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.exprs import inverse_error_mean, weighted_mean
from lumenframe.schema import AMPLITUDES, BACKGROUNDS


def exact_percentile(df: DataFrame, column: str | Column, q: float = 0.5, most: int = 2_000_000) -> float | None:
    """Interpolated percentile of all rows, now; None without rows.

    An exact percentile keeps every distinct value in one task, so above
    ``most`` rows the range that holds the wanted ranks is narrowed first:
    approximate percentiles give its ends, counts prove that the ranks lie
    inside, and only what is inside goes on.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double").alias("x")
    part = df.select(x).where("x IS NOT NULL")
    n, below = part.count(), 0
    if not n:
        return None
    place = q * (n - 1)
    ranks, held, reach = (math.floor(place), math.ceil(place)), n, 1e-3
    while held > most:
        r = (ranks[0] - below) / held
        a, b = part.agg(F.percentile_approx("x", [max(0.0, r - reach), min(1.0, r + reach)], 100_000)).first()[0]
        under, inside = part.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x").between(a, b))).first()
        if not (below + under <= ranks[0] and ranks[1] < below + under + inside):
            reach *= 4
            continue
        if a == b:
            return a
        if inside == held:
            break  # it can't be narrowed any more
        part, below, held = part.where(F.col("x").between(a, b)), below + under, inside
    at = [(k - below) / max(1, held - 1) for k in ranks]
    low, high = part.agg(F.percentile("x", F.array(*[F.lit(v) for v in at]))).first()[0]
    return low + (place - ranks[0]) * (high - low)


def molecules(locs: DataFrame, label: str = "molecular_index", keys: Sequence[str] = ()) -> DataFrame:
    """One row for each label >= 0.

    Amplitudes are weighted by 1/error^2, ``photons`` is a sum, ``frames``
    the number of rows, everything else numeric a mean.
    """
    held = locs.where(F.col(label) >= 0)
    out = [F.count("*").alias("frames")]
    for c, t in locs.dtypes:
        if c in (label, *keys) or t not in ("double", "float", "int", "bigint"):
            continue
        if c in AMPLITUDES and f"{c}_err" in locs.columns:
            out.append(weighted_mean(F.col(c), 1.0 / (F.col(f"{c}_err") * F.col(f"{c}_err"))).alias(c))
        elif c == "photons":
            out.append(F.sum(c).alias(c))
        elif c != "frames":
            out.append(F.avg(c).alias(c))
    return held.groupBy(*keys, label).agg(*out)


def finish_clustering(locs: DataFrame, label: str = "cluster_id", offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Molecule and frame tables of labelled rows, noise (-1) dropped; labels start at ``offset``."""
    frames = locs.where(F.col(label) >= 0).withColumn("molecular_index", F.col(label) + offset).drop(label)
    return molecules(frames), frames


def group_count(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n_locs"))


def group_sum(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(column).alias(column))


def group_mean(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(column).cast("float").alias(column))


def group_weighted_mean(df: DataFrame, group: str, column: str, weight: str) -> DataFrame:
    """Weighted mean and sum of weights; no weight gives 0."""
    return df.groupBy(group).agg(F.coalesce(weighted_mean(F.col(column), F.col(weight)), F.lit(0.0)).alias(column), F.sum(weight).alias("weight"))


def group_min_max(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(column).alias("least"), F.max(column).alias("most"))


def group_last(df: DataFrame, group: str, column: str, order: str = "loc_id") -> DataFrame:
    return df.groupBy(group).agg(F.max_by(column, order).alias(column))


def linked_events(locs: DataFrame, n_frames: int, group: str = "link_group", ambiguous: str | None = "frames", keys: Sequence[str] = ()) -> DataFrame:
    """One row for each chain of localisations.

    Positions, widths and amplitudes weighted by 1/error^2 (an error that
    isn't positive counts as the median of the positive ones), photons and
    backgrounds summed, other numbers averaged; ``len`` frames from first to
    last, ``n`` rows, ``photon_rate``.  Events that may have begun before or
    gone on after the movie are dropped: first frame 0, or last frame at
    ``n_frames - 1`` or later ("frames") or ``n_frames`` or later ("movie").
    """
    weighted = [c for c in ("xc", "yc", "s_x", "s_y", *AMPLITUDES) if c in locs.columns and f"{c}_err" in locs.columns]
    good = {c: (F.col(f"{c}_err") > 0) & ~F.isnan(f"{c}_err") for c in weighted}
    poor = locs.agg(*[F.max((~F.coalesce(g, F.lit(False))).cast("int")).alias(c) for c, g in good.items()]).first() if weighted else {}
    medians = {c: exact_percentile(locs.where(good[c]), f"{c}_err") or 1.0 for c in weighted if poor[c]}
    out = [F.min("frame").alias("frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n")]
    for c, t in locs.dtypes:
        if c in ("frame", group, *keys) or t not in ("double", "float", "int", "bigint"):
            continue
        if c in weighted:
            e = F.when(good[c], F.col(f"{c}_err")).otherwise(F.lit(medians[c])) if c in medians else F.col(f"{c}_err")
            out.append(weighted_mean(F.col(c), 1.0 / (e * e)).alias(c))
        elif c in ("photons", "background_photons", *BACKGROUNDS):
            out.append(F.sum(c).alias(c))
        else:
            out.append(F.avg(c).alias(c))
    events = locs.groupBy(*keys, group).agg(*out).withColumn("len", F.col("last_frame") - F.col("frame") + 1)
    if "photons" in locs.columns:
        events = events.withColumn("photon_rate", F.col("photons") / F.col("n"))
    if ambiguous:
        edge = n_frames - 1 if ambiguous == "frames" else n_frames
        events = events.where((F.col("frame") > 0) & (F.col("last_frame") < edge))
    return events


def centre_of_mass(locs: DataFrame, weight: str | None = None, keys: Sequence[str] = (), axes: Sequence[str] = ("xc", "yc")) -> DataFrame:
    """Weighted centroid; without weight the origin."""
    w = F.col(weight) if weight else F.lit(1.0)
    return locs.groupBy(*keys).agg(*[F.coalesce(weighted_mean(F.col(a), w), F.lit(0.0)).alias(a) for a in axes])


def bin_index(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value on equal bins, the last closed on the right; null outside."""
    i = F.floor((x - low) * (bins / (high - low)))
    return F.when((x >= low) & (x <= high), F.least(i, F.lit(bins - 1).cast("long")))


def histogram_2d(locs: DataFrame, x: tuple[float, float, int], y: tuple[float, float, int], weight: str | None = None) -> DataFrame:
    """``iy``, ``ix``, ``n`` over equal bins, (low, high, bins) for each axis."""
    binned = locs.select(bin_index(F.col("yc"), *y).alias("iy"), bin_index(F.col("xc"), *x).alias("ix"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    return binned.where("iy IS NOT NULL AND ix IS NOT NULL").groupBy("iy", "ix").agg(F.sum("w").alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """``bin``, ``n``, and ``density`` (area 1) if asked for."""
    out = df.select(bin_index(F.col(column), low, high, bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    if density:
        total = out.agg(F.sum("n").alias("t__"))
        out = out.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / (F.col("t__") * ((high - low) / bins))).drop("t__")
    return out


def spatial_grid(locs: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Edges of a grid over the table: ``axis``, ``i``, ``edge``, ``centre``."""
    b = locs.groupBy(*keys).agg(F.min("xc").alias("x0"), F.max("xc").alias("x1"), F.min("yc").alias("y0"), F.max("yc").alias("y1"))
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x0").alias("lo"), F.col("x1").alias("hi")), F.struct(F.lit("y").alias("axis"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("a.hi") - F.col("a.lo")) / size)))
    edge = F.col("lo") + F.col("i") * size
    return b.select(*keys, axes.alias("a")).select(*keys, "a.axis", "a.lo", steps.alias("i")).select(*keys, "axis", "i", edge.alias("edge"), (edge + size / 2).alias("centre"))


def cell_average(locs: DataFrame, size: float, columns: Sequence[str], least: int = 1, keys: Sequence[str] = (), sums: Sequence[str] = ("photons", "background_photons")) -> DataFrame:
    """Grid cells with enough rows: means weighted by 1/error with errors from 1/error^2, sums of photons."""
    low = locs.agg(F.min("xc").alias("x__"), F.min("yc").alias("y__"))
    cells = locs.crossJoin(F.broadcast(low)).withColumns({"cell_x": F.floor((F.col("xc") - F.col("x__")) / size), "cell_y": F.floor((F.col("yc") - F.col("y__")) / size)})
    out = [F.count("*").alias("n_locs")]
    for c in columns:
        mean, error = inverse_error_mean(F.col(c), F.col(f"{c}_err"))
        out += [mean.alias(c), error.alias(f"{c}_err")]
    out += [F.sum(c).alias(c) for c in sums if c in locs.columns]
    return cells.groupBy(*keys, "cell_x", "cell_y").agg(*out).where(F.col("n_locs") >= least)


def pixel_moments(pixels: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Offset and variance of each pixel in one pass: mean, and mean square less squared mean."""
    return pixels.groupBy(*keys).agg(F.avg("value").alias("offset"), F.var_pop("value").alias("variance"))


def camera_gain(pixels: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Gain as the slope through the origin, sum(A B) / sum(B B); NaN without signal."""
    top, bottom = F.sum(F.col("A") * F.col("B")), F.sum(F.col("B") * F.col("B"))
    return pixels.groupBy(*keys).agg(F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(float("nan"))).alias("gain"))


def calibrate_camera(dark: DataFrame, lit: DataFrame, window: int = 5) -> DataFrame:
    """Maps of a camera from dark frames and frames at several intensities.

    ``dark`` has ``y x value``; ``lit`` ``intensity y x value``.  Returns
    offset, variance, gain, read noise and relative quantum efficiency.
    """
    base = pixel_moments(dark)
    levels = lit.groupBy("intensity", "y", "x").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    pairs = levels.join(base, ["y", "x"]).select("y", "x", (F.col("var") - F.col("variance")).alias("A"), (F.col("mean") - F.col("offset")).alias("B"))
    maps = base.join(camera_gain(pairs), ["y", "x"]).withColumn("read_noise", F.sqrt("variance") / F.col("gain"))
    bright = levels.groupBy("y", "x").agg(F.max_by("mean", "intensity").alias("bright"))
    flat = maps.join(bright, ["y", "x"]).withColumn("signal", (F.col("bright") - F.col("offset")) / F.col("gain"))
    return flat.join(relative_efficiency(flat, "signal", window), ["y", "x"]).drop("bright", "signal")


def relative_efficiency(pixels: DataFrame, value: str, window: int = 5) -> DataFrame:
    """Each pixel over the mean of the window around it; edges repeat.

    Pixels are sent to the windows that hold them; an edge pixel stands for
    those beyond the edge, so it counts several times in a window.
    """
    half = window // 2
    size = pixels.agg(F.max("y").alias("h__"), F.max("x").alias("w__"))
    steps = F.sequence(F.lit(-half), F.lit(window - 1 - half))
    at = pixels.select("y", "x").crossJoin(F.broadcast(size)).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    clamp = lambda c, d, m: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.col(m))
    asked = at.select("y", "x", clamp("y", "dy", "h__").alias("sy"), clamp("x", "dx", "w__").alias("sx"))
    held = pixels.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v"))
    means = asked.join(held, ["sy", "sx"]).groupBy("y", "x").agg(F.avg("v").alias("m"))
    return pixels.join(means, ["y", "x"]).select("y", "x", (F.col(value) / F.col("m")).alias("rqe"))


def channel_model(rows: DataFrame, columns: Sequence[str], least: int, channel: str = "channel") -> DataFrame:
    """Mean and sample covariance (+ 1e-6 on the diagonal) of each channel with enough rows."""
    out = [F.count("*").alias("n")] + [F.avg(c).alias(f"mean_{c}") for c in columns]
    for i, a in enumerate(columns):
        for b in columns[i:]:
            out.append((F.covar_samp(a, b) + (1e-6 if a == b else 0.0)).alias(f"cov_{a}_{b}"))
    return rows.where(F.col(channel) >= 0).groupBy(channel).agg(*out).where(F.col("n") >= least)


def colour_fit_average(fits: DataFrame) -> DataFrame:
    """Each channel over the sum of the three, row by row, with the mean chi square of its bootstrap."""
    total = sum((F.col(c) for c in AMPLITUDES[1:]), F.col(AMPLITUDES[0]))
    w = Window.partitionBy("bootstrap")
    return fits.withColumns({c: F.col(c) / total for c in AMPLITUDES} | {"chi_sqr": F.avg("chi_sqr").over(w)})


def fit_average(fits: DataFrame) -> DataFrame:
    """One row for each bootstrap: position weighted by photons, plain means of widths, fractions of sums."""
    photons = sum((F.col(c) for c in AMPLITUDES[1:]), F.col(AMPLITUDES[0]))
    total = F.sum(photons)
    real = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return fits.groupBy("bootstrap").agg(
        *[(F.sum(F.col(c) * photons) / total).alias(c) for c in ("xc", "yc")],
        *[real(c).alias(c) for c in ("s_x", "s_y", "chi_sqr")], *[(F.sum(c) / total).alias(c) for c in AMPLITUDES],
    )


def fit_statistics(fits: DataFrame, truth: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Root mean square error of positions, mean absolute error of the others, and spreads."""
    out = []
    for c, v in truth.items():
        e = F.col(c) - v
        out += [(F.sqrt(F.avg(e * e)) if c in ("xc", "yc") else F.avg(F.abs(e))).alias(f"{c}_error"), F.stddev_pop(c).alias(f"{c}_std")]
    return fits.groupBy(*keys).agg(*out)


def region_statistics(rows: DataFrame, group: str = "group", least: int = 1) -> DataFrame:
    """Count, mean, spread and frame span of regions with enough rows."""
    return rows.where(F.col(group) >= 0).groupBy(group).agg(
        F.count("*").alias("n"), F.avg("xc").alias("x_mean"), F.avg("yc").alias("y_mean"), F.stddev_pop("xc").alias("x_std"), F.stddev_pop("yc").alias("y_std"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count_distinct("frame").alias("n_frames"),
    ).where(F.col("n") >= least)


def radial_sum(pixels: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """Sum by distance from the centre, rounded half to even."""
    r = F.sqrt((F.col("y") - height // 2) ** 2 + (F.col("x") - width // 2) ** 2)
    return pixels.groupBy(F.bround(r).cast("int").alias("r")).agg(F.sum(value).alias("sum"), F.count("*").alias("n"))


def molecule_summary(locs: DataFrame, label: str = "molecular_index") -> DataFrame:
    """Rows, mean position, frame span and first field of view of each molecule."""
    return locs.groupBy(label).agg(
        F.count("*").alias("n"), F.avg("xc").alias("xc"), F.avg("yc").alias("yc"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.min_by("fov_index", "loc_id").alias("fov_index"),
    )


def level_statistics(df: DataFrame, level: str, value: str) -> DataFrame:
    return df.groupBy(level).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.99)).alias("p99"), F.count("*").alias("n"))


def tail_fraction(df: DataFrame, level: str, value: str, limit: float) -> DataFrame:
    return df.groupBy(level).agg(F.avg((F.col(value) > limit).cast("double")).alias("fraction"))


def quantile_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """Each row's bin between equal quantiles; equal values share a bin."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("edges__"))
    return df.crossJoin(F.broadcast(edges)).withColumn("quantile_bin", F.size(F.filter("edges__", lambda e: e < F.col(value)))).drop("edges__")


def best_parameter(df: DataFrame, keys: Sequence[str], parameter: str, score: str) -> DataFrame:
    """The parameter with the least score of each group."""
    return df.groupBy(*keys).agg(F.min_by(parameter, F.struct(score, parameter)).alias(parameter), F.min(score).alias(score))
