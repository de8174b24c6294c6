"""Least-squares fits of spots on a colour mosaic.

Amplitudes and backgrounds enter as squares, so they can't be negative; their
errors are returned for the squares themselves.  x is the column, y the row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators import image as im

STRATEGIES = ("STANDARD", "DEMOSAIC", "STANDARD_ITER", "STANDARD_DATA", "ELLIPTICAL", "NOCOLOUR", "JUSTCOLOUR", "RAWCOLOUR", "POSTHENCOLOUR")
COLOURS = ("B", "G", "R")


def spot(size: int, y0: float, x0: float, sy: float, sx: float, theta: float = 0.0) -> np.ndarray:
    """Gaussian of peak 1 on a grid, turned by ``theta``."""
    y, x = np.indices((size, size))
    dy, dx = y - y0, x - x0
    if theta:
        dy, dx = dy * math.cos(theta) - dx * math.sin(theta), dy * math.sin(theta) + dx * math.cos(theta)
    return np.exp(-0.5 * ((dy / sy) ** 2 + (dx / sx) ** 2))


def start_values(smooth: np.ndarray, raw: np.ndarray, masks: Sequence[np.ndarray]) -> tuple[list[float], list[float], list[float], float]:
    """Shape (y, x, sy, sx), roots of amplitudes and backgrounds of each colour, and the principal angle."""
    w = np.abs(smooth - np.median(smooth))
    total = max(w.sum(), 1e-12)
    y, x = np.indices(smooth.shape)
    cy, cx = (y * w).sum() / total, (x * w).sum() / total
    vy, vx, vxy = (((y - cy) ** 2 * w).sum() / total, ((x - cx) ** 2 * w).sum() / total, ((y - cy) * (x - cx) * w).sum() / total)
    shape = [cy, cx, max(0.5, math.sqrt(vy) / 2), max(0.5, math.sqrt(vx) / 2)]
    # a background of 0 has no slope to leave it by
    base = [max(float(raw[m].min()), 1.0) if m.any() else 1.0 for m in masks]
    peak = [max(float(raw[m].max()) - b, 1.0) if m.any() else 1.0 for m, b in zip(masks, base)]
    return shape, [math.sqrt(p) for p in peak], [math.sqrt(b) for b in base], 0.5 * math.atan2(2 * vxy, vy - vx)


def scene(shape: np.ndarray, amplitudes: np.ndarray, backgrounds: np.ndarray, masks: Sequence[np.ndarray], theta: float = 0.0) -> np.ndarray:
    g = spot(masks[0].shape[0], shape[0], shape[1], shape[2], shape[3], theta)
    out = np.zeros(g.shape)
    for m, a, b in zip(masks, amplitudes, backgrounds):
        out = np.where(m, a * a * g + b * b, out)
    return out


def fit_spot(raw: np.ndarray, smooth: np.ndarray, weight: np.ndarray, masks: dict[str, np.ndarray], read_noise: np.ndarray | float = 0.0, strategy: str = "STANDARD_DATA", fixed: Sequence[float] | None = None) -> dict[str, float] | None:
    """Parameters of one spot in its window, or None if the fit fails.

    It fails without convergence, with a position or width outside the
    window, or if no colour's amplitude is twice its error.
    """
    size = raw.shape[0]
    names = [c for c in COLOURS if c in masks] or list(masks)
    own = [masks[c] for c in names]
    if strategy == "NOCOLOUR":
        names, own = ["I"], [np.ones(raw.shape, dtype=bool)]
    k = len(own)
    seed = smooth
    if strategy in ("DEMOSAIC", "POSTHENCOLOUR"):
        seed = np.mean(list(im.demosaic(raw, masks).values()), axis=0)
    shape, amps, backs, angle = start_values(seed, raw, own)
    colour_only = strategy in ("JUSTCOLOUR", "RAWCOLOUR")
    if strategy == "POSTHENCOLOUR":
        grey = fit_spot(seed, seed, weight, masks, read_noise, "NOCOLOUR")
        if grey is None:
            return None
        shape, colour_only = [grey["y"], grey["x"], grey["s_y"], grey["s_x"]], True
    elif colour_only and fixed is not None:
        shape = list(fixed)
    turned = strategy == "ELLIPTICAL"
    head = [] if colour_only else [*shape, *([angle] if turned else [])]

    def unpack(p: np.ndarray):
        s = np.array(shape) if colour_only else p[:4]
        t = p[4] if turned else 0.0
        n = len(head)
        return s, p[n : n + k], p[n + k : n + 2 * k], t

    def model(p: np.ndarray) -> np.ndarray:
        s, a, b, t = unpack(p)
        s = np.concatenate([s[:2], np.clip(np.abs(s[2:]), 0.05, 10 * size)])
        return scene(s, a, b, own, t)

    data = raw
    p = np.array([*head, *amps, *backs])
    passes = [weight]
    if strategy == "STANDARD_ITER":
        passes = [weight, None, None]
    elif strategy == "STANDARD_DATA":
        passes = [weight, None, 1.0 / (np.maximum(raw, 0) + 1 + np.asarray(read_noise) ** 2)]
    for w in passes:
        if w is None:
            w = 1.0 / (np.maximum(model(p), 0) + 1 + np.asarray(read_noise) ** 2)
        root = np.sqrt(w)
        p, cov = numeric.least_squares(lambda q: ((model(q) - data) * root).ravel(), p, 1e-6, 60)
    if cov is None or not np.isfinite(p).all():
        return None
    s, a, b, t = unpack(p)
    s = np.concatenate([s[:2], np.abs(s[2:])])
    if (s < 0).any() or (s > size).any():
        return None
    residual = ((model(p) - data) * root).ravel()
    dof = len(residual) - len(p)
    chi = float(residual @ residual) / dof if dof > 0 else math.inf
    variance = np.diag(cov) * chi
    error = np.where((variance > 0) & np.isfinite(variance), np.sqrt(np.maximum(variance, 0)), np.nan)
    n = len(head)
    amp_err, back_err = 2 * np.abs(a) * error[n : n + k], 2 * np.abs(b) * error[n + k :]
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = np.abs(a) / error[n : n + k]
    if not (snr >= 2).any():
        return None
    out = {"y": s[0], "x": s[1], "s_y": s[2], "s_x": s[3], "chi_sqr": chi, "theta": t if turned else math.nan}
    out |= {f"{c}_err": float(e) for c, e in zip(("y", "x", "s_y", "s_x"), error[:4] if not colour_only else [math.nan] * 4)}
    out["theta_err"] = float(error[4]) if turned else math.nan
    for c, v, e, bv, be in zip(names, a, amp_err, b, back_err):
        tail = "" if c == "I" else f"_{c}"
        out |= {f"A{tail}": float(v * v), f"A{tail}_err": float(e), f"bg{tail}": float(bv * bv), f"bg{tail}_err": float(be)}
    return out


def columns(strategy: str, names: Sequence[str] = COLOURS) -> list[str]:
    tails = [""] if strategy == "NOCOLOUR" else [f"_{c}" for c in names]
    base = [f"{p}{t}{e}" for t in tails for p in ("A", "bg") for e in ("", "_err")]
    extra = ["theta", "theta_err"] if strategy == "ELLIPTICAL" else []
    return ["xc", "yc", "s_x", "s_y", "xc_err", "yc_err", "s_x_err", "s_y_err", "chi_sqr", *base, *extra]


def fit_spots(spots: DataFrame, unit: Sequence[Sequence[str]], strategy: str = "STANDARD_DATA", sigma: float = 1.0, read_noise: np.ndarray | float = 1.0, hot: float = 50.0) -> DataFrame:
    """Localisations of cut windows (``file``, ``frame``, ``y0``, ``x0``, ``size``, ``pixels``); failed fits go."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    names = [c for c in COLOURS if any(c in row for row in unit)]
    fields = columns(strategy, names)
    extra = [f for f in spots.schema.fields if f.name.startswith("spot_")]
    keys = im.frame_keys(spots)
    schema = ", ".join([*keys.values(), *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), *(f"`{c}` double" for c in fields)])
    noise = spots.sparkSession.sparkContext.broadcast(read_noise)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                n, y0, x0 = r["size"], r["y0"], r["x0"]
                raw = np.asarray(r["pixels"], dtype=float).reshape(n, n)
                rn = noise.value[y0 : y0 + n, x0 : x0 + n] if np.ndim(noise.value) == 2 else noise.value
                smooth = numeric.gaussian_filter(raw, sigma)
                weight = np.where(np.broadcast_to(rn, raw.shape) > hot, 1e-8, 1.0 / (np.maximum(smooth, 0) + 1 + np.square(rn)))
                masks = {c: m for c, m in im.colour_masks(n, n, unit, x0, y0).items() if c in names}
                fit = fit_spot(raw, smooth, weight, masks, rn, strategy)
                if fit is not None:
                    # a pixel's centre is half a pixel from its corner
                    fit |= {"xc": fit["x"] + x0 + 0.5, "yc": fit["y"] + y0 + 0.5, "xc_err": fit["x_err"], "yc_err": fit["y_err"]}
                    rows.append([*[r[k] for k in keys], *[r[f.name] for f in extra], *[fit.get(c, math.nan) for c in fields]])
            yield pd.DataFrame(rows, columns=[*keys, *[f.name for f in extra], *fields])

    return spots.mapInPandas(run, schema)


def localise(frames: DataFrame, unit: Sequence[Sequence[str]], variance: np.ndarray | float = 1.0, gain: np.ndarray | float = 1.0, offset: np.ndarray | float = 0.0, rqe: np.ndarray | float = 1.0, sigma: float = 1.3, box: int = 11, strategy: str = "STANDARD_DATA", demosaic: str = "bilinear", **detection) -> DataFrame:
    """Movies to localisations: photoelectrons, demosaic, detect, cut, fit, physical filter.

    Frames of several files stay apart: rows keep their ``file``.
    """
    from lumenframe.operators import filters

    electrons = im.map_frames(frames, lambda i: (i - offset) / gain / rqe)
    grey = im.demosaic_frames(electrons, unit, demosaic)
    noise = np.sqrt(variance) / gain
    spots = im.detect_frames(grey, np.maximum(np.square(noise), 1e-6) + 1.0, sigma, **detection)
    spots = spots.withColumn("spot_id", im.spot_key(*im.frame_keys(spots), "y", "x"))
    windows = im.cut_spots(electrons, spots, box)
    rows = fit_spots(windows, unit, strategy, sigma, noise)
    size = frames.agg(F.max("width"), F.max("height")).first()
    return filters.physical(rows, float(size[0] or 0), float(size[1] or 0))


def fit_fixed_places(frames: DataFrame, puncta: DataFrame, unit: Sequence[Sequence[str]], box: int = 11, **options) -> DataFrame:
    """Fit every frame at the same spots (``y``, ``x``), those of its file if spots name files."""
    keys = list(im.frame_keys(frames))
    places = puncta.select(*[c for c in ("file", "y", "x") if c in puncta.columns and (c != "file" or "file" in keys)])
    # every frame is to be fitted at every spot, so these are the rows of the result
    every = frames.select(*keys).distinct()
    every = every.join(places, "file") if "file" in places.columns else every.crossJoin(places)
    every = every.withColumn("spot_id", im.spot_key(*keys, "y", "x"))
    return fit_spots(im.cut_spots(frames, every, box), unit, **options)


def summed_frames(frames: DataFrame, n: int) -> DataFrame:
    """The sum of each file's first ``n`` frames as its frame 0."""
    own = frames if "file" in frames.columns else frames.withColumn("file", F.lit("sum"))
    pixels = im.explode_pixels(own.where(F.col("frame") < n)).groupBy("file", "y", "x").agg(F.sum("value").alias("v"))
    rows = pixels.groupBy("file", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("r"))
    all_rows = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("y", "r"))).alias("a"))
    line = F.flatten(F.transform("a", lambda q: F.transform(q["r"], lambda p: p["v"].cast("float"))))
    return all_rows.select("file", F.lit(0).alias("frame"), F.size("a").alias("height"), F.size(F.col("a")[0]["r"]).alias("width"), line.alias("pixels"))


def fit_fret(frames: DataFrame, unit: Sequence[Sequence[str]], n_sum: int = 10, box: int = 11, sigma: float = 1.3, penalty: float = 0.05, **options) -> DataFrame:
    """Detect on each file's summed first frames, cut traces at their last change, fit the frames before it."""
    from lumenframe.operators import sequence

    frames = frames if "file" in frames.columns else frames.withColumn("file", F.lit("sum"))
    puncta = im.detect_frames(summed_frames(frames, n_sum), 1.0, sigma).select("file", "y", "x").withColumn("punctum", im.spot_key("file", "y", "x"))
    traces = sequence.roi_traces(im.explode_pixels(frames), puncta.select("file", "punctum", F.col("y").alias("yc"), F.col("x").alias("xc")), box, ("file",)).drop("file")
    series = traces.withColumnRenamed("frame", "t").withColumnRenamed("punctum", "trace")
    points = sequence.change_points(series, method="level", penalty=penalty)
    kept = sequence.frames_before_last_change(points).join(puncta.withColumnRenamed("punctum", "trace"), "trace").withColumn("spot_id", F.col("trace"))
    return fit_spots(im.cut_spots(frames, kept, box), unit, sigma=sigma, **options)


def fit_quantum_dots(frames: DataFrame, unit: Sequence[Sequence[str]], n_sum: int = 10, box: int = 11, sigma: float = 1.3, **options) -> DataFrame:
    """Detect on the summed first frames, fit every frame there."""
    puncta = im.detect_frames(summed_frames(frames, n_sum), 1.0, sigma)
    return fit_fixed_places(frames, puncta, unit, box, sigma=sigma, **options)


def fit_tracking(frames: DataFrame, unit: Sequence[Sequence[str]], strategy: str = "ELLIPTICAL", **options) -> DataFrame:
    return localise(frames, unit, strategy=strategy, **options)


MODES = {"smlm": localise, "imaging": localise, "tracking": fit_tracking, "fret": fit_fret, "qd": fit_quantum_dots}


def fit(frames: DataFrame, unit: Sequence[Sequence[str]], mode: str = "smlm", **options) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(MODES)}")
    return MODES[mode](frames, unit, **options)
