"""Camera frames: maps, filters, mosaics, detection.

A frame is a row with ``height``, ``width`` and ``pixels`` (row-major array),
so a movie is dealt by frames.  Kernels are numpy inside Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import numeric

FRAME = "file string, frame int, height int, width int, pixels array<float>"


def frame_keys(frames: DataFrame) -> dict[str, str]:
    """The columns that tell frames apart, with their types: the file, if there is one, and the number."""
    kinds = dict(frames.dtypes)
    return {c: f"`{c}` {kinds[c]}" for c in ("file", "frame") if c in kinds}


def spot_key(*columns: str):
    """A spot's own number, the same whenever and wherever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], dtype: str = "float") -> DataFrame:
    """Each frame through a function of its image; the size may change."""
    others = [f for f in frames.schema.fields if f.name not in ("height", "width", "pixels")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "height int", "width int", f"pixels array<{dtype}>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            images = [kernel(np.asarray(x, dtype=float).reshape(h, w)) for x, h, w in zip(p["pixels"], p["height"], p["width"])]
            yield p[[f.name for f in others]].assign(height=[i.shape[0] for i in images], width=[i.shape[1] for i in images], pixels=[i.ravel() for i in images])

    return frames.mapInPandas(run, schema)


def smooth_frames(frames: DataFrame, function: Callable[..., np.ndarray], *args, **kwargs) -> DataFrame:
    """The caller's smoothing function on every frame."""
    return map_frames(frames, lambda image: function(image, *args, **kwargs))


def make_smoother(sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda image: numeric.gaussian_filter(image, sigma)


def gaussian_filter_frames(frames: DataFrame, sigma: float) -> DataFrame:
    return map_frames(frames, lambda i: numeric.gaussian_filter(i, sigma))


def median_filter_frames(frames: DataFrame, size: int) -> DataFrame:
    return map_frames(frames, lambda i: numeric.window_extreme(i, size, largest=False))


def variance_weighted_filter(frames: DataFrame, variance: np.ndarray, size: int) -> DataFrame:
    """uniform(image / var) / uniform(1 / var), zeros beyond the edge."""
    below = numeric.uniform_filter(1.0 / variance, size, "constant")
    return map_frames(frames, lambda i: numeric.uniform_filter(i / variance, size, "constant") / below)


def explode_pixels(frames: DataFrame) -> DataFrame:
    """One row a pixel: ``frame``, ``y``, ``x``, ``value``."""
    keys = [c for c in frames.columns if c not in ("height", "width", "pixels")]
    return frames.select(*keys, "width", F.posexplode("pixels").alias("i__", "value")).select(*keys, F.floor(F.col("i__") / F.col("width")).cast("int").alias("y"), (F.col("i__") % F.col("width")).cast("int").alias("x"), "value")


def crop_maps(maps: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """A window of calibration maps, moved to the origin."""
    inside = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    return maps.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


# mosaics


def colour_masks(height: int, width: int, unit: Sequence[Sequence[str]], x0: int = 0, y0: int = 0) -> dict[str, np.ndarray]:
    """A mask for each colour of a repeated tile, for a window that starts at (x0, y0)."""
    tile = np.array(unit)
    y, x = np.indices((height, width))
    seen = tile[(y + y0) % tile.shape[0], (x + x0) % tile.shape[1]]
    return {str(c): seen == c for c in np.unique(tile)}


def stacked_masks(height: int, width: int, unit: Sequence[Sequence[str]], x0: int = 0, y0: int = 0) -> np.ndarray:
    return np.stack(list(colour_masks(height, width, unit, x0, y0).values()), axis=-1)


def pixel_colour(unit: Sequence[Sequence[str]], x0: int = 0, y0: int = 0):
    """Column with the colour of the pixel at (y, x)."""
    h, w = len(unit), len(unit[0])
    flat = F.array(*[F.lit(c) for row in unit for c in row])
    return F.element_at(flat, (F.pmod(F.col("y") + y0, F.lit(h)) * w + F.pmod(F.col("x") + x0, F.lit(w)) + 1).cast("int"))


def diagonal_tile(colours: Sequence[str]) -> list[list[str]]:
    n = len(colours)
    return [[colours[(x + y) % n] for x in range(n)] for y in range(n)]


def symmetric_tile(counts: dict[str, int], n: int, tries: int = 2000, seed: int = 0) -> list[list[str]]:
    """An n x n tile with given counts whose colours are spread most evenly around the torus."""
    rng = np.random.default_rng(seed)
    items = np.array([c for c, k in counts.items() for _ in range(k)])
    if len(items) != n * n:
        raise ValueError("the counts don't fill the tile")
    y, x = np.indices((n, n))
    best, found = math.inf, None
    for _ in range(tries):
        tile = rng.permutation(items).reshape(n, n)
        cost = 0.0
        for c in counts:
            at = np.argwhere(tile == c)
            d = np.abs(at[:, None] - at[None])
            d = np.minimum(d, n - d)
            r = np.hypot(d[..., 0], d[..., 1])
            cost += (1 / r[r > 0]).sum()
        if cost < best:
            best, found = cost, tile
    return found.tolist()


_SIDE = np.array([[0.25, 0.5, 0.25], [0.5, 1.0, 0.5], [0.25, 0.5, 0.25]])


def demosaic(image: np.ndarray, masks: dict[str, np.ndarray], strategy: str = "bilinear", weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Full planes of each colour by weighted interpolation from its pixels.

    ``gradient`` corrects the other colours' planes by the Laplacian of the
    measured pixel, in the manner of linear gradient-corrected interpolation.
    """
    w = np.ones_like(image) if weight is None else weight
    out = {}
    for c, m in masks.items():
        top, bottom = (numeric.correlate(np.where(m, v, 0.0), _SIDE) for v in (image * w, w))
        reach = 1
        while (bottom <= 0).any():
            reach += 1
            k = np.add.outer(-np.abs(np.arange(-reach, reach + 1)), -np.abs(np.arange(-reach, reach + 1))) + 2 * reach + 1.0
            more = [numeric.correlate(np.where(m, v, 0.0), k) for v in (image * w, w)]
            top, bottom = np.where(bottom > 0, top, more[0]), np.where(bottom > 0, bottom, more[1])
            if reach > max(image.shape):
                break
        out[c] = np.where(m, image, top / np.where(bottom > 0, bottom, 1.0))
    if strategy == "gradient":
        laplace = np.zeros_like(image)
        for c, m in masks.items():
            smooth = numeric.correlate(out[c], np.array([[0, 0, 1, 0, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 1], [0, 0, 0, 0, 0], [0, 0, 1, 0, 0]]) / 4)
            laplace = np.where(m, (image - smooth) / 2, laplace)
        out = {c: np.where(masks[c], image, p + laplace / 2) for c, p in out.items()}
    return out


STRATEGIES = ("none", "bilinear", "gradient")


def demosaic_frames(frames: DataFrame, unit: Sequence[Sequence[str]], strategy: str = "bilinear", grey: bool = True) -> DataFrame:
    """Demosaiced frames: the mean plane, or planes one below another in the order of the colours' names."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    if strategy == "none":
        return frames

    def run(image: np.ndarray) -> np.ndarray:
        planes = list(demosaic(image, colour_masks(*image.shape, unit), strategy).values())
        return np.mean(planes, axis=0) if grey else np.concatenate(planes)

    return map_frames(frames, run)


def variance_aware_demosaic(frames: DataFrame, unit: Sequence[Sequence[str]], variance: np.ndarray, offset: np.ndarray, gain: np.ndarray, strategy: str = "bilinear") -> DataFrame:
    """(frame - offset) / gain, then interpolation weighted by 1 / variance over its mean, to one plane."""
    weight = 1.0 / np.maximum(variance, 1e-12)
    weight = weight / weight.mean()

    def run(image: np.ndarray) -> np.ndarray:
        planes = demosaic((image - offset) / gain, colour_masks(*image.shape, unit), strategy, weight)
        return np.mean(list(planes.values()), axis=0)

    return map_frames(frames, run)


def bin_frames(frames: DataFrame, size: int) -> DataFrame:
    """Sums over blocks of the mosaic, stretched to the old size by nearest pixels."""

    def run(image: np.ndarray) -> np.ndarray:
        h, w = (s // size * size for s in image.shape)
        small = image[:h, :w].reshape(h // size, size, w // size, size).sum(axis=(1, 3))
        y, x = (np.minimum(np.arange(s) * small.shape[a] // s, small.shape[a] - 1) for a, s in enumerate(image.shape))
        return small[np.ix_(y, x)]

    return map_frames(frames, run)


# detection


def annulus(guard: int, reference: int) -> np.ndarray:
    """1 on the square ring between ``guard`` and ``reference`` pixels from the centre."""
    y, x = np.indices((2 * reference + 1,) * 2) - reference
    return (np.maximum(np.abs(y), np.abs(x)) > guard).astype(float)


def matched_filter(sigma: float, reach: float = 3.0) -> np.ndarray:
    """Kernel of a Gaussian spot: zero mean, unit energy."""
    r = max(1, math.ceil(reach * sigma))
    y, x = np.indices((2 * r + 1,) * 2) - r
    k = np.exp(-(y * y + x * x) / (2 * sigma * sigma))
    k -= k.mean()
    return k / math.sqrt((k * k).sum())


def cfar(image: np.ndarray, kernel: np.ndarray, pfa: float) -> np.ndarray:
    """Pixels above mean + z * spread of the ring around them; edges mirror."""
    k = kernel / kernel.sum()
    mean = numeric.correlate(image, k)
    spread = np.sqrt(np.maximum(numeric.correlate(image * image, k) - mean * mean, 0))
    return image > mean + numeric.normal_upper_quantile(pfa) * spread


def local_maxima(image: np.ndarray, mask: np.ndarray, reach: int) -> np.ndarray:
    """(y, x) of masked pixels that are the largest of their window; equal ones give way to the first in reading order."""
    top = numeric.window_extreme(image, 2 * reach + 1)
    kept = np.zeros(image.shape, dtype=bool)
    for y, x in np.argwhere(mask & (image >= top)):
        near = slice(max(0, y - reach), y + reach + 1), slice(max(0, x - reach), x + reach + 1)
        kept[y, x] = not (kept[near] & (image[near] == image[y, x])).any()
    return np.argwhere(kept)


def ring_quality(image: np.ndarray, y: int, x: int, guard: int, reference: int, sigma: float = 1.0) -> dict[str, float]:
    """Statistics of the spot and the ring around it; places beyond the edge repeat it."""
    d = np.arange(-reference, reference + 1)
    yy = np.clip(y + d, 0, image.shape[0] - 1)[:, None] + 0 * d[None]
    xx = np.clip(x + d, 0, image.shape[1] - 1)[None] + 0 * d[:, None]
    far = np.maximum(np.abs(d)[:, None], np.abs(d)[None])
    inner, outer = image[yy[far <= guard], xx[far <= guard]], image[yy[far > guard], xx[far > guard]]
    limit = float(np.median(outer) + sigma * outer.std())
    return {"spot_mean": float(inner.mean()), "spot_max": float(inner.max()), "spot_background": float(np.median(outer)), "spot_noise": float(outer.std()), "spot_share": float((inner > limit).mean())}


def detect(image: np.ndarray, variance: np.ndarray | float, sigma: float, pfa: float = 1e-4, guard: int = 3, reference: int = 6, reach: int = 2, share: float = 0.3, ring_sigma: float = 1.0) -> list[dict]:
    """Spots of one frame: whiten by the read noise, filter for the shape, threshold, keep local maxima
    whose centre stands out of the ring around it."""
    white = image / np.sqrt(variance)
    seen = numeric.correlate(white, matched_filter(sigma))
    out = []
    for y, x in local_maxima(seen, cfar(seen, annulus(guard, reference), pfa), reach):
        q = ring_quality(image, y, x, max(1, guard - 1), reference, ring_sigma)
        if q["spot_share"] >= share:
            out.append({"y": int(y), "x": int(x), **q})
    return out


SPOTS = "y int, x int, spot_mean double, spot_max double, spot_background double, spot_noise double, spot_share double"


def detect_frames(frames: DataFrame, variance: np.ndarray | float, sigma: float, start: int = 0, **options) -> DataFrame:
    """Spots of all frames, one row each; ``start`` is added to frame numbers."""
    sent = frames.sparkSession.sparkContext.broadcast(variance)
    keys = [f for f in frames.schema.fields if f.name not in ("height", "width", "pixels")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in keys] + [c.split()[0] for c in SPOTS.split(", ")]
        for p in parts:
            rows = [{**{k.name: r[k.name] for k in keys}, "frame": r["frame"] + start, **s} for r in p.to_dict("records") for s in detect(np.asarray(r["pixels"], dtype=float).reshape(r["height"], r["width"]), sent.value, sigma, **options)]
            yield pd.DataFrame(rows, columns=names)

    return frames.mapInPandas(run, f"{schema}, {SPOTS}")


def net_gradients(image: np.ndarray, box: int) -> np.ndarray:
    """Sum over a box of the gradient towards its centre."""
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    gy[1:-1] = image[2:] - image[:-2]
    gx[:, 1:-1] = image[:, 2:] - image[:, :-2]
    r = box // 2
    y, x = np.indices((box, box)) - r
    length = np.hypot(y, x)
    length[r, r] = 1
    uy, ux = -y / length, -x / length
    return numeric.correlate(gy, uy, "constant") + numeric.correlate(gx, ux, "constant")


def identify(image: np.ndarray, least: float, box: int) -> list[tuple[int, int, float]]:
    """Box maxima with a net gradient above ``least``, away from the border: (y, x, gradient)."""
    r = box // 2
    maxima = local_maxima(image, np.ones(image.shape, dtype=bool), r)
    ng = net_gradients(image, box)
    return [(int(y), int(x), float(ng[y, x])) for y, x in maxima if r <= y < image.shape[0] - r and r <= x < image.shape[1] - r and ng[y, x] > least]


def identify_frames(frames: DataFrame, least: float, box: int, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Identifications of all frames of all files, inside (y0, x0, y1, x1) if given."""
    keys = frame_keys(frames)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for f, h, w, px in zip(p[list(keys)].itertuples(index=False), p["height"], p["width"], p["pixels"]):
                image = np.asarray(px, dtype=float).reshape(h, w)
                y0, x0 = (roi[0], roi[1]) if roi else (0, 0)
                image = image[roi[0] : roi[2], roi[1] : roi[3]] if roi else image
                rows += [(*f, y + y0, x + x0, g) for y, x, g in identify(image, least, box)]
            yield pd.DataFrame(rows, columns=[*keys, "y", "x", "net_gradient"])

    return frames.mapInPandas(run, f"{', '.join(keys.values())}, y int, x int, net_gradient double")


def cut_spots(frames: DataFrame, spots: DataFrame, box: int, least: int = 4) -> DataFrame:
    """Square windows around spots: ``file`` (if frames have one), ``frame``, ``spot_id``, ``y0``, ``x0``, ``size``, ``pixels``.

    Spots that name a file belong to its frames only, others to the frame of
    that number in every file.  A frame meets its spots as one array, so
    frames aren't repeated; windows that the edge clips to no square are dropped.
    """
    keys = frame_keys(frames)
    on = [k for k in keys if k in spots.columns]
    extra = [f for f in spots.schema.fields if f.name.startswith("spot_") and f.name != "spot_id"]
    held = spots.groupBy(*on).agg(F.collect_list(F.struct("spot_id", "y", "x", *[f.name for f in extra])).alias("spots__"))
    schema = ", ".join([*keys.values(), "spot_id long, y0 int, x0 int, size int, pixels array<double>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for f, h, w, px, own in zip(p[list(keys)].itertuples(index=False), p["height"], p["width"], p["pixels"], p["spots__"]):
                image = np.asarray(px, dtype=float).reshape(h, w)
                for s in own:
                    y0, x0 = max(s["y"] - box // 2, 0), max(s["x"] - box // 2, 0)
                    y1, x1 = min(s["y"] - box // 2 + box, h), min(s["x"] - box // 2 + box, w)
                    if y1 - y0 == x1 - x0 and y1 - y0 >= least:
                        rows.append((*f, s["spot_id"], y0, x0, y1 - y0, image[y0:y1, x0:x1].ravel(), *[s[e.name] for e in extra]))
            yield pd.DataFrame(rows, columns=[*keys, "spot_id", "y0", "x0", "size", "pixels", *[e.name for e in extra]])

    return frames.join(held, on).mapInPandas(run, schema)


def to_photons(value, baseline: float, sensitivity: float, gain: float):
    return (value - baseline) * (sensitivity / gain)


def pixels_above(frames: DataFrame, limit: float) -> DataFrame:
    """Coordinates of a mask's pixels."""
    return explode_pixels(frames).where(F.col("value") > limit)


def mask_of(points: DataFrame, height: int, width: int) -> DataFrame:
    """Mask frames from points (``frame``, ``y``, ``x``, and ``file`` if they have one)."""
    keys = [k for k in ("file", "frame") if k in points.columns]
    places = points.groupBy(*keys).agg(F.collect_set((F.col("y") * width + F.col("x")).cast("int")).alias("p__"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.array_contains("p__", i).cast("float"))
    return places.select(*keys, F.lit(height).alias("height"), F.lit(width).alias("width"), filled.alias("pixels"))
