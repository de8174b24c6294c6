"""Super-resolution images as tables of pixels, and resolution from ring correlation.

A row becomes the pixels it touches, and pixels are summed; the image exists
as rows until the caller asks for the (bounded) array.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators.aggregate import exact_percentile

View = tuple[float, float, float, float]  # y0, x0, y1, x1


def in_view(locs: DataFrame, oversampling: float, view: View) -> DataFrame:
    """Rows strictly inside the view, with ``ry`` and ``rx`` in image pixels."""
    y0, x0, y1, x1 = view
    inside = (F.col("xc") > x0) & (F.col("xc") < x1) & (F.col("yc") > y0) & (F.col("yc") < y1)
    return locs.where(inside).withColumns({"ry": (F.col("yc") - y0) * oversampling, "rx": (F.col("xc") - x0) * oversampling})


def shape(oversampling: float, view: View) -> tuple[int, int]:
    return math.ceil(oversampling * (view[2] - view[0])), math.ceil(oversampling * (view[3] - view[1]))


def histogram(locs: DataFrame, oversampling: float, view: View, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per pixel: ``py``, ``px``, ``value``."""
    at = [F.floor("ry").cast("int").alias("py"), F.floor("rx").cast("int").alias("px")]
    return in_view(locs, oversampling, view).groupBy(*keys, *at).agg(F.count("*").alias("value"))


def _splat(rows: DataFrame, height: int, width: int, keep: Sequence[Column | str]) -> DataFrame:
    """Each row at the pixels within three sigma, with its density there as ``g``."""
    lo = lambda c, s: F.greatest(F.floor(F.col(c) - 3 * F.col(s)).cast("int"), F.lit(0))
    hi = lambda c, s, n: F.least(F.floor(F.col(c) + 3 * F.col(s) + 1).cast("int"), F.lit(n)) - 1
    spread = rows.where((hi("ry", "sy", height) >= lo("ry", "sy")) & (hi("rx", "sx", width) >= lo("rx", "sx")))
    spread = spread.withColumn("py", F.explode(F.sequence(lo("ry", "sy"), hi("ry", "sy", height)))).withColumn("px", F.explode(F.sequence(lo("rx", "sx"), hi("rx", "sx", width))))
    q = (F.col("rx") - F.col("px") - 0.5) ** 2 / (2 * F.col("sx") ** 2) + (F.col("ry") - F.col("py") - 0.5) ** 2 / (2 * F.col("sy") ** 2)
    return spread.select("py", "px", (F.exp(-q) / (2 * math.pi * F.col("sx") * F.col("sy"))).alias("g"), *keep)


def _blurred(locs: DataFrame, oversampling: float, view: View, least: float, iso: bool) -> DataFrame:
    rows = in_view(locs, oversampling, view)
    sx, sy = (F.greatest(F.col(f"{c}_err"), F.lit(least)) * oversampling for c in ("xc", "yc"))
    if iso:
        sx = sy = (sx + sy) / 2
    return rows.withColumns({"sx": sx, "sy": sy})


def gaussian(locs: DataFrame, oversampling: float, view: View, least: float = 0.0, iso: bool = False) -> DataFrame:
    """Photon-weighted Gaussians of the position errors, cut at three sigma and not scaled up for it."""
    weight = F.col("photons") if "photons" in locs.columns else F.lit(1.0)
    rows = _splat(_blurred(locs, oversampling, view, least, iso), *shape(oversampling, view), [weight.alias("w")])
    return rows.groupBy("py", "px").agg(F.sum(F.col("w") * F.col("g")).alias("value"))


def gaussian_iso(locs: DataFrame, oversampling: float, view: View, least: float = 0.0) -> DataFrame:
    return gaussian(locs, oversampling, view, least, iso=True)


def gaussian_colour(locs: DataFrame, oversampling: float, view: View, column: str, least: float = 0.0, limits: tuple[float, float] | None = None, percentiles: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Hue from the photon-weighted mean of a column, brightness from the density between percentiles."""
    weight = F.col("photons") if "photons" in locs.columns else F.lit(1.0)
    rows = _splat(_blurred(locs, oversampling, view, least, False), *shape(oversampling, view), [weight.alias("w"), F.col(column).alias("c")])
    image = rows.groupBy("py", "px").agg(F.sum(F.col("w") * F.col("g")).alias("value"), F.sum(F.col("w") * F.col("g") * F.col("c")).alias("s__"))
    image = image.withColumn("colour", F.try_divide(F.col("s__"), F.col("value"))).drop("s__")
    if limits:
        image = image.withColumn("hue", F.least(F.greatest((F.col("colour") - limits[0]) / (limits[1] - limits[0]), F.lit(0.0)), F.lit(1.0)))
    return _brightness(image, percentiles)


def gaussian_rgb(locs: DataFrame, oversampling: float, view: View, least: float = 0.0, percentiles: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Mean A_R, A_G, A_B of each pixel as hue, density as brightness."""
    weight = F.col("photons") if "photons" in locs.columns else F.lit(1.0)
    names = ("A_R", "A_G", "A_B")
    rows = _splat(_blurred(locs, oversampling, view, least, False), *shape(oversampling, view), [weight.alias("w"), *names])
    wg = F.col("w") * F.col("g")
    image = rows.groupBy("py", "px").agg(F.sum(wg).alias("value"), *[F.sum(wg * F.col(c)).alias(c) for c in names])
    return _brightness(image.withColumns({c: F.try_divide(F.col(c), F.col("value")) for c in names}), percentiles)


def _brightness(image: DataFrame, percentiles: tuple[float, float]) -> DataFrame:
    ends = image.agg(F.percentile("value", F.lit(percentiles[0])).alias("a__"), F.percentile("value", F.lit(percentiles[1])).alias("b__"))
    v = F.coalesce(F.try_divide(F.col("value") - F.col("a__"), F.col("b__") - F.col("a__")), F.lit(1.0))
    return image.crossJoin(F.broadcast(ends)).withColumn("brightness", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).drop("a__", "b__")


def convolve(pixels: DataFrame, sigma_x: float, sigma_y: float, height: int, width: int) -> DataFrame:
    """Blur of a table of pixels: each is dealt to the kernel around it."""
    kx, ky = (numeric.gaussian_kernel(s) for s in (sigma_x, sigma_y))
    out = pixels
    for k, c, n in ((kx, "px", width), (ky, "py", height)):
        half = len(k) // 2
        steps = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(float(v)).alias("k")) for i, v in enumerate(k)])
        other = "py" if c == "px" else "px"
        moved = out.select(other, F.col(c), F.col("value"), F.explode(steps).alias("s")).select(other, (F.col(c) + F.col("s.d")).alias(c), (F.col("value") * F.col("s.k")).alias("value"))
        out = moved.where((F.col(c) >= 0) & (F.col(c) < n)).groupBy("py", "px").agg(F.sum("value").alias("value"))
    return out


def render_smooth(locs: DataFrame, oversampling: float, view: View) -> DataFrame:
    """Histogram blurred by one pixel."""
    return convolve(histogram(locs, oversampling, view), 1.0, 1.0, *shape(oversampling, view))


def render_convolve(locs: DataFrame, oversampling: float, view: View, least: float = 0.0) -> DataFrame:
    """Histogram blurred by the median position error."""
    rows = in_view(locs, oversampling, view)
    sx, sy = (exact_percentile(rows, c) for c in ("xc_err", "yc_err"))
    sx, sy = (max(v or 0.0, least) * oversampling for v in (sx, sy))
    return convolve(histogram(locs, oversampling, view), sx, sy, *shape(oversampling, view))


METHODS: dict[str, Callable[..., DataFrame]] = {
    "none": histogram, "gaussian": gaussian, "gaussian_iso": gaussian_iso, "gaussian_colour": gaussian_colour, "gaussian_RGB": gaussian_rgb,
    "smooth": render_smooth, "convolve": render_convolve,
}


def render(locs: DataFrame, oversampling: float, view: View, blur: str | None = None, **options) -> DataFrame:
    """Image of a table by the named blur."""
    method = blur or "none"
    if method not in METHODS:
        raise ValueError(f"unknown blur {blur}; known: {', '.join(METHODS)}")
    return METHODS[method](locs, oversampling, view, **options)


def image_of(pixels: DataFrame, height: int, width: int, value: str = "value") -> np.ndarray:
    """The table as an array, for a caller that needs one image of a known size."""
    out = np.zeros((height, width))
    for r in pixels.select("py", "px", value).collect():
        if 0 <= r.py < height and 0 <= r.px < width:
            out[r.py, r.px] = r[value]
    return out


# ring correlation


def tukey(size: int, share: float = 0.25) -> np.ndarray:
    x = np.abs(np.linspace(-1, 1, size)) if size > 1 else np.zeros(1)
    edge = 1 - share
    return np.where(x < edge, 1.0, 0.5 * (1 + np.cos(np.pi * (x - edge) / share)))


def ring_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two images by rings of spatial frequency, after a taper and padding to a square."""
    if a.shape != b.shape:
        raise ValueError("the images differ in size")
    window = np.outer(tukey(a.shape[0]), tukey(a.shape[1]))
    n = max(a.shape)
    pad = [((n - s) // 2, n - s - (n - s) // 2) for s in a.shape]
    fa, fb = (np.fft.fftshift(np.fft.fft2(np.pad(i * window, pad))) for i in (a, b))
    y, x = np.indices((n, n))
    ring = np.rint(np.hypot(y - n // 2, x - n // 2)).astype(int)
    cross = np.bincount(ring.ravel(), (fa * fb.conj()).real.ravel())
    pa, pb = (np.bincount(ring.ravel(), (np.abs(f) ** 2).ravel()) for f in (fa, fb))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(cross / np.sqrt(pa * pb))[: n // 2 + 1]


def smooth_curve(y: np.ndarray, window: int) -> np.ndarray:
    k = max(1, window)
    return np.convolve(np.pad(y, (k // 2, k - 1 - k // 2), mode="edge"), np.full(k, 1 / k), mode="valid")


def crossings(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where two curves cross, by straight lines between samples."""
    d = a - b
    i = np.flatnonzero(d[:-1] * d[1:] < 0)
    return np.sort(np.concatenate([x[i] + (x[i + 1] - x[i]) * d[i] / (d[i] - d[i + 1]), x[d == 0]]))


def resolution(curve: np.ndarray, size: int) -> tuple[float, float, float]:
    """Resolution (pixels) at the first falling crossing of 1/7, and those half a sigma to either side; NaN without one."""
    q = np.arange(len(curve)) / size
    smooth = smooth_curve(curve, max(1, size // 20 | 1))
    rings = np.maximum(1.0, 2 * np.pi * np.arange(len(curve)))
    sigma = np.sqrt((1 - smooth**2) ** 2 / (2 * rings))

    def first(level: np.ndarray) -> float:
        for c in crossings(q, level, np.full(len(q), 1 / 7)):
            i = min(max(1, int(np.searchsorted(q, c))), len(q) - 1)
            if c > 0 and level[i] < level[i - 1]:
                return 1.0 / c
        return math.nan

    return first(smooth), first(smooth - sigma), first(smooth + sigma)


def block_split(locs: DataFrame, n_blocks: int, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Frames in blocks ceil(f / max * n), held in 1..n, and a random half of the blocks: ``block``, ``half``."""
    top = locs.groupBy(*keys).agg(F.max("frame").alias("top__"))
    rows = locs.join(top, list(keys)) if keys else locs.crossJoin(F.broadcast(top))
    block = F.least(F.greatest(F.ceil(F.col("frame") / F.greatest(F.col("top__"), F.lit(1)) * n_blocks), F.lit(1)), F.lit(n_blocks))
    rows = rows.withColumn("block", block.cast("int")).drop("top__")
    # ranks of hashes of blocks: exactly half of them
    spark = locs.sparkSession
    ranked = spark.range(1, n_blocks + 1).select(F.col("id").cast("int").alias("block"), F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)))).alias("r"))
    halves = ranked.select("block", (F.col("r") > n_blocks // 2).cast("int").alias("half"))
    return rows.join(F.broadcast(halves), "block")


def binned(locs: DataFrame, ny: int, nx: int, zoom: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts on the zoomed grid; the borders of the grid belong to it."""
    y, x = (F.col("yc") + 0.5) * zoom, (F.col("xc") + 0.5) * zoom
    inside = (y >= 0) & (y <= ny) & (x >= 0) & (x <= nx)
    py, px = (F.least(F.floor(c), F.lit(n - 1)).cast("int") for c, n in ((y, ny), (x, nx)))
    return locs.where(inside).groupBy(*keys, py.alias("py"), px.alias("px")).agg(F.count("*").alias("value"))


def fire(locs: DataFrame, size: int, zoom: float, n_blocks: int = 20, reps: int = 10, pixel_nm: float = 1.0) -> tuple[float, float]:
    """Mean and spread of the resolution over random splits, in nm; repeats run side by side."""
    from functools import reduce

    parts = [block_split(locs, n_blocks, seed).withColumn("rep", F.lit(seed)) for seed in range(reps)]
    counts = binned(reduce(DataFrame.union, parts), size, size, zoom, ("rep", "half"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        images = np.zeros((2, size, size))
        images[part["half"], part["py"], part["px"]] = part["value"]
        return pd.DataFrame({"rep": [part["rep"].iloc[0]], "resolution": [resolution(ring_correlation(*images), size)[0]]})

    out = counts.groupBy("rep").applyInPandas(run, "rep int, resolution double").where(~F.isnan("resolution")).agg(F.avg("resolution"), F.stddev_pop("resolution")).first()
    scale = pixel_nm / zoom
    return (math.nan, math.nan) if out[0] is None else (out[0] * scale, out[1] * scale)


def fire_fields(locs: DataFrame, size: int, zoom: float, n_blocks: int = 20, reps: int = 10, pixel_nm: float = 1.0, key: str = "fov_index") -> DataFrame:
    """``fire`` for every field of view: the key, ``resolution_nm``, ``spread_nm``; NaN where no split gives one."""
    from functools import reduce

    rows = locs.select(key, "frame", "xc", "yc")
    parts = [block_split(rows, n_blocks, seed, (key,)).withColumn("rep", F.lit(seed)) for seed in range(reps)]
    counts = binned(reduce(DataFrame.union, parts), size, size, zoom, (key, "rep", "half"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        images = np.zeros((2, size, size))
        images[part["half"], part["py"], part["px"]] = part["value"]
        return pd.DataFrame({key: [part[key].iloc[0]], "resolution": [resolution(ring_correlation(*images), size)[0]]})

    each = counts.groupBy(key, "rep").applyInPandas(run, f"{key} {dict(locs.dtypes)[key]}, resolution double")
    found = F.when(~F.isnan("resolution"), F.col("resolution") * (pixel_nm / zoom))
    nan = F.lit(math.nan)
    held = each.groupBy(key).agg(F.avg(found).alias("resolution_nm"), F.stddev_pop(found).alias("spread_nm"))
    # a field without a row inside the grid has no counts
    return rows.select(key).distinct().join(held, key, "left").select(key, F.coalesce("resolution_nm", nan).alias("resolution_nm"), F.coalesce("spread_nm", nan).alias("spread_nm"))


# reductions behind plots


def _uniform(df: DataFrame, seed: int) -> Column:
    """A number in [0, 1) from a row's values, the same however rows are dealt; equal rows share it."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)), 11) / F.lit(float(1 << 53))


def preview(locs: DataFrame, n: int, method: str = "random", seed: int = 0, x: str = "xc", y: str = "yc") -> DataFrame:
    """About ``n`` rows: at random, every k-th, or with probability 1 / (density + 1) on a 50 x 50 histogram."""
    if method == "every":
        total = locs.count()
        step = max(1, total // max(1, n))
        return locs.where(F.pmod(F.col("loc_id"), F.lit(step)) == 0).limit(n)
    key = _uniform(locs, seed)
    if method == "density":
        from lumenframe.operators.aggregate import bin_index

        x0, x1, y0, y1 = locs.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        if x0 is None:
            return locs
        cells = locs.withColumns({"bx__": bin_index(F.col(x), x0, max(x1, x0 + 1e-9), 50), "by__": bin_index(F.col(y), y0, max(y1, y0 + 1e-9), 50)})
        density = cells.groupBy("bx__", "by__").agg(F.count("*").alias("n__"))
        rows = cells.join(density, ["bx__", "by__"])
        return rows.orderBy(-F.ln(1 - _uniform(locs, seed)) * (F.col("n__") + 1)).limit(n).drop("bx__", "by__", "n__")
    return locs.orderBy(key).limit(n)


def rasterise(rows: DataFrame, x: str, y: str, box: View, canvas: tuple[int, int]) -> DataFrame:
    """Points per canvas pixel."""
    y0, x0, y1, x1 = box
    h, w = canvas
    at = [F.floor((F.col(y) - y0) / (y1 - y0) * h).cast("int").alias("py"), F.floor((F.col(x) - x0) / (x1 - x0) * w).cast("int").alias("px")]
    return rows.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).select(*at).groupBy(F.least("py", F.lit(h - 1)).alias("py"), F.least("px", F.lit(w - 1)).alias("px")).agg(F.count("*").alias("value"))


def ternary(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Plane coordinates of three shares."""
    total = r + g + b
    return (2 * g + b) / (2 * total), b * (math.sqrt(3) / 2) / total


def ternary_hexbin(rows: DataFrame, size: int, r: str = "A_R", g: str = "A_G", b: str = "A_B", least: int = 1) -> DataFrame:
    """Counts on hexagons: of two offset grids the nearer centre."""
    x, y = ternary(F.col(r), F.col(g), F.col(b))
    sx, sy = 1.0 / size, math.sqrt(3) / size
    at = rows.select((x / sx).alias("u"), (y / sy).alias("v"))
    i1, j1 = F.bround("u"), F.bround("v")
    i2, j2 = F.floor("u") + 0.5, F.floor("v") + 0.5
    d1 = (F.col("u") - i1) ** 2 + 3 * (F.col("v") - j1) ** 2
    d2 = (F.col("u") - i2) ** 2 + 3 * (F.col("v") - j2) ** 2
    centre = [F.when(d1 < d2, i1 * sx).otherwise(i2 * sx).alias("x"), F.when(d1 < d2, j1 * sy).otherwise(j2 * sy).alias("y")]
    return at.select(*centre).groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ternary_kde(rows: DataFrame, grid: int, bandwidth: float, r: str = "A_R", g: str = "A_G", b: str = "A_B") -> DataFrame:
    """Gaussian kernel density on the grid points of the triangle.

    Rows are binned to a fine grid first, so the kernel meets cells rather
    than rows, and only cells within four bandwidths.
    """
    x, y = ternary(F.col(r), F.col(g), F.col(b))
    fine = bandwidth / 8
    cells = rows.select(F.bround(x / fine).alias("i"), F.bround(y / fine).alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    reach = math.ceil(4 * bandwidth * grid)
    span = F.sequence(F.lit(-reach), F.lit(reach))
    near = cells.select((F.col("i") * fine).alias("x"), (F.col("j") * fine).alias("y"), "n").withColumn("gx", F.bround(F.col("x") * grid).cast("int") + F.explode(span))
    near = near.withColumn("gy", F.bround(F.col("y") * grid).cast("int") + F.explode(span)).where((F.col("gx").between(0, grid)) & (F.col("gy").between(0, grid)))
    q = (F.col("x") - F.col("gx") / grid) ** 2 + (F.col("y") - F.col("gy") / grid) ** 2
    return near.groupBy("gx", "gy").agg(F.sum(F.col("n") * F.exp(-q / (2 * bandwidth**2))).alias("density"))


def contour_levels(density: DataFrame, shares: Sequence[float]) -> list[float]:
    """Density levels at given percentiles."""
    return list(density.agg(F.percentile("density", F.array(*[F.lit(float(s)) for s in shares]))).first()[0] or [])
