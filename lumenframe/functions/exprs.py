"""Column expressions of localisation tables.  All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.schema import AMPLITUDES, BACKGROUNDS

Number = Column | float


def positive(c: Column) -> Column:
    """c > 0 as numpy has it: NaN is not."""
    return (c > 0) & ~F.isnan(c)


def normalise_channels(df: DataFrame, total: str, channels: list[str] | tuple[str, ...], errors: bool = True) -> DataFrame:
    """Divide channels and their errors by a total where it is positive; elsewhere leave them."""
    names = [c for x in channels for c in ([x, f"{x}_err"] if errors else [x]) if c in df.columns]
    return df.withColumns({c: F.when(positive(F.col(total)), F.col(c) / F.col(total)).otherwise(F.col(c)) for c in names})


def photon_columns(df: DataFrame, normalise: bool = False) -> DataFrame:
    """Add ``photons`` and ``background_photons``; optionally make channels fractions of them."""
    out = df.withColumns({
        "photons": sum((F.col(c) for c in AMPLITUDES[1:]), F.col(AMPLITUDES[0])),
        "background_photons": sum((F.col(c) for c in BACKGROUNDS[1:]), F.col(BACKGROUNDS[0])),
    })
    if normalise:
        out = normalise_channels(normalise_channels(out, "photons", AMPLITUDES), "background_photons", BACKGROUNDS)
    return out


def photoelectrons(raw: Column, gain: Column | None = None, offset: Column | None = None, rqe: Column | None = None) -> Column:
    """(raw - offset) / gain / rqe of pixel arrays; a map of another size counts as gain 1 and offset 0."""

    def fits(m: Column | None) -> Column:
        return F.lit(False) if m is None else F.size(m) == F.size(raw)

    both = fits(gain) & fits(offset) if gain is not None and offset is not None else F.lit(False)
    out = raw
    if gain is not None and offset is not None:
        shifted = F.zip_with(raw, offset, lambda a, b: a - b)
        out = F.when(both, F.zip_with(shifted, gain, lambda a, b: a / b)).otherwise(raw.cast("array<double>"))
    if rqe is not None:
        out = F.when(fits(rqe), F.zip_with(out, rqe, lambda a, b: a / b)).otherwise(out)
    return out


def pixel_weight(smoothed: Column, read_noise: Column, hot: float) -> Column:
    """1 / (max(s, 0) + 1 + rn^2); hot pixels weigh next to nothing."""
    return F.when(read_noise > hot, F.lit(1e-8)).otherwise(1.0 / (F.greatest(smoothed, F.lit(0.0)) + 1.0 + read_noise * read_noise))


def to_nm(pixels: Column, pixel_nm: Number, offset: Number = 0.0) -> Column:
    return pixels * pixel_nm + offset


def to_pixels(nm: Column, pixel_nm: Number, offset: Number = 0.0) -> Column:
    return (nm - offset) / pixel_nm


def linear_map(x: Column, y: Column, matrix: tuple[tuple[float, float], tuple[float, float]], shift: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    (a, b), (c, d) = matrix
    return x * a + y * b + shift[0], x * c + y * d + shift[1]


def rectangle_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Number) -> tuple[Column, Column]:
    """Corner arrays of the rectangle around a segment."""
    angle = F.atan2(y1 - y0, x1 - x0)
    dx, dy = F.sin(angle) * width / 2.0, F.cos(angle) * width / 2.0
    return F.array(x0 - dx, x0 + dx, x1 + dx, x1 - dx), F.array(y0 + dy, y0 - dy, y1 - dy, y1 + dy)


def polygon_corners(pick: Column) -> tuple[Column, Column]:
    """x and y arrays of a closed polygon (first point equals last); null when it is open."""
    closed = (F.size(pick) > 3) & (F.element_at(pick, 1) == F.element_at(pick, -1))
    return tuple(F.when(closed, F.transform(pick, lambda p, c=c: p[c])) for c in ("x", "y"))


def in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd rule: an edge counts if it spans y half-open and crosses to the right of x."""

    def crosses(i: Column) -> Column:
        j = F.when(i == 1, F.size(xs)).otherwise(i - 1)
        xi, yi, xj, yj = F.element_at(xs, i), F.element_at(ys, i), F.element_at(xs, j), F.element_at(ys, j)
        return F.when((yi > y) != (yj > y), x < (xj - xi) * (y - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi).otherwise(F.lit(False))

    hits = F.filter(F.sequence(F.lit(1), F.size(xs)), crosses)
    return F.size(hits) % 2 == 1


def error_inflation(snr: Column) -> Column:
    """How far colour errors are widened at a signal-to-noise ratio."""
    return F.when(snr < 2, 3.0).when(snr < 5, 2.0).when(snr < 10, 1.5).otherwise(1.0)


def channel_snr(fraction: Column, photons: Column, background: Column) -> Column:
    signal = fraction * photons
    return signal / F.sqrt(signal + background / 3.0)


def unit_sum(values: list[Column], errors: list[Column]) -> tuple[list[Column], list[Column]]:
    """Fractions of the sum, with errors in quadrature; a channel that isn't positive gets error 1e-3."""
    total = sum(values[1:], values[0])
    total_error = F.sqrt(sum((e * e for e in errors[1:]), errors[0] * errors[0]))
    shares = [v / total for v in values]
    spread = [F.when(positive(v), s * F.sqrt((e / v) ** 2 + (total_error / total) ** 2)).otherwise(F.lit(1e-3)) for v, e, s in zip(values, errors, shares)]
    return shares, spread


def roi_bounds(x: Column, y: Column, size: int, width: Number, height: Number, least: int = 4) -> Column:
    """Square window clipped to the image; null if clipping leaves no square or under ``least`` pixels."""
    half = size // 2
    x0, y0 = F.greatest(F.floor(x) - half, F.lit(0)), F.greatest(F.floor(y) - half, F.lit(0))
    x1, y1 = F.least(F.floor(x) - half + size, F.lit(width)), F.least(F.floor(y) - half + size, F.lit(height))
    fine = ((x1 - x0) == (y1 - y0)) & ((x1 - x0) >= least)
    return F.when(fine, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def elapsed(seconds: Column) -> Column:
    """Value and unit in which a duration reads well."""
    return F.when(seconds < 60, F.struct(seconds.alias("value"), F.lit("seconds").alias("unit"))).when(
        seconds < 3600, F.struct((seconds / 60).alias("value"), F.lit("minutes").alias("unit"))
    ).otherwise(F.struct((seconds / 3600).alias("value"), F.lit("hours").alias("unit")))


def fov_name(path: Column) -> Column:
    """Base name without its known endings, whatever their case."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)(\.(h5|hdf5|tif|tiff|ome|txt|csv|json))+$", "")


def diffraction_limit(wavelength: Column, na: Number) -> Column:
    return wavelength / (F.lit(na) * 2.0)


def sigma_psf(wavelength: Column, na: Number) -> Column:
    return wavelength / (F.lit(math.sqrt(2) * math.pi) * na)


def gauss2d(x: Column, y: Column, x0: Number, y0: Number, sigma: Number, amplitude: Number = 1.0) -> Column:
    return F.exp(-((x - x0) ** 2 + (y - y0) ** 2) / (2.0 * F.lit(sigma) ** 2)) * amplitude


def fwhm(sigma: Column) -> Column:
    return sigma * (2 * math.sqrt(2 * math.log(2)))


def sigma_of_fwhm(width: Column) -> Column:
    return width / (2 * math.sqrt(2 * math.log(2)))


def photon_energy_ev(wavelength_nm: Column) -> Column:
    """hc / wavelength."""
    return F.lit(1239.841984) / wavelength_nm


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: sum(x w) / sum(w), null without weight."""
    return F.try_divide(F.sum(x * w), F.sum(w))


def inverse_error_mean(x: Column, error: Column) -> tuple[Column, Column]:
    """Aggregates: mean weighted by 1/error, and its error from 1/error^2."""
    return weighted_mean(x, 1.0 / error), 1.0 / F.sqrt(F.sum(1.0 / (error * error)))


def pmin_weights(x: Number, n: Number) -> tuple[Column, Column]:
    """Optimal numbers of fitted lags for intercept and slope of a mean square displacement."""
    x, n = F.lit(x), F.lit(n)
    a = F.floor(2 + 1.6 * F.pow(x, F.lit(0.51)))
    la = F.lit(3.0) + F.sqrt(4.5 * F.pow(n, F.lit(0.4)) - 8.5)
    lb = 0.8 + 0.564 * n
    b = F.floor(2 + 1.35 * F.pow(x, F.lit(0.6)))
    return F.least(F.floor(la), a), F.least(F.floor(lb), b)


def duty_cycle(on_rate: Column, off_rate: Column) -> Column:
    return F.coalesce(F.try_divide(on_rate, on_rate + off_rate), F.lit(0.0))


def wrap(position: Column, size: Number, mode: str = "periodic") -> Column:
    """Boundary of a simulation box: periodic, reflective, or absorbing (unchanged)."""
    size = F.lit(size)
    if mode == "periodic":
        return position - F.floor(position / size) * size
    if mode == "reflective":
        mirrored = F.when(position < 0, -position).when(position > size, 2 * size - position).otherwise(position)
        return F.least(F.greatest(mirrored, F.lit(0.0)), size)
    return position


def dynamic_error(sigma0: float, s0: float, diffusion: Column, exposure: Number) -> Column:
    return sigma0 * F.sqrt(1.0 + diffusion * exposure / s0**2)
