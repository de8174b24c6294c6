"""Spectra as long tables (name, wavelength, value), and what cameras make of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.functions.exprs import channel_snr, error_inflation, unit_sum

CHANNELS = ("R", "G", "B")
#: Fixed value: h c in eV nm.
HC = 1239.841984


def names(summary: DataFrame, column: str) -> DataFrame:
    return summary.select(column).distinct().orderBy(column)


def select_spectra(table: DataFrame, wanted: Sequence[str], name: str = "name") -> DataFrame:
    """Rows of the named spectra in order of wavelength."""
    return table.where(F.col(name).isin(list(wanted))).orderBy(name, "wavelength_nm")


def resample(table: DataFrame, grid: DataFrame, value: str, name: str = "name", normalise: bool = False) -> DataFrame:
    """Spectra on a grid of wavelengths by straight lines, 0 outside their range; optionally of sum 1.

    Samples and grid points are ordered together, so each grid point finds
    its neighbours by a window.
    """
    spans = table.groupBy(name).agg(F.min("wavelength_nm").alias("lo__"), F.max("wavelength_nm").alias("hi__"))
    asked = spans.crossJoin(F.broadcast(grid.select("wavelength_nm").distinct()))
    known = table.select(name, "wavelength_nm", F.col(value).alias("v"), F.lit(0).alias("asked"), F.lit(True).alias("inside"))
    both = known.unionByName(asked.select(name, "wavelength_nm", F.lit(None).cast("double").alias("v"), F.lit(1).alias("asked"), F.col("wavelength_nm").between(F.col("lo__"), F.col("hi__")).alias("inside")))
    w = Window.partitionBy(name).orderBy("wavelength_nm", "asked")
    point = F.when(F.col("v").isNotNull(), F.struct(F.col("wavelength_nm").alias("x"), "v"))
    a = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = F.when(b["v"].isNull() | (a["x"] == b["x"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("wavelength_nm") - a["x"]) / (b["x"] - a["x"]))
    line = F.when(F.col("wavelength_nm") == a["x"], a["v"]).otherwise(line)
    out = both.withColumn("y", F.when(F.col("inside"), line).otherwise(0.0)).where("asked = 1").select(name, "wavelength_nm", F.col("y").alias(value))
    if normalise:
        out = out.withColumn(value, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(name))))
    return out


def spectrum_arrays(table: DataFrame, value: str, name: str = "name") -> DataFrame:
    """One row for each spectrum, with arrays in order of wavelength."""
    pairs = F.array_sort(F.collect_list(F.struct("wavelength_nm", value)))
    return table.groupBy(name).agg(pairs.alias("p")).select(name, F.col("p.wavelength_nm").alias("wavelength_nm"), F.col(f"p.{value}").alias(value))


def moments(table: DataFrame, value: str, order: int = 1, name: str = "name") -> DataFrame:
    """sum(x^k f) / sum(f) of each sampled curve."""
    return table.groupBy(name).agg(F.try_divide(F.sum(F.pow("wavelength_nm", F.lit(order)) * F.col(value)), F.sum(value)).alias("moment"))


def _product(c: Column) -> Column:
    return F.product(c)


def through_filters(dyes: DataFrame, filters: DataFrame) -> DataFrame:
    """Dye emission times the product of all filters at each wavelength: ``dye_name``, ``wavelength_nm``, ``intensity``."""
    passed = filters.groupBy("wavelength_nm").agg(_product(F.col("transmission")).alias("t__"))
    return dyes.join(passed, "wavelength_nm").select("dye_name", "wavelength_nm", (F.col("emission_intensity") * F.col("t__")).alias("intensity"))


def channel_fractions(spectra: DataFrame, efficiency: DataFrame, name: str = "dye_name", value: str = "intensity", normalised: bool = True) -> DataFrame:
    """Share of each channel (or its absolute value), and the mean wavelength.

    ``efficiency`` has ``wavelength_nm`` and the channels.  Normalised, a
    wavelength's light is split by the channels' efficiencies.
    """
    total = sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0]))
    met = spectra.join(efficiency, "wavelength_nm")
    parts = [F.sum(F.col(value) * (F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) if normalised else F.col(c))) for c in CHANNELS]
    out = met.groupBy(name).agg(*[p.alias(c) for p, c in zip(parts, CHANNELS)], F.sum(value).alias("s__"), (F.sum(F.col("wavelength_nm") * F.col(value)) / F.sum(value)).alias("mean_wavelength"))
    whole = sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0]))
    scale = whole if normalised else F.col("s__")
    return out.select(name, *[F.try_divide(F.col(c), scale).alias(c) for c in CHANNELS], "mean_wavelength")


def absolute_efficiency(spectra: DataFrame, efficiency: DataFrame, objective: DataFrame | None = None, name: str = "dye_name", value: str = "intensity") -> DataFrame:
    """Detected share of a spectrum by channel, with the objective's transmission if given."""
    if objective is not None:
        spectra = spectra.join(objective, "wavelength_nm").withColumn(value, F.col(value) * F.col("transmission")).drop("transmission")
    return channel_fractions(spectra, efficiency, name, value, normalised=False).drop("mean_wavelength")


def sample_photons(spectra: DataFrame, n: int, seed: int = 0, name: str = "dye_name", value: str = "intensity") -> DataFrame:
    """``n`` photon wavelengths of each spectrum by its trapezoid distribution, inverted by lines.

    Each photon's uniform number falls between two steps of the running
    integral; both carry a coarse cell of it, so the join is on cells.
    """
    w = Window.partitionBy(name).orderBy("wavelength_nm")
    v = F.greatest(F.col(value), F.lit(0.0))
    steps = spectra.select(name, "wavelength_nm", v.alias("v")).withColumns({"x0": F.lag("wavelength_nm").over(w), "v0": F.lag("v").over(w)})
    steps = steps.withColumn("area", F.coalesce((F.col("v") + F.col("v0")) / 2 * (F.col("wavelength_nm") - F.col("x0")), F.lit(0.0)))
    run = steps.withColumn("hi", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.sum("area").over(Window.partitionBy(name))
    run = run.withColumns({"hi": F.col("hi") / whole, "lo": (F.col("hi") - F.col("area")) / whole}).where("x0 IS NOT NULL AND area > 0")
    cells = 256
    run = run.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    photons = spectra.select(name).distinct().crossJoin(spectra.sparkSession.range(n).select(F.col("id").alias("photon")))
    unit = (F.pmod(F.xxhash64(name, "photon", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)).alias("u")
    photons = photons.select(name, "photon", unit).withColumn("cell", F.floor(F.col("u") * cells))
    met = photons.join(run, [name, "cell"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    x = F.col("x0") + (F.col("wavelength_nm") - F.col("x0")) * (F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return met.select(name, "photon", x.alias("photon_nm"))


def efficiency_grid(efficiency: DataFrame, step: float) -> DataFrame:
    """Channels at every ``step``, with the grid's whole number as key."""
    lo, hi = efficiency.agg(F.min("wavelength_nm"), F.max("wavelength_nm")).first()
    grid = efficiency.sparkSession.range(int(math.floor(lo / step)), int(math.ceil(hi / step)) + 1).select(F.col("id").alias("key"), (F.col("id") * step).alias("wavelength_nm"))
    long = efficiency.select("wavelength_nm", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("qe")) for c in CHANNELS])).alias("p")).select("p.name", "wavelength_nm", "p.qe")
    wide = resample(long, grid, "qe").groupBy("wavelength_nm").pivot("name", list(CHANNELS)).agg(F.first("qe"))
    return grid.join(wide, "wavelength_nm").select("key", "wavelength_nm", *CHANNELS)


def nearest_efficiency(photons: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """Each photon with the channels at the nearest grid point."""
    return photons.withColumn("key", F.bround(F.col("photon_nm") / step).cast("long")).join(grid.drop("wavelength_nm"), "key")


def detected_colours(photons: DataFrame, keys: Sequence[str], seed: int = 0, counts: bool = False) -> DataFrame:
    """Each photon goes to one channel by the efficiencies' shares; ratios or counts of each key."""
    total = sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0]))
    u = F.pmod(F.xxhash64(*keys, "photon", F.lit(seed + 7919)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    p0, p1 = F.col("R") / total, F.col("G") / total
    channel = F.when(u < p0, "R").when(u < p0 + p1, "G").otherwise("B")
    met = photons.withColumn("channel__", channel).groupBy(*keys).agg(*[F.count_if(F.col("channel__") == c).alias(c) for c in CHANNELS], F.avg("photon_nm").alias("mean_wavelength"), F.count("*").alias("n"))
    return met if counts else met.select(*keys, *[(F.col(c) / F.col("n")).alias(c) for c in CHANNELS], "mean_wavelength")


def bootstrap_colours(photons: DataFrame, per_image: int, seed: int = 0, name: str = "dye_name") -> DataFrame:
    """Colour ratios of consecutive images of ``per_image`` photons."""
    return detected_colours(photons.withColumn("bootstrap", F.floor(F.col("photon") / per_image)), (name, "bootstrap"), seed)


# an environment-sensitive dye


def skew_spectrum(centre_nm: float, grid: np.ndarray, sigma_ev: float = 0.15, alpha: float = -2.0, normalise: bool = True) -> np.ndarray:
    """Skewed Gaussian in energy, as intensity over wavelength, of unit area."""
    energy = HC / grid
    t = (energy - HC / centre_nm) / sigma_ev
    s = np.exp(-0.5 * t * t) * (1 + numeric.erf(alpha * t / math.sqrt(2)))
    out = s * energy**3 * HC / grid**2
    return out / np.trapezoid(out, grid) if normalise else out


def centre_of_mass(spectrum: np.ndarray, grid: np.ndarray) -> float:
    return float((grid * spectrum).sum() / spectrum.sum())


def centre_for_peak(peak_nm: float, grid: np.ndarray, sigma_ev: float = 0.15, alpha: float = -2.0, bounds: tuple[float, float] = (400.0, 900.0)) -> float:
    """The centre whose spectrum peaks at a wavelength."""
    fine = np.linspace(grid[0], grid[-1], 20 * len(grid))
    return numeric.bisect(lambda c: fine[int(np.argmax(skew_spectrum(c, fine, sigma_ev, alpha)))] - peak_nm, *bounds, rounds=40)


def forward(centre_nm: float, grid: np.ndarray, transmission: np.ndarray, efficiency: np.ndarray, na: float, pixel_nm: float) -> np.ndarray:
    """R, G, B shares and width (pixels) of the image of a molecule with this spectrum."""
    s = skew_spectrum(centre_nm, grid) * transmission
    rgb = np.array([np.trapezoid(s * q, grid) for q in efficiency])
    mean = np.trapezoid(s * grid, grid) / max(np.trapezoid(s, grid), 1e-300)
    return np.append(rgb / max(rgb.sum(), 1e-300), mean / (math.sqrt(2) * math.pi * na) / pixel_nm)


class WavelengthModel:
    """Forward model on a grid of centres, for fits by table and parabola."""

    def __init__(self, grid: np.ndarray, transmission: np.ndarray, efficiency: np.ndarray, na: float, pixel_nm: float, bounds: tuple[float, float] = (550.0, 750.0), step: float = 0.5):
        self.centres = np.arange(bounds[0], bounds[1] + step, step)
        self.table = np.array([forward(c, grid, transmission, efficiency, na, pixel_nm) for c in self.centres])
        self.mean = np.array([centre_of_mass(skew_spectrum(c, grid), grid) for c in self.centres])

    def fit(self, rgb: np.ndarray, widths: np.ndarray, rgb_err: np.ndarray, width_err: np.ndarray) -> tuple[np.ndarray, ...]:
        """First-moment wavelength, its error, and chi square of each row; NaN where no error is usable."""
        seen, err = np.hstack([rgb, widths]), np.hstack([rgb_err, width_err])
        model = np.hstack([self.table, self.table[:, 3:4]])
        w = np.where((err > 0) & np.isfinite(err) & np.isfinite(seen), 1 / np.maximum(err, 1e-300) ** 2, 0.0)
        seen = np.nan_to_num(seen)
        chi = (w * seen**2).sum(axis=1)[:, None] - 2 * (w * seen) @ model.T + w @ (model**2).T
        i = np.clip(chi.argmin(axis=1), 1, len(self.centres) - 2)
        rows = np.arange(len(seen))
        a, b, c = chi[rows, i - 1], chi[rows, i], chi[rows, i + 1]
        curve = a - 2 * b + c
        shift = np.clip(np.where(curve > 0, 0.5 * (a - c) / np.where(curve > 0, curve, 1), 0.0), -1, 1)
        value = np.interp(i + shift, np.arange(len(self.mean)), self.mean)
        step = self.centres[1] - self.centres[0]
        least = np.maximum(b - np.where(curve > 0, (a - c) ** 2 / (8 * np.where(curve > 0, curve, 1)), 0.0), 0.0)
        dof = np.maximum((w > 0).sum(axis=1) - 1, 1)
        error = np.sqrt(np.where(curve > 0, least / dof * 2 * step * step / np.where(curve > 0, curve, 1), np.nan))
        bad = (w > 0).sum(axis=1) < 2
        return np.where(bad, np.nan, value), np.where(bad, np.nan, error), np.where(bad, np.nan, least)


def fit_wavelengths(rows: DataFrame, model: WavelengthModel) -> DataFrame:
    """Add ``wavelength``, ``wavelength_err``, ``wavelength_chi`` to rows with A_R, A_G, A_B, s_x, s_y and errors.

    Fractions get unit sum; their errors grow where the signal is weak.
    """
    colours = ("A_R", "A_G", "A_B")
    shares, errors = unit_sum([F.col(c) for c in colours], [F.col(f"{c}_err") for c in colours])
    if "photons" in rows.columns and "background_photons" in rows.columns:
        errors = [e * error_inflation(channel_snr(s, F.col("photons"), F.col("background_photons"))) for s, e in zip(shares, errors)]
    names_ = [f"f__{i}" for i in range(3)] + [f"e__{i}" for i in range(3)]
    ready = rows.withColumns(dict(zip(names_, [*shares, *errors])))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for p in parts:
            if len(p):
                value, error, chi = sent.value.fit(p[names_[:3]].to_numpy(float), p[["s_x", "s_y"]].to_numpy(float), p[names_[3:]].to_numpy(float), p[["s_x_err", "s_y_err"]].to_numpy(float))
            else:
                value = error = chi = np.zeros(0)
            yield p.drop(columns=names_).assign(wavelength=value, wavelength_err=error, wavelength_chi=chi)

    return ready.mapInPandas(run, f"{fields}, wavelength double, wavelength_err double, wavelength_chi double")


def fit_wavelength_cells(rows: DataFrame, model: WavelengthModel, size: float, least: int, aggregate: str | None = None) -> DataFrame:
    """Fit averages of grid cells (of each aggregate); cells without a fit take their aggregate's; joined back to rows."""
    from lumenframe.operators.aggregate import cell_average

    columns, keys = ("A_R", "A_G", "A_B", "s_x", "s_y"), [aggregate] if aggregate else []
    low = rows.agg(F.min("xc").alias("x__"), F.min("yc").alias("y__"))
    placed = rows.crossJoin(F.broadcast(low)).withColumns({"cell_x": F.floor((F.col("xc") - F.col("x__")) / size), "cell_y": F.floor((F.col("yc") - F.col("y__")) / size)}).drop("x__", "y__")
    cells = fit_wavelengths(cell_average(rows, size, columns, least, keys), model).select(*keys, "cell_x", "cell_y", F.col("wavelength").alias("cell__"), F.col("wavelength_err").alias("cell_err__"))
    out = placed.join(cells, [*keys, "cell_x", "cell_y"], "left")
    value, error = F.col("cell__"), F.col("cell_err__")
    if aggregate:
        from lumenframe.functions.exprs import inverse_error_mean

        agg = []
        for c in columns:
            m, e = inverse_error_mean(F.col(c), F.col(f"{c}_err"))
            agg += [m.alias(c), e.alias(f"{c}_err")]
        agg += [F.sum(c).alias(c) for c in ("photons", "background_photons") if c in rows.columns]
        whole = fit_wavelengths(rows.groupBy(aggregate).agg(*agg), model).select(aggregate, F.col("wavelength").alias("whole__"), F.col("wavelength_err").alias("whole_err__"))
        out = out.join(whole, aggregate, "left")
        value, error = F.coalesce(F.nanvl(value, F.lit(None)), F.col("whole__")), F.coalesce(F.nanvl(error, F.lit(None)), F.col("whole_err__"))
    return out.withColumns({"wavelength": value, "wavelength_err": error}).drop("cell__", "cell_err__", "whole__", "whole_err__")


def fit_spectrum(table: DataFrame, value: str, name: str = "name", skewed: bool = False) -> DataFrame:
    """Gaussian (or skewed) fit of each spectrum: ``amplitude``, ``centre``, ``sigma``, ``skew``."""
    fields = f"`{name}` string, amplitude double, centre double, sigma double, skew double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["wavelength_nm"].to_numpy(float), part[value].to_numpy(float)
        total = max(y.sum(), 1e-300)
        m = (x * y).sum() / total
        s = math.sqrt(max(((x - m) ** 2 * y).sum() / total, 1e-12))

        def model(p: np.ndarray) -> np.ndarray:
            t = (x - p[1]) / p[2]
            g = p[0] * np.exp(-0.5 * t * t)
            return g * (1 + numeric.erf(p[3] * t / math.sqrt(2))) if skewed else g

        p, _ = numeric.least_squares(lambda q: model(q) - y, np.array([y.max(), m, s] + [0.1] * skewed))
        return pd.DataFrame([(part[name].iloc[0], p[0], p[1], abs(p[2]), p[3] if skewed else 0.0)], columns=["n", "a", "c", "s", "k"]).set_axis([name, "amplitude", "centre", "sigma", "skew"], axis=1)

    return table.groupBy(name).applyInPandas(run, fields)


def spectral_weights(spark: SparkSession, spectra: DataFrame, efficiency: DataFrame, wavelengths: Sequence[float], name: str = "dye_name") -> DataFrame:
    """Weight of each wavelength in each channel, of sum 1."""
    grid = spark.createDataFrame([(float(w),) for w in wavelengths], "wavelength_nm double")
    met = resample(spectra, grid, "intensity", name).join(efficiency, "wavelength_nm")
    out = met.select(name, "wavelength_nm", *[(F.col("intensity") * F.col(c)).alias(c) for c in CHANNELS])
    w = Window.partitionBy(name)
    return out.select(name, "wavelength_nm", *[F.try_divide(F.col(c), F.sum(c).over(w)).alias(c) for c in CHANNELS])
