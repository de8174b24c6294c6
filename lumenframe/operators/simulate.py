"""Seeded generators: cameras, spots, movies, patterns, blinking, diffusion.

What is drawn depends on the seed and a row's key only, so a rerun of a
task gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.functions.exprs import wrap
from lumenframe.operators.image import FRAME


def rng_of(*key: int) -> np.random.Generator:
    return np.random.default_rng([abs(int(k)) for k in key])


# cameras and spots


@dataclass(frozen=True)
class Camera:
    """Maps of gain, offset, variance and relative efficiency, or single values."""

    gain: np.ndarray | float = 2.0
    offset: np.ndarray | float = 100.0
    variance: np.ndarray | float = 2.0
    rqe: np.ndarray | float = 1.0
    unit: tuple[tuple[str, ...], ...] = (("R", "G"), ("G", "B"))


def camera_maps(height: int, width: int, gain: float = 2.0, offset: float = 100.0, variance: float = 2.0, rqe: float = 1.0, spread: float = 0.02, seed: int = 0, relative: bool = True) -> Camera:
    """Normal gains and offsets, gamma variances, normal relative efficiencies (1 if switched off)."""
    r, size = rng_of(seed), (height, width)
    return Camera(r.normal(gain, spread * gain, size), r.normal(offset, spread * offset, size), r.gamma(2.0, variance / 2.0, size), r.normal(rqe, spread * rqe, size) if relative else 1.0)


def gaussian_spot(shape: tuple[int, int], x0: float, y0: float, sx: float, sy: float, photons: float) -> np.ndarray:
    """Photons of a Gaussian integrated over pixels; centres of pixels are at halves."""
    edge = lambda n, c, s: np.diff(0.5 * numeric.erf((np.arange(n + 1) - c) / (s * math.sqrt(2))))
    return photons * np.outer(edge(shape[0], y0, sy), edge(shape[1], x0, sx))


def gaussian_spot_cropped(shape: tuple[int, int], x0: float, y0: float, sx: float, sy: float, photons: float, reach: float = 5.0) -> np.ndarray:
    """The same, computed within some sigma only."""
    out = np.zeros(shape)
    ya, yb = max(0, int(y0 - reach * sy)), min(shape[0], int(y0 + reach * sy) + 2)
    xa, xb = max(0, int(x0 - reach * sx)), min(shape[1], int(x0 + reach * sx) + 2)
    if ya < yb and xa < xb:
        out[ya:yb, xa:xb] = gaussian_spot((yb - ya, xb - xa), x0 - xa, y0 - ya, sx, sy, photons)
    return out


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """By its integral, on a fixed grid."""
    t = np.linspace(0, np.pi, 401)
    return np.trapezoid(np.cos(t - np.multiply.outer(x, np.sin(t))), t, axis=-1) / np.pi


def airy_spot(shape: tuple[int, int], x0: float, y0: float, na: float, wavelength_nm: float, pixel_nm: float, photons: float) -> np.ndarray:
    y, x = np.indices(shape) + 0.5
    r = np.hypot(y - y0, x - x0) * pixel_nm * 2 * math.pi * na / wavelength_nm
    out = np.where(r < 1e-9, 1.0, (2 * bessel_j1(r) / np.where(r < 1e-9, 1.0, r)) ** 2)
    return photons * out / out.sum()


def placed_photons(shape: tuple[int, int], x0: float, y0: float, sigma: float, photons: float, r: np.random.Generator) -> np.ndarray:
    """Poisson photons on the pixel of the spot, blurred after."""
    out = np.zeros(shape)
    out[int(y0) % shape[0], int(x0) % shape[1]] = r.poisson(photons)
    return numeric.gaussian_filter(out, sigma)


def electrons(photons: np.ndarray, efficiency: np.ndarray | float, r: np.random.Generator, background: float = 0.0) -> np.ndarray:
    """Poisson photons, each seen with its pixel's efficiency."""
    return r.binomial(r.poisson(np.maximum(photons, 0) + background), np.clip(np.broadcast_to(efficiency, photons.shape), 0, 1))


def counts(seen: np.ndarray, camera: Camera, r: np.random.Generator) -> np.ndarray:
    """Camera counts of electrons (a frame or a stack), with read noise."""
    noise = r.normal(0.0, np.sqrt(np.broadcast_to(camera.variance, seen.shape)))
    return np.clip(np.rint(seen * camera.gain * camera.rqe + camera.offset + noise), 0, 65535)


def noise_frames(shape: tuple[int, int], lam: float, mu: float, sigma: float, r: np.random.Generator) -> np.ndarray:
    return np.clip(r.poisson(lam, shape) + r.normal(mu, sigma, shape), 0, None)


def motion_blur(make, x0: float, y0: float, length: float, direction: float, n: int = 11) -> np.ndarray:
    """Mean of images along a straight path around a place."""
    steps = np.linspace(-0.5, 0.5, n) * length
    return np.mean([make(x0 + s * math.cos(direction), y0 + s * math.sin(direction)) for s in steps], axis=0)


def efficiency_of(shape: tuple[int, int], unit: Sequence[Sequence[str]], share: dict[str, float]) -> np.ndarray:
    """Efficiency of each mosaic pixel for a dye."""
    tile = np.array([[share.get(c, 0.0) for c in row] for row in unit])
    y, x = np.indices(shape)
    return tile[y % tile.shape[0], x % tile.shape[1]]


def movie(emitters: DataFrame, n_frames: int, height: int, width: int, camera: Camera = Camera(), sigma: float = 1.3, background: float = 5.0, seed: int = 0, file: str = "simulated", dyes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Frames with the spots of ``emitters`` (``frame``, ``xc``, ``yc``, ``photons``, optional ``dye``).

    Frames are dealt to tasks and meet their emitters as one array.
    """
    spark = emitters.sparkSession
    named = "dye" in emitters.columns
    held = emitters.groupBy("frame").agg(F.collect_list(F.struct(F.col("xc").alias("x"), F.col("yc").alias("y"), "photons", *(["dye"] if named else []))).alias("spots"))
    every = spark.range(n_frames).select(F.col("id").cast("int").alias("frame")).join(held, "frame", "left")
    sent = spark.sparkContext.broadcast(camera)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for p in parts:
            rows = []
            for f, spots in zip(p["frame"], p["spots"]):
                r, total = rng_of(seed, f), np.zeros((height, width))
                for s in sorted(spots if spots is not None else [], key=lambda s: (s["x"], s["y"])):
                    light = gaussian_spot_cropped((height, width), s["x"], s["y"], sigma, sigma, s["photons"])
                    total += light * (efficiency_of(light.shape, own.unit, dyes[s["dye"]]) if named and dyes else 1.0)
                rows.append((file, f, height, width, counts(electrons(total, 1.0, r, background), own, r).ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["file", "frame", "height", "width", "pixels"])

    return every.mapInPandas(run, FRAME)


def labelled_stack(spark: SparkSession, places: Sequence[tuple[float, float]], n_frames: int, height: int, width: int, photons: float, density: float, sigma: float = 1.3, seed: int = 0, background_places: Sequence[tuple[float, float]] = (), background_photons: float = 0.0, **options) -> DataFrame:
    """A movie in which each place shines in a frame with probability ``density``."""
    rows = [(i, float(x), float(y), float(p)) for i, (x, y, p) in enumerate([(*c, photons) for c in places] + [(*c, background_photons) for c in background_places])]
    table = spark.createDataFrame(rows, "id long, xc double, yc double, photons double").crossJoin(spark.range(n_frames).select(F.col("id").cast("int").alias("frame")))
    u = F.pmod(F.xxhash64("id", "frame", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return movie(table.where(u < density).drop("id"), n_frames, height, width, sigma=sigma, seed=seed, **options)


# vectorial point spread by Fourier optics


def pupil_psf(size: int, pixel_um: float, wavelength_um: float, na: float, index: float = 1.518, z_um: float = 0.0, x0_um: float = 0.0, y0_um: float = 0.0, pad: int = 4, phase=None) -> np.ndarray:
    """Image of an isotropic emitter at a defocus, of sum 1: six pupil fields of three dipole axes, propagated by FFT."""
    n = pad * size
    k = np.fft.fftfreq(n, pixel_um)
    ky, kx = np.meshgrid(k, k, indexing="ij")
    rho = np.hypot(kx, ky) * wavelength_um
    inside = rho <= min(na, 0.999 * index)
    sin_t = np.where(inside, rho / index, 0.0)
    cos_t = np.sqrt(1 - sin_t**2)
    phi = np.arctan2(ky, kx)
    shift = np.exp(2j * np.pi * (index * cos_t * z_um / wavelength_um - kx * x0_um - ky * y0_um))
    if phase is not None:
        shift = shift * np.exp(1j * phase(rho / na, phi))
    taper = np.where(inside, 1 / np.sqrt(np.maximum(cos_t, 1e-6)), 0.0)
    c, s = np.cos(phi), np.sin(phi)
    fields = [cos_t * c * c + s * s, (cos_t - 1) * s * c, (cos_t - 1) * s * c, cos_t * s * s + c * c, sin_t * c, sin_t * s]
    total = np.zeros((n, n))
    for f in fields:
        total += np.abs(np.fft.fftshift(np.fft.ifft2(taper * f * shift))) ** 2
    a = n // 2 - size // 2
    out = total[a : a + size, a : a + size]
    return out / out.sum()


def psf_stack(size: int, pixel_um: float, wavelengths_um: Sequence[float], weights: Sequence[float], z_um: Sequence[float], na: float, **options) -> np.ndarray:
    """(z, y, x) with wavelengths mixed by weight, each plane of sum 1."""
    total = sum(weights)
    return np.array([sum(w / total * pupil_psf(size, pixel_um, l, na, z_um=z, **options) for l, w in zip(wavelengths_um, weights)) for z in z_um])


# patterns


def palette(pixels: DataFrame, least_share: float = 5e-4, merge: float = 24.0, background: tuple[int, int, int] | None = None) -> list[tuple[tuple[int, int, int], int]]:
    """Colours of an image (``r g b`` columns) by count, background first, near ones merged into the more common.

    The background is the commonest colour unless named; colours near it stay.
    Shares are of all pixels, so at most 1 / ``least_share`` rows come to the driver.
    """
    counts = pixels.groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    most = F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("r"), -F.col("g"), -F.col("b")))
    total, top = counts.agg(F.sum("n"), most).first()
    if not total:
        return [(background or (0, 0, 0), 0)]
    back = tuple(background or top)
    held = counts.where((F.col("r") == back[0]) & (F.col("g") == back[1]) & (F.col("b") == back[2])).agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") >= least_share * total).orderBy(F.col("n").desc(), "r", "g", "b").collect()
    found: dict[tuple[int, int, int], int] = {}
    for *colour, n in common:
        if tuple(colour) != back and min((math.dist(colour, k) for k in found), default=math.inf) >= merge:
            found[tuple(colour)] = n
    return [(back, held), *found.items()]


def masks_of(image: np.ndarray, colours: Sequence[tuple[int, int, int]], background: int = 0) -> dict[tuple[int, int, int], np.ndarray]:
    """Masks of the nearest palette colour of an RGB or RGBA image, without the background and what is see-through."""
    near = ((image[..., None, :3].astype(float) - np.array(colours)) ** 2).sum(axis=-1).argmin(axis=-1)
    solid = np.ones(near.shape, dtype=bool)
    if image.shape[-1] == 4 and np.ptp(image[..., 3]):
        solid = image[..., 3] > numeric.otsu(image[..., 3].ravel())
    return {tuple(c): (near == i) & solid for i, c in enumerate(colours) if i != background}


def positions_in(mask: np.ndarray, r: np.random.Generator, n: int | None = None, density_um2: float | None = None, pixel_nm: float = 100.0) -> np.ndarray:
    """(x, y) draws from a mask with replacement, half a pixel of jitter; ``n`` of them or Poisson by density."""
    at = np.argwhere(mask)
    if n is None:
        n = int(r.poisson(density_um2 * len(at) * (pixel_nm / 1000) ** 2))
    if not len(at) or not n:
        return np.zeros((0, 2))
    chosen = at[r.integers(0, len(at), n)] + 0.5 + r.uniform(-0.5, 0.5, (n, 2))
    return chosen[:, ::-1]


def pool_size(density_um2: float, area_um2: float, n_frames: int, duty: float = 1.0) -> int:
    return max(1, round(density_um2 * area_um2 * n_frames * duty))


def pattern_pixel_nm(width_px: int, fov_um: float) -> float:
    return fov_um * 1000.0 / width_px


def fov_in_camera_pixels(shape: tuple[int, int], pattern_nm: float, camera_nm: float) -> tuple[int, int]:
    return math.ceil(shape[0] * pattern_nm / camera_nm), math.ceil(shape[1] * pattern_nm / camera_nm)


def blinking(candidates: DataFrame, n_frames: int, on_rate: float, off_rate: float, seed: int = 0, bleach_after: int | None = None) -> DataFrame:
    """Frames in which candidates (``candidate_id``) shine: a two-state chain, bleached after some cycles if given."""
    extra = [f for f in candidates.schema.fields if f.name != "candidate_id"]
    schema = ", ".join(["candidate_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "frame int"])
    start = on_rate / (on_rate + off_rate) if on_rate + off_rate else 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for c in p.to_dict("records"):
                r = rng_of(seed, c["candidate_id"])
                on, cycles, u = r.random() < start, 0, r.random(n_frames)
                for f in range(n_frames):
                    if on:
                        rows.append([c["candidate_id"], *[c[e.name] for e in extra], f])
                        if u[f] < off_rate:
                            on, cycles = False, cycles + 1
                            if bleach_after is not None and cycles >= bleach_after:
                                break
                    elif u[f] < on_rate:
                        on = True
            yield pd.DataFrame(rows, columns=["candidate_id", *[e.name for e in extra], "frame"])

    return candidates.mapInPandas(run, schema)


def photon_budget(rows: DataFrame, low: float, high: float, seed: int = 0, keys: Sequence[str] = ("candidate_id", "frame")) -> DataFrame:
    """One uniform photon number for each row's key."""
    u = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.withColumn("photons", low + u * (high - low))


def acquisition(spark: SparkSession, image: np.ndarray, dyes: dict[tuple[int, int, int], str], n_frames: int, pattern_nm: float, camera_nm: float, density_um2: float = 5.0, on_rate: float = 0.02, off_rate: float = 0.5, photons: tuple[float, float] = (500.0, 2000.0), camera: Camera = Camera(), drift: tuple[float, float] = (0.0, 0.0), seed: int = 0, bleach_after: int | None = None, channels: dict[str, dict[str, float]] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Movie and ground truth of a pattern image whose colours are dyes; ``drift`` in pixels a frame."""
    rows, height_width = [], fov_in_camera_pixels(image.shape[:2], pattern_nm, camera_nm)
    colours = [(-1, -1, -1), *dyes]
    for colour, mask in masks_of(image, colours, 0).items():
        for x, y in positions_in(mask, rng_of(seed, *colour), density_um2=density_um2, pixel_nm=pattern_nm):
            rows.append((len(rows), float(x * pattern_nm / camera_nm), float(y * pattern_nm / camera_nm), dyes[colour]))
    pool = spark.createDataFrame(rows, "candidate_id long, xc double, yc double, dye string")
    shining = photon_budget(blinking(pool, n_frames, on_rate, off_rate, seed, bleach_after), *photons, seed)
    truth = shining.withColumns({"xc": F.col("xc") + F.col("frame") * drift[0], "yc": F.col("yc") + F.col("frame") * drift[1]})
    return movie(truth, n_frames, *height_width, camera=camera, seed=seed, dyes=channels, **options), truth


# diffusion


def displacements(d: float, n: int, dt: float, exposure: float, r: np.random.Generator, error: float = 0.0) -> np.ndarray:
    """Measured steps of a Brownian particle: variance 2 D (dt - exposure / 3) + 2 error^2 and
    neighbour covariance D exposure / 3 - error^2, by the tridiagonal factor."""
    a, b = 2 * d * (dt - exposure / 3) + 2 * error**2, d * exposure / 3 - error**2
    z, out, diag, below, last = r.standard_normal(n), np.empty(n), 0.0, 0.0, 0.0
    for i in range(n):
        below = b / diag if i else 0.0
        diag = math.sqrt(max(a - below * below, 1e-300))
        out[i] = diag * z[i] + below * last
        last = z[i]
    return out


def trajectories(spark: SparkSession, n_molecules: int, n_steps: int, d: float, dt: float, seed: int = 0, exposure: float = 0.0, start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``molecule``, ``t``, ``x``, ``y`` of free two-dimensional diffusion."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for m in p["id"]:
                r = rng_of(seed, m)
                x, y = (np.concatenate([[s], s + np.cumsum(displacements(d, n_steps, dt, exposure, r))]) for s in start)
                yield pd.DataFrame({"molecule": m, "t": np.arange(n_steps + 1) * dt, "x": x, "y": y})

    return spark.range(n_molecules).mapInPandas(run, "molecule long, t double, x double, y double")


def random_walk(spark: SparkSession, n_molecules: int, n_steps: int, d: float, dt: float, seed: int = 0, box: float | None = None, mode: str = "periodic") -> DataFrame:
    """The same with native windows over seeded normal steps, wrapped into a box."""
    steps = spark.range(n_molecules).select(F.col("id").alias("molecule"), F.explode(F.sequence(F.lit(0), F.lit(n_steps))).alias("k"))
    unit = lambda i: (F.pmod(F.xxhash64("molecule", "k", F.lit(seed * 4 + i)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    radius, s = F.sqrt(-2 * F.ln(unit(0))), math.sqrt(2 * d * dt)
    angle = 2 * math.pi * unit(1)
    moved = F.col("k") > 0
    rows = steps.withColumns({"dx": F.when(moved, s * radius * F.cos(angle)).otherwise(0.0), "dy": F.when(moved, s * radius * F.sin(angle)).otherwise(0.0)})
    run = Window.partitionBy("molecule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.sum("dx").over(run), F.sum("dy").over(run)
    if box is not None:
        x, y = wrap(x + box / 2, box, mode), wrap(y + box / 2, box, mode)
    return rows.select("molecule", (F.col("k") * dt).alias("t"), x.alias("x"), y.alias("y"))


@dataclass
class Reaction:
    """Binding in a box: rates by colour pair, one time unit throughout."""

    size: float
    radius: float
    bind: dict[tuple[str, str], float] = field(default_factory=dict)
    unbind: dict[tuple[str, str], float] = field(default_factory=dict)
    mode: str = "periodic"

    def rate(self, table: dict, a: str, b: str) -> float:
        return table.get((a, b), table.get((b, a), 0.0))


def mesoscopic_rates(k: float, d: float, lattice: float, dims: int = 2) -> float:
    """Binding rate on a lattice: slowed by the time two walkers take to meet."""
    if d <= 0:
        return 0.0
    meet = lattice**2 / (2 * dims * d) * (max(1.0, math.log(max(2.0, lattice / 0.005))) if dims == 2 else 1.0)
    return k / (1 + k * meet)


def simulate_binding(spark: SparkSession, molecules: Sequence[tuple[str, float, float]], n_steps: int, dt: float, reaction: Reaction, seeds: Sequence[int] = (0,)) -> DataFrame:
    """Diffusion with binding: each seed is one simulation and one task.

    ``molecules``: colour, free and bound diffusion.  Bound pairs move as
    one.  Returns ``seed``, ``molecule``, ``step``, ``x``, ``y``, ``partner`` (-1 if free).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for seed in p["seed"]:
                yield pd.DataFrame(binding_run(molecules, n_steps, dt, reaction, int(seed)), columns=["seed", "molecule", "step", "x", "y", "partner"])

    return spark.createDataFrame([(int(s),) for s in seeds], "seed int").repartition(len(seeds), "seed").mapInPandas(run, "seed int, molecule int, step int, x double, y double, partner int")


def binding_run(molecules: Sequence[tuple[str, float, float]], n_steps: int, dt: float, reaction: Reaction, seed: int) -> list[tuple]:
    r, n = rng_of(seed), len(molecules)
    place, partner, out = r.uniform(0, reaction.size, (n, 2)), np.full(n, -1), []
    for step in range(n_steps + 1):
        out += [(seed, i, step, *map(float, place[i]), int(partner[i])) for i in range(n)]
        for i in range(n):
            if partner[i] < 0 or partner[i] > i:
                d = molecules[i][2] if partner[i] >= 0 else molecules[i][1]
                new = place[i] + r.normal(0, math.sqrt(2 * d * dt), 2)
                if reaction.mode == "periodic":
                    new %= reaction.size
                elif reaction.mode == "reflective":
                    new = np.clip(np.where(new < 0, -new, np.where(new > reaction.size, 2 * reaction.size - new, new)), 0, reaction.size)
                place[i] = new
                if partner[i] >= 0:
                    place[partner[i]] = new
        left = dt
        while left > 0:
            events = []
            for i in range(n):
                if partner[i] > i:
                    events.append((reaction.rate(reaction.unbind, molecules[i][0], molecules[partner[i]][0]), "off", i, int(partner[i])))
                elif partner[i] < 0:
                    for j in range(i + 1, n):
                        if partner[j] < 0 and np.hypot(*(place[i] - place[j])) <= reaction.radius:
                            events.append((reaction.rate(reaction.bind, molecules[i][0], molecules[j][0]), "on", i, j))
            events = [e for e in events if e[0] > 0]
            total = sum(e[0] for e in events)
            if not total:
                break
            left -= r.exponential(1 / total)
            if left <= 0:
                break
            u, run = r.random() * total, 0.0
            for rate, kind, i, j in events:
                run += rate
                if u <= run:
                    if kind == "on":
                        partner[i], partner[j] = j, i
                        place[i] = place[j] = (place[i] + place[j]) / 2
                    else:
                        partner[i] = partner[j] = -1
                    break
    return out


def bound_pairs(rows: DataFrame) -> DataFrame:
    """Distinct unordered pairs at each step."""
    return rows.where("partner >= 0").select("seed", "step", F.least("molecule", "partner").alias("a"), F.greatest("molecule", "partner").alias("b")).distinct()


def imaging_rows(paths: DataFrame, photons: float, blink: float = 0.0, seed: int = 0) -> DataFrame:
    """Trajectories as emitters: ``frame``, ``xc``, ``yc``, ``photons``, dark with probability ``blink``."""
    u = F.pmod(F.xxhash64("molecule", "step", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return paths.where(u >= blink).select(F.col("step").alias("frame"), F.col("x").alias("xc"), F.col("y").alias("yc"), F.lit(float(photons)).alias("photons"))


# sweeps


def fit_sweep(spark: SparkSession, photons: Sequence[float], strategies: Sequence[str] = ("STANDARD_DATA",), read_noise: Sequence[float] = (1.0,), n: int = 50, size: int = 11, sigma: float = 1.3, background: float = 5.0, efficiency: dict[str, float] | None = None, camera: Camera = Camera(), seed: int = 0) -> DataFrame:
    """Fits of simulated spots over a grid of photons, strategies and read noise; a row for each bootstrap."""
    from lumenframe.operators import fitting, image

    share = efficiency or {"R": 0.5, "G": 0.6, "B": 0.4}
    grid = [(float(p), s, float(rn), b) for p in photons for s in strategies for rn in read_noise for b in range(n)]
    table = spark.createDataFrame(grid, "n_photons double, strategy string, read_noise double, bootstrap int").repartition(max(1, min(64, len(grid) // 8)))
    names = ["xc", "yc", "s_x", "s_y", "A_R", "A_G", "A_B", "chi_sqr"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = image.colour_masks(size, size, camera.unit)
        for p in parts:
            rows = []
            for n_photons, strategy, rn, b in p.itertuples(index=False):
                r = rng_of(seed, int(n_photons), b, int(rn * 1000))
                x0, y0 = size / 2 + r.uniform(-0.5, 0.5, 2)
                light = gaussian_spot((size, size), x0, y0, sigma, sigma, n_photons) * efficiency_of((size, size), camera.unit, share)
                raw = electrons(light, 1.0, r, background) + r.normal(0, rn, (size, size))
                smooth = numeric.gaussian_filter(raw, 1.0)
                fit = fitting.fit_spot(raw, smooth, 1 / (np.maximum(smooth, 0) + 1 + rn**2), masks, rn, strategy, fixed=[y0 - 0.5, x0 - 0.5, sigma, sigma])
                if fit:
                    fit |= {"xc": fit["x"] + 0.5 - x0, "yc": fit["y"] + 0.5 - y0}
                    rows.append((n_photons, strategy, rn, b, *[fit.get(c, math.nan) for c in names]))
            yield pd.DataFrame(rows, columns=["n_photons", "strategy", "read_noise", "bootstrap", *names])

    return table.mapInPandas(run, "n_photons double, strategy string, read_noise double, bootstrap int, " + ", ".join(f"`{c}` double" for c in names))
