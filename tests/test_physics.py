import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators import drift, fitting, image, mixture, regions, render, sequence, simulate, spectral

UNIT = (("R", "G"), ("G", "B"))


def test_mixture_recovers_two_dyes(spark):
    rng = np.random.default_rng(42)
    rows = []
    for c, m in enumerate(((0.7, 0.2), (0.2, 0.7))):
        for _ in range(300):
            p = rng.uniform(500, 5000)
            rows.append((len(rows), c, *[float(v) for v in np.array(m) + rng.normal(0, 0.1 / math.sqrt(p / 1000), 2)], 0.05 / math.sqrt(p / 1000), 0.05 / math.sqrt(p / 1000), p))
    df = spark.createDataFrame(rows, "loc_id long, true_channel int, A_R double, A_G double, A_R_err double, A_G_err double, photons double")
    for method in mixture.FITS:
        out, model = mixture.unmix(df, 2, method=method)
        order = np.argsort(model.means[:, 0])[::-1]
        assert np.abs(model.means[order] - [[0.7, 0.2], [0.2, 0.7]]).max() < 0.06, method
        assert abs(model.weights.sum() - 1) < 1e-6 and all(np.linalg.eigvalsh(c).min() > 0 for c in model.covariances)
        right = out.where("channel >= 0").select((F.col("channel") == F.element_at(F.array(*[F.lit(int(i)) for i in order]), F.col("true_channel") + 1)).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
        assert right[0] > 0.97 and right[1] > 450, method
        assert out.select(F.max(F.abs(F.aggregate("posterior", F.lit(0.0), lambda a, x: a + x) - 1))).first()[0] < 1e-9
    confusion = mixture.sampled_confusion(spark, model, 5000)
    assert all(0 <= r.share <= 1 for r in confusion.collect()) and 0.9 < mixture.accuracy(confusion, model) <= 1
    robust = mixture.robust_covariances(df, ("A_R", "A_G"), model.means, estimator="tukey")
    assert all(c[0, 0] > 0 for c in robust.covariances)


def test_best_dyes():
    pairs = {("a", "b"): 0.9, ("a", "c"): 0.99, ("b", "c"): 0.5, ("a", "d"): 0.8, ("b", "d"): 0.95, ("c", "d"): 0.97}
    assert mixture.best_dyes(list("abcd"), pairs, 2)[0] == ("a", "c")
    assert mixture.best_dyes(list("abcd"), pairs, 3) == (("a", "b", "d"), 0.8) or mixture.best_dyes(list("abcd"), pairs, 3)[1] == 0.8
    assert mixture.best_dyes(["a"], pairs, 1) == (("a",), 1.0)


def test_ring_correlation():
    rng = np.random.default_rng(42)
    for shape in ((128, 128), (256, 256), (128, 192)):
        a = rng.random(shape)
        assert np.allclose(render.ring_correlation(a, a), 1, atol=1e-6)
        assert abs(render.ring_correlation(a - a.mean(), rng.random(shape) - 0.5).mean()) < 0.1
    with pytest.raises(ValueError):
        render.ring_correlation(np.zeros((4, 4)), np.zeros((4, 5)))


def test_point_spread():
    p = simulate.pupil_psf(31, 0.1, 0.6, 1.4)
    assert abs(p.sum() - 1) < 1e-6 and np.abs(p - p[::-1]).max() < 1e-8 and np.abs(p - p.T).max() < 1e-8
    wide = simulate.pupil_psf(31, 0.1, 0.6, 1.4, z_um=0.6)
    assert wide.max() < p.max()
    blurred = simulate.motion_blur(lambda x, y: simulate.gaussian_spot((41, 41), x, y, 1.3, 1.3, 1000.0), 20.5, 20.5, 4.0, 0.3)
    assert blurred.sum() == pytest.approx(1000, rel=5e-3)


def test_fits_recover_simulated_spots(spark):
    rows = [(0, 20.4, 30.7, 4000.0), (0, 45.2, 12.1, 4000.0), (1, 33.3, 33.8, 4000.0), (2, 10.6, 50.2, 4000.0)]
    emitters = spark.createDataFrame(rows, "frame int, xc double, yc double, photons double")
    movie = simulate.movie(emitters, 3, 64, 64, background=3.0, seed=5)
    out = fitting.localise(movie, UNIT, variance=2.0, gain=2.0, offset=100.0, pfa=1e-6).collect()
    for f, x, y, _ in rows:
        near = [r for r in out if r.frame == f and math.hypot(r.xc - x, r.yc - y) < 0.3]
        assert near, (f, x, y)
        assert abs(near[0].s_x - 1.3) < 0.25 and near[0].xc_err < 0.2
    again = [(r.frame, r.xc) for r in fitting.localise(movie.repartition(3), UNIT, variance=2.0, gain=2.0, offset=100.0, pfa=1e-6).collect()]
    assert sorted(again) == sorted((r.frame, r.xc) for r in out)


@pytest.mark.parametrize("strategy", fitting.STRATEGIES)
def test_every_strategy_fits(strategy):
    rng = np.random.default_rng(1)
    masks = image.colour_masks(11, 11, UNIT)
    truth = fitting.scene(np.array([5.2, 4.7, 1.4, 1.2]), np.sqrt([300, 800, 500.0]), np.sqrt([20, 30, 25.0]), [masks[c] for c in "BGR"])
    raw = rng.poisson(truth).astype(float)
    smooth = numeric.gaussian_filter(raw, 1.0)
    got = fitting.fit_spot(raw, smooth, 1 / (np.maximum(smooth, 0) + 1), masks, 0.5, strategy, fixed=[5.2, 4.7, 1.4, 1.2])
    assert abs(got["x"] - 4.7) < 0.1 and abs(got["y"] - 5.2) < 0.1
    if strategy != "NOCOLOUR":
        assert abs(got["A_G"] - 800) < 120 and got["A_G_err"] > 0


def test_noise_gives_no_fit():
    rng = np.random.default_rng(0)
    raw = rng.poisson(10, (11, 11)).astype(float)
    masks = image.colour_masks(11, 11, UNIT)
    fits = [fitting.fit_spot(rng.poisson(10, (11, 11)).astype(float), raw, np.full((11, 11), 0.1), masks) for _ in range(10)]
    assert sum(f is None for f in fits) >= 3


def test_mosaics(spark):
    masks = image.colour_masks(8, 8, UNIT)
    flat = np.full((8, 8), 7.0)
    for strategy in ("bilinear", "gradient"):
        assert all(np.allclose(p, 7.0) for p in image.demosaic(flat, masks, strategy).values())
    assert np.array_equal(image.colour_masks(4, 4, UNIT, 1, 1)["B"], image.colour_masks(5, 5, UNIT)["B"][1:, 1:])
    assert image.stacked_masks(4, 4, UNIT).sum() == 16
    tile = image.symmetric_tile({"a": 8, "b": 8}, 4)
    assert sum(row.count("a") for row in tile) == 8
    frames = spark.createDataFrame([("f", 0, 4, 4, [float(i) for i in range(16)])], image.FRAME)
    binned = image.bin_frames(frames, 2).first()
    assert binned.pixels[0] == 0 + 1 + 4 + 5 and len(binned.pixels) == 16
    names = image.explode_pixels(frames).withColumn("c", image.pixel_colour(UNIT)).where("y = 1 AND x = 1").first()
    assert (names.c, names.value) == ("B", 5.0)


def test_drift_is_recovered(spark):
    rng = np.random.default_rng(0)
    places, rows = rng.uniform(10, 50, (60, 2)), []
    for f in range(200):
        d = (0.005 * f, -0.003 * f)
        for p in rng.choice(60, 25, replace=False):
            rows.append((0, len(rows), f, *[float(v) for v in places[p] + d + rng.normal(0, 0.03, 2)], int(p) if p < 8 else -1))
    df = spark.createDataFrame(rows, "fov_index int, loc_id long, frame int, xc double, yc double, group int")
    for found in (drift.fiducial_drift(df), drift.aim(df, drift.Params(50, 0.15, 0.9))):
        got = np.array([(r.frame, r.dx, r.dy) for r in found.orderBy("frame").collect()])
        assert len(got) == 200 and np.isfinite(got).all()
        assert abs((got[-1, 1] - got[0, 1]) - 1.0) < 0.25 and abs((got[-1, 2] - got[0, 2]) + 0.6) < 0.25
    moved = drift.undrift(df, "aim", params=drift.Params(50, 0.15, 0.9))
    before, after = (t.where("group >= 0").groupBy("group").agg(F.stddev("xc").alias("s")).agg(F.avg("s")).first()[0] for t in (df, moved))
    assert after < 0.5 * before
    with pytest.raises(ValueError):
        drift.undrift(df, "none")
    assert drift.aim(df.limit(0)).count() == 0


def test_wavelengths_come_back(spark):
    grid = np.arange(450.0, 850.0, 1.0)
    qe = np.array([np.exp(-(((grid - c) / 40) ** 2)) for c in (640, 560, 470)])
    model = spectral.WavelengthModel(grid, np.ones(len(grid)), qe, 1.4, 69.5)
    rng, rows = np.random.default_rng(0), []
    for i in range(200):
        k = 40 + i
        t = model.table[k] * (1 + 0.03 * rng.normal(size=4))
        rows.append((i, float(10 * (i // 100)), 1.0, *map(float, t[:3]), float(t[3]), float(t[3]), *[0.03] * 5, 1500.0, 50.0, float(model.mean[k]), i // 100))
    df = spark.createDataFrame(rows, "loc_id long, xc double, yc double, A_R double, A_G double, A_B double, s_x double, s_y double, A_R_err double, A_G_err double, A_B_err double, s_x_err double, s_y_err double, photons double, background_photons double, true_wl double, agg int")
    out = spectral.fit_wavelengths(df, model)
    assert out.select(F.avg(F.abs(F.col("wavelength") - F.col("true_wl")))).first()[0] < 10
    cells = spectral.fit_wavelength_cells(df, model, 5.0, 1000, "agg")
    assert cells.where("wavelength IS NULL").count() == 0  # every cell is too small, its aggregate stands in
    assert spectral.fit_wavelength_cells(df, model, 5.0, 1000).where("wavelength IS NOT NULL").count() == 0


def test_change_points():
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.poisson(5, 60), rng.poisson(30, 50), rng.poisson(12, 70)])
    for method, options in (("binary", {}), ("pelt", {}), ("level", {"penalty": 0.05})):
        got = sequence.find_change_points(y.astype(float), method, **options)
        assert got[-1] == 180 and any(abs(g - 60) <= 2 for g in got) and any(abs(g - 110) <= 3 for g in got)
    assert sequence.find_change_points(rng.poisson(9, 100).astype(float))[-1] == 100
    small = numeric.pelt(y[:40].astype(float), numeric.l2_cost(y[:40].astype(float)), 30.0, 2)
    cost, n = numeric.l2_cost(y[:40].astype(float)), 40
    best = [0.0] + [math.inf] * n
    for t in range(2, n + 1):
        best[t] = min((best[s] + cost(s, t) + 30.0 * (s > 0) for s in range(t - 1) if t - s >= 2 and best[s] < math.inf), default=math.inf)
    assert sum(cost(a, b) for a, b in zip([0, *small], small)) + 30.0 * (len(small) - 1) == pytest.approx(best[n])


def test_displacements(spark):
    paths = simulate.trajectories(spark, 30, 400, 0.5, 0.1, seed=1)
    assert paths.count() == 30 * 401
    d = sequence.diffusion_from_msd(sequence.msd(paths, max_lag=4), 0.1).agg(F.avg("D")).first()[0]
    assert abs(d - 0.5) < 0.08
    lags = {r.lag: r.msd for r in sequence.msd_all_lags(paths.where("molecule = 3")).collect()}
    for r in sequence.msd(paths.where("molecule = 3"), max_lag=10).collect():
        assert lags[r.lag] == pytest.approx(r.msd, rel=1e-6)
    best = sequence.diffusion_optimal(paths, 0.1).where("NOT isnan(D)").agg(F.avg("D"), F.count("*")).first()
    assert abs(best[0] - 0.5) < 0.1 and best[1] > 15
    walk = simulate.random_walk(spark, 50, 100, 0.5, 0.1, 1)
    d = sequence.diffusion_from_msd(sequence.msd(walk, max_lag=4), 0.1).agg(F.avg("D")).first()[0]
    assert abs(d - 0.5) < 0.08


def test_precision_from_neighbours(spark):
    rng, sigma, rows = np.random.default_rng(0), 0.05, []
    for m in range(400):
        x, y = rng.uniform(0, 200, 2)
        for f in range(5):
            rows.append((len(rows), 0, m % 50 * 10 + f, float(x + rng.normal(0, sigma)), float(y + rng.normal(0, sigma))))
    df = spark.createDataFrame(rows, "loc_id long, fov_index int, frame int, xc double, yc double")
    s, _ = mixture.nena(regions.next_frame_histogram(df, 1.0, 0.01, ("fov_index",)), 0.01)
    assert abs(s - sigma) < 0.015


def test_blinking_and_binding(spark):
    on = simulate.blinking(spark.range(300).select(F.col("id").alias("candidate_id")), 200, 0.05, 0.2, seed=1)
    assert abs(on.count() / (300 * 200) - 0.2) < 0.03
    bleached = simulate.blinking(spark.range(300).select(F.col("id").alias("candidate_id")), 200, 0.05, 0.2, seed=1, bleach_after=1)
    assert bleached.count() < 0.4 * on.count()
    runs = simulate.simulate_binding(spark, [("r", 0.05, 0.02), ("g", 0.05, 0.02)], 50, 0.1, simulate.Reaction(1.0, 1.5, {("r", "g"): 5.0}, {("r", "g"): 0.5}), (1, 2, 3))
    rows = runs.collect()
    assert len(rows) == 3 * 51 * 2 and any(r.partner >= 0 for r in rows) and all(0 <= r.x <= 1 for r in rows)
    assert simulate.bound_pairs(runs).where("a >= b").count() == 0


def test_patterns(spark):
    pattern = np.zeros((20, 30, 3), dtype=int)
    pattern[5:10, 5:10] = (255, 0, 0)
    pattern[12:18, 20:28] = (0, 255, 0)
    movie, truth = simulate.acquisition(spark, pattern, {(255, 0, 0): "red", (0, 255, 0): "green"}, 5, 100.0, 100.0, density_um2=30.0, on_rate=0.3, seed=3)
    assert movie.count() == 5 and truth.count() > 0
    for t in truth.where("frame = 0").collect():
        assert (5 <= t.xc <= 10 and 5 <= t.yc <= 10) if t.dye == "red" else (20 <= t.xc <= 28 and 12 <= t.yc <= 18)
    pixels = spark.createDataFrame([tuple(map(int, p)) for p in pattern.reshape(-1, 3)], "r int, g int, b int")
    assert [c for c, _ in simulate.palette(pixels)] == [(0, 0, 0), (0, 255, 0), (255, 0, 0)]


def test_renders_agree(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x), float(y), 0.3, 0.3, 1.0) for x, y in rng.uniform(5, 27, (200, 2))], ["xc", "yc", "xc_err", "yc_err", "photons"])
    view = (0.0, 0.0, 32.0, 32.0)
    total = {m: render.render(df, 2.0, view, m, **({"column": "xc"} if m == "gaussian_colour" else {})).agg(F.sum("value")).first()[0] for m in ("none", "gaussian", "gaussian_iso", "smooth", "convolve", "gaussian_colour")}
    assert total["none"] == 200 and all(abs(v - 200) < 10 for v in total.values())
    image_ = render.image_of(render.histogram(df, 2.0, view), 64, 64)
    smooth = render.image_of(render.render_smooth(df, 2.0, view), 64, 64)
    assert np.allclose(smooth[8:-8, 8:-8], numeric.gaussian_filter(image_, 1.0)[8:-8, 8:-8], atol=1e-9)
    with pytest.raises(ValueError):
        render.render(df, 2.0, view, "unknown")


def test_files_stay_apart(spark):
    """Two files with a frame of one number: windows, masks and sums are each file's own."""
    frames = spark.createDataFrame([(f, 0, 12, 12, [float(i + 1000 * k) for i in range(144)]) for k, f in enumerate("ab")], image.FRAME)
    spots = spark.createDataFrame([("a", 0, 1, 5, 5), ("b", 0, 2, 6, 6)], "file string, frame int, spot_id long, y int, x int")
    got = {(r.file, r.spot_id): r.pixels for r in image.cut_spots(frames, spots, 5).collect()}
    assert sorted(got) == [("a", 1), ("b", 2)] and got["a", 1][0] == 3 * 12 + 3 and got["b", 2][0] == 1000 + 4 * 12 + 4
    assert image.cut_spots(frames, spots.drop("file"), 5).count() == 4
    assert sorted((r.file, r.pixels[0]) for r in fitting.summed_frames(frames, 3).collect()) == [("a", 0.0), ("b", 1000.0)]
    assert image.mask_of(spots, 12, 12).count() == 2


def test_a_wide_plateau_has_one_maximum():
    flat = np.zeros((30, 400))
    flat[10, :] = 5.0
    found = image.local_maxima(flat, flat > 0, 3)
    assert [tuple(p) for p in found] == [(10, x) for x in range(0, 400, 4)]


def test_dyes_of_many_candidates():
    """Both sides of the number of subsets up to which they used to be tried one by one."""
    import itertools

    rng = np.random.default_rng(1)
    for n, k in ((8, 3), (9, 4)):
        names = [f"d{i}" for i in range(n)]
        pairs = {p: float(v) for p, v in zip(itertools.combinations(names, 2), rng.random(n * n).round(2))}
        worst = lambda s: min(pairs[p] for p in itertools.combinations(s, 2))  # noqa: E731, B023
        assert mixture.best_dyes(names, pairs, k) == (max(itertools.combinations(names, k), key=worst), max(map(worst, itertools.combinations(names, k))))
    names = [f"d{i}" for i in range(40)]
    pairs = {(a, b): 0.9 if int(a[1:]) % 8 == int(b[1:]) % 8 == 3 else 0.5 for a, b in itertools.combinations(names, 2)}
    assert mixture.best_dyes(names, pairs, 5) == (("d3", "d11", "d19", "d27", "d35"), 0.9)


def test_palette_shares_are_of_all_pixels(spark):
    rows = [(255, 255, 255)] * 3000 + [(200, 0, 0)] * 100 + [(0, 0, i % 250) for i in range(5000)]
    pixels = spark.createDataFrame(rows, "r int, g int, b int")
    found = simulate.palette(pixels, least_share=0.01, merge=24.0)
    assert found == [((255, 255, 255), 3000), ((200, 0, 0), 100)]
    near = spark.createDataFrame([(255, 255, 255)] * 90 + [(250, 250, 250)] * 10, "r int, g int, b int")
    assert [c for c, _ in simulate.palette(near)] == [(255, 255, 255), (250, 250, 250)]


def test_each_field_has_its_own_drift(spark):
    rng = np.random.default_rng(0)
    rows, places = [], rng.uniform(10, 50, (40, 2))
    for fov, speed in (("one", 0.01), ("two", -0.008)):
        for f in range(150):
            for p in rng.choice(40, 20, replace=False):
                rows.append((fov, f, *[float(v) for v in places[p] + [speed * f, 0.0] + rng.normal(0, 0.03, 2)], int(p)))
    df = spark.createDataFrame(rows, "fov_name string, frame int, xc double, yc double, place int")
    moved = drift.undrift(df, "aim", params=drift.Params(50, 0.15, 0.9), keys=("fov_name",))
    spread = lambda t: {r.fov_name: r.s for r in t.groupBy("fov_name", "place").agg(F.stddev("xc").alias("s")).groupBy("fov_name").agg(F.avg("s").alias("s")).collect()}
    before, after = spread(df), spread(moved)
    assert all(after[k] < 0.4 * before[k] for k in ("one", "two"))
