import math

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import exprs
from lumenframe.operators import aggregate, filters, regions
from lumenframe.schema import localisation_columns, localisation_schema


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize("path, name", [("/path/to/Pos0_undrifted_locs.h5", "Pos0_undrifted_locs"), ("nopattern.h5", "nopattern"), ("a/b.OME.Tif", "b"), ("x.csv.txt", "x"), ("plain", "plain")])
def test_fov_names(spark, path, name):
    assert one(spark, exprs.fov_name(F.col("p")), p=path) == name


def test_photons_of_dark_rows_stay(spark):
    rows = [(0.0, 0.0, 0.0, 1.0, 1.0, 2.0), (1.0, 2.0, 1.0, 0.0, 0.0, 0.0), (float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ["A_B", "A_G", "A_R", "bg_B", "bg_G", "bg_R"])
    got = exprs.photon_columns(df, normalise=True).collect()
    assert (got[0].A_B, got[0].photons, got[0].bg_R) == (0.0, 0.0, 0.5)
    assert (got[1].A_G, got[1].bg_R) == (0.5, 0.0)
    assert math.isnan(got[2].photons) and got[2].A_G == 1.0


def test_photoelectrons_and_maps_of_another_size(spark):
    df = spark.createDataFrame([([10.0, 20.0], [2.0, 4.0], [2.0, 4.0], [0.5, 1.0], [1.0])], "raw array<double>, g array<double>, o array<double>, q array<double>, bad array<double>")
    full, odd = df.select(exprs.photoelectrons(F.col("raw"), F.col("g"), F.col("o"), F.col("q")).alias("a"), exprs.photoelectrons(F.col("raw"), F.col("bad"), F.col("o")).alias("b")).first()
    assert full == [8.0, 4.0] and odd == [10.0, 20.0]


def test_clipped_windows_are_rejected(spark):
    df = spark.createDataFrame([(50.0, 50.0), (2.0, 50.0), (2.0, 2.0)], ["x", "y"])
    got = [r.b for r in df.select(exprs.roi_bounds(F.col("x"), F.col("y"), 9, 100, 100).alias("b")).collect()]
    assert tuple(got[0]) == (46, 46, 55, 55) and got[1] is None and tuple(got[2]) == (0, 0, 7, 7)


def test_small_expressions(spark):
    assert one(spark, exprs.error_inflation(F.col("x")), x=1.9) == 3.0
    assert one(spark, exprs.duty_cycle(F.col("a"), F.col("b")), a=0.0, b=0.0) == 0.0
    assert one(spark, exprs.pixel_weight(F.col("s"), F.col("n"), 5.0), s=-1.0, n=2.0) == pytest.approx(0.2)
    assert one(spark, exprs.wrap(F.col("x"), 10.0, "reflective"), x=-3.0) == 3.0
    assert one(spark, exprs.sigma_psf(F.col("l"), 1.4), l=600.0) == pytest.approx(600 / (math.sqrt(2) * math.pi * 1.4))
    assert one(spark, exprs.pixel_weight(F.col("s"), F.col("n"), 1.0), s=4.0, n=2.0) == 1e-8


def test_strict_bounds_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, float("nan")), (5, None)], "loc_id int, chi_sqr double")
    assert [r.loc_id for r in filters.quality(df, chi=2.0).collect()] == [1]


def test_polygons_by_expression_and_by_table(spark):
    points = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0))
    df = spark.createDataFrame([(x / 4 + 0.03, y / 4 + 0.02) for x in range(20) for y in range(20)], ["xc", "yc"])
    few = regions.picked(df, [regions.Polygon(points)]).count()
    many = regions.picked(df, [regions.Polygon(points)] * (regions.INLINE_PICKS + 1))
    assert few > 50 and many.where("group = 7").count() == few
    assert regions.picked(df, [regions.Polygon(points[:-1])]).count() == 0
    assert regions.picked(df, []).count() == 0
    xs, ys = regions.Rectangle(1.0, 1.0, 3.0, 3.0, 1.0).corners()
    assert filters.in_rectangle(df, xs, ys).count() == regions.picked(df, [regions.Rectangle(1.0, 1.0, 3.0, 3.0, 1.0)]).count() > 0


def test_grid_join_meets_all_pairs(spark):
    import random

    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(150)]
    df = spark.createDataFrame(pts, "loc_id long, xc double, yc double")
    got = {(r.loc_id, r.r_loc_id) for r in regions.near_pairs(df, df, 0.7).collect()}
    assert got == {(a, b) for a, x, y in pts for b, u, v in pts if math.hypot(x - u, y - v) <= 0.7}


def test_camera_gain(spark):
    rows = [(0, 0, 3.0, 1.0), (0, 0, 6.0, 2.0), (0, 1, 1.0, 0.0)]
    got = {r.x: r.gain for r in aggregate.camera_gain(spark.createDataFrame(rows, "y int, x int, A double, B double")).collect()}
    assert got[0] == pytest.approx(3.0, rel=1e-12) and math.isnan(got[1])


def test_relative_efficiency_repeats_edges(spark):
    import numpy as np

    image = np.random.default_rng(0).random((5, 6)) + 1
    df = spark.createDataFrame([(y, x, float(image[y, x])) for y in range(5) for x in range(6)], "y int, x int, v double")
    wide = np.pad(image, 1, mode="edge")
    want = image / np.array([[wide[y : y + 3, x : x + 3].mean() for x in range(6)] for y in range(5)])
    for r in aggregate.relative_efficiency(df, "v", 3).collect():
        assert r.rqe == pytest.approx(want[r.y, r.x])


def test_schema():
    assert localisation_schema()["frame"].dataType.typeName() == "integer"
    assert len(localisation_columns()) == 22 and localisation_columns(True)[-1] == "theta_err"


@pytest.mark.parametrize("most", [50, 10**6])
def test_percentiles_by_narrowing_are_exact(spark, most):
    import random

    rnd = random.Random(0)
    for values in ([rnd.gauss(0, 1) for _ in range(2001)], [float(rnd.randrange(5)) for _ in range(3000)], [1.0], [2.0, 5.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 0.93, 1.0):
            place, v = q * (len(values) - 1), sorted(values)
            want = v[math.floor(place)] + (place - math.floor(place)) * (v[math.ceil(place)] - v[math.floor(place)])
            assert aggregate.exact_percentile(df, "v", q, most) == pytest.approx(want, abs=1e-9)
    assert aggregate.exact_percentile(df.limit(0), "v") is None
