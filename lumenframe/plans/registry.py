"""Registered queries, each with its SQL twin where SQL can express it.

Doubles are rounded to six places on both sides, so the order of a sum
doesn't show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import exprs, numeric
from lumenframe.operators import aggregate, cluster, drift, filters, fitting, image, linking, mixture, regions, render, sequence, simulate, spectral
from lumenframe.plans.locs import FOV_SIZE, locs, table, with_locs
from lumenframe.runtime import shared_folder
from lumenframe.sources import tables, tiff
from lumenframe.streaming import link as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, over_locs: bool = True):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            # a twin that begins with WITH goes on with the list that defines locs
            more = sql.strip()
            ORACLE_SQL[name] = with_locs(", " + more[4:] if more.startswith("WITH") else more) if over_locs else sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expression: str, name: str | None = None) -> str:
    out = f"(round({expression}, 6) + 0.0)"
    return f"{out} AS {name}" if name else out


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


WM = "sum({c} / ({c}_err * {c}_err)) / sum(1 / ({c}_err * {c}_err))"
PHOTONS = "(A_B + A_G + A_R)"


# scalar expressions


@query("photon_columns", f"""
SELECT loc_id, {r(PHOTONS, 'photons')}, {r('bg_B + bg_G + bg_R', 'background_photons')}, {r(f'A_R / {PHOTONS}', 'A_R')}, {r(f'A_G / {PHOTONS}', 'A_G')},
  {r(f'A_B / {PHOTONS}', 'A_B')}, {r(f'A_R_err / {PHOTONS}', 'A_R_err')}, {r('bg_R / (bg_B + bg_G + bg_R)', 'bg_R')} FROM locs""")
def _(spark, d):
    return exprs.photon_columns(locs(spark, d), normalise=True).select("loc_id", "photons", "background_photons", "A_R", "A_G", "A_B", "A_R_err", "bg_R")


#: No multiple of it is half a unit of the sixth place.
PIXEL_NM = 141.4213562373095


@query("unit_conversion", f"""
SELECT loc_id, {r(f'xc * {PIXEL_NM} + 5', 'x_nm')}, {r(f'(xc * {PIXEL_NM} - 5) / {PIXEL_NM}', 'x_px')}, {r('xc * 0.6 + yc * -0.8 + pi()', 'x_map')}, {r('xc * 0.8 + yc * 0.6 + pi()', 'y_map')},
  {r('2 * sqrt(2 * ln(2)) * s_x', 'fwhm')}, {r('(500 + s_x) / (2 * 1.4)', 'limit_nm')}, {r('(500 + s_x) / (sqrt(2) * pi() * 1.4)', 'sigma_nm')} FROM locs""")
def _(spark, d):
    t, x = locs(spark, d), F.col("xc")
    u, v = exprs.linear_map(x, F.col("yc"), ((0.6, -0.8), (0.8, 0.6)), (math.pi, math.pi))
    wavelength = 500 + F.col("s_x")
    return t.select("loc_id", exprs.to_nm(x, PIXEL_NM, 5.0).alias("x_nm"), exprs.to_pixels(x * PIXEL_NM, PIXEL_NM, 5.0).alias("x_px"), u.alias("x_map"), v.alias("y_map"), exprs.fwhm(F.col("s_x")).alias("fwhm"), exprs.diffraction_limit(wavelength, 1.4).alias("limit_nm"), exprs.sigma_psf(wavelength, 1.4).alias("sigma_nm"))


@query("colour_errors", f"""
, t AS (SELECT loc_id, A_R, A_G, A_B, A_R_err, {PHOTONS} AS p, bg_B + bg_G + bg_R AS b, sqrt(A_R_err * A_R_err + A_G_err * A_G_err + A_B_err * A_B_err) AS e FROM locs),
s AS (SELECT *, A_R / p * p / sqrt(A_R / p * p + b / 3.0) AS snr FROM t)
SELECT loc_id, {r('A_R / p', 'share')}, {r('A_R / p * sqrt((A_R_err / A_R) * (A_R_err / A_R) + (e / p) * (e / p))', 'share_err')}, {rs('snr')},
  CAST(CASE WHEN snr < 2 THEN 3.0 WHEN snr < 5 THEN 2.0 WHEN snr < 10 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS inflation FROM s""")
def _(spark, d):
    t = exprs.photon_columns(locs(spark, d))
    names = ("A_R", "A_G", "A_B")
    shares, errors = exprs.unit_sum([F.col(c) for c in names], [F.col(f"{c}_err") for c in names])
    snr = exprs.channel_snr(shares[0], F.col("photons"), F.col("background_photons"))
    return t.select("loc_id", shares[0].alias("share"), errors[0].alias("share_err"), snr.alias("snr"), exprs.error_inflation(snr).alias("inflation"))


@query("roi_bounds", """
WITH b AS (SELECT loc_id, greatest(CAST(floor(xc) AS BIGINT) - 12, 0) AS x0, greatest(CAST(floor(yc) AS BIGINT) - 12, 0) AS y0,
  least(CAST(floor(xc) AS BIGINT) + 13, 256) AS x1, least(CAST(floor(yc) AS BIGINT) + 13, 256) AS y1 FROM locs)
SELECT loc_id, x0, y0, x1, y1 FROM b WHERE x1 - x0 = y1 - y0 AND x1 - x0 >= 4""")
def _(spark, d):
    b = exprs.roi_bounds(F.col("xc"), F.col("yc"), 25, 256, 256)
    out = locs(spark, d).select("loc_id", b.alias("b")).where("b IS NOT NULL")
    return out.select("loc_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("fov_name_from_url", r"""
SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '(\.(h5|hdf5|tif|tiff|ome|txt|csv|json))+$', '', 'i') AS fov_name FROM pages""", over_locs=False)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", exprs.fov_name(F.col("url")).alias("fov_name"))


@query("elapsed_time", f"""
SELECT event_id, {r('CASE WHEN value * 20 < 60 THEN value * 20 WHEN value * 20 < 3600 THEN value * 20 / 60 ELSE value * 20 / 3600 END', 'value')},
  CASE WHEN value * 20 < 60 THEN 'seconds' WHEN value * 20 < 3600 THEN 'minutes' ELSE 'hours' END AS unit FROM events""", over_locs=False)
def _(spark, d):
    return table(spark, d, "events").select("event_id", exprs.elapsed(F.col("value") * 20).alias("e")).select("event_id", "e.value", "e.unit")


@query("rectangle_corners", f"""
WITH t AS (SELECT loc_id, xc AS x0, yc AS y0, xc + 3 AS x1, yc + s_x AS y1, atan2(s_x, 3) AS a FROM locs)
SELECT loc_id, {r('x0 - sin(a) * 2', 'cx0')}, {r('x0 + sin(a) * 2', 'cx1')}, {r('y1 - cos(a) * 2', 'cy2')}, {r('y1 + cos(a) * 2', 'cy3')} FROM t""")
def _(spark, d):
    xs, ys = exprs.rectangle_corners(F.col("xc"), F.col("yc"), F.col("xc") + 3, F.col("yc") + F.col("s_x"), 4.0)
    return locs(spark, d).select("loc_id", xs[0].alias("cx0"), xs[1].alias("cx1"), ys[2].alias("cy2"), ys[3].alias("cy3"))


@query("boundary_conditions", f"""
SELECT loc_id, {r('(xc - 100) - floor((xc - 100) / 64) * 64', 'periodic')},
  {r('least(greatest(CASE WHEN xc - 100 < 0 THEN 100 - xc WHEN xc - 100 > 64 THEN 228 - xc ELSE xc - 100 END, 0), 64)', 'reflective')}, {r('xc - 100', 'absorbing')} FROM locs""")
def _(spark, d):
    x = F.col("xc") - 100
    return locs(spark, d).select("loc_id", *[exprs.wrap(x, 64.0, m).alias(m) for m in ("periodic", "reflective", "absorbing")])


# filters


@query("physical_filter", "SELECT loc_id FROM locs WHERE xc > 0 AND xc < 200 AND yc > 0 AND yc < 200 AND s_x > 0 AND s_x < 3 AND s_y > 0 AND s_y < 3 AND A_R > 0 AND A_G > 0 AND A_B > 0 AND bg_R > 0 AND bg_G > 0 AND bg_B > 0")
def _(spark, d):
    return filters.physical(locs(spark, d), 200.0, 200.0).select("loc_id")


BOUNDS = {"position_error": 0.1, "colour_error": 0.2, "sigma": (1.0, 1.9), "sigma_error": 0.3}
QUALITY = """xc_err < 0.1 AND yc_err < 0.1 AND A_R_err < 0.2 AND A_G_err < 0.2 AND A_B_err < 0.2 AND bg_R_err < 0.2 AND bg_G_err < 0.2 AND bg_B_err < 0.2
  AND s_x > 1 AND s_x < 1.9 AND s_y > 1 AND s_y < 1.9 AND s_x_err < 0.3 AND s_y_err < 0.3"""


@query("quality_filter_median", f"SELECT loc_id FROM locs WHERE chi_sqr < (SELECT quantile_cont(chi_sqr, 0.5) FROM locs) AND {QUALITY}")
def _(spark, d):
    return filters.quality(locs(spark, d), **BOUNDS).select("loc_id")


@query("quality_filter_fixed", f"SELECT loc_id FROM locs WHERE chi_sqr < 60 AND {QUALITY}")
def _(spark, d):
    return filters.quality(locs(spark, d), chi=60.0, **BOUNDS).select("loc_id")


@query("density_fiducial_filter", """
WITH a AS (SELECT molecular_index % 50 AS aggregate_id, count(*) AS n_locs, avg(A_R) AS A_R FROM locs GROUP BY 1)
SELECT l.loc_id FROM locs l JOIN a ON l.molecular_index % 50 = a.aggregate_id WHERE NOT (n_locs / 500.0 >= 0.41 OR a.A_R > 51)""")
def _(spark, d):
    t = locs(spark, d).withColumn("aggregate_id", F.col("molecular_index") % 50)
    stats = t.groupBy("aggregate_id").agg(F.count("*").alias("n_locs"), F.avg("A_R").alias("A_R"))
    return filters.remove_fiducials(t, stats, 500, density=0.41, above={"A_R": 51.0}).select("loc_id")


@query("minimum_rows_guard", "SELECT loc_id FROM locs WHERE (SELECT count(*) FROM locs) >= 100")
def _(spark, d):
    return filters.enough(locs(spark, d), 100).select("loc_id")


# region joins

CIRCLES = [(50.0, 50.0, 30.0), (70.0, 60.0, 25.0), (200.0, 120.0, 40.0)]


@query("pick_circle", """
WITH p AS (SELECT * FROM (VALUES (0, 50.0, 50.0, 30.0), (1, 70.0, 60.0, 25.0), (2, 200.0, 120.0, 40.0)) AS v(g, x, y, rad))
SELECT loc_id, g AS "group" FROM locs JOIN p ON (xc - x) * (xc - x) + (yc - y) * (yc - y) < rad * rad""")
def _(spark, d):
    return regions.picked(locs(spark, d), [regions.Circle(*c) for c in CIRCLES]).select("loc_id", "group")


@query("pick_many_circles", """
WITH p AS (SELECT i AS g, CAST(i * 37 % 250 AS DOUBLE) AS x, CAST(i * 91 % 250 AS DOUBLE) AS y, CAST(6 + i % 5 AS DOUBLE) AS rad FROM range(200) AS v(i))
SELECT loc_id, CAST(g AS INT) AS "group" FROM locs JOIN p ON (xc - x) * (xc - x) + (yc - y) * (yc - y) < rad * rad""")
def _(spark, d):
    return regions.picked(locs(spark, d), [regions.Circle(float(i * 37 % 250), float(i * 91 % 250), float(6 + i % 5)) for i in range(200)]).select("loc_id", "group")


POLY = ((20.0, 20.0), (180.0, 40.0), (150.0, 200.0), (90.0, 90.0), (30.0, 160.0), (20.0, 20.0))


def _poly_sql(points) -> str:
    xs, ys = zip(*points[:-1])
    terms = []
    for i in range(len(xs)):
        xi, yi, xj, yj = xs[i], ys[i], xs[i - 1], ys[i - 1]
        if yi != yj:
            terms.append(f"CASE WHEN yc >= {min(yi, yj)} AND yc < {max(yi, yj)} AND xc < CAST({xj} - {xi} AS DOUBLE) * (yc - {yi}) / CAST({yj} - {yi} AS DOUBLE) + {xi} THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query("pick_polygon", f'SELECT loc_id, 0 AS "group" FROM locs WHERE {_poly_sql(POLY)}')
def _(spark, d):
    return regions.picked(locs(spark, d), [regions.Polygon(POLY)]).select("loc_id", "group")


RECT = regions.Rectangle(40.0, 40.0, 180.0, 120.0, 30.0)


@query("pick_rectangle", f'SELECT loc_id, 0 AS "group", {r("(xc - 110) * cos(pi() / 2 - atan2(80, 140)) - (yc - 80) * sin(pi() / 2 - atan2(80, 140))", "x_pick_rot")} FROM locs WHERE {_poly_sql([*zip(*RECT.corners()), None])}')
def _(spark, d):
    return regions.picked(locs(spark, d), [RECT]).select("loc_id", "group", "x_pick_rot")


@query("group_left_join", """
WITH p AS (SELECT * FROM (VALUES (0, 50.0, 50.0, 30.0), (1, 70.0, 60.0, 25.0), (2, 200.0, 120.0, 40.0)) AS v(g, x, y, rad)),
m AS (SELECT loc_id, min(g) AS g FROM locs JOIN p ON (xc - x) * (xc - x) + (yc - y) * (yc - y) < rad * rad GROUP BY loc_id)
SELECT loc_id, coalesce(g, -1) AS "group" FROM locs LEFT JOIN m USING (loc_id)""")
def _(spark, d):
    t = locs(spark, d)
    return regions.with_group(t, regions.picked(t, [regions.Circle(*c) for c in CIRCLES])).select("loc_id", "group")


@query("nena_histogram", """
WITH d AS (SELECT sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) AS distance FROM locs a JOIN locs b ON a.fov_index = b.fov_index AND b.frame = a.frame + 1)
SELECT CAST(floor(distance / 0.01) AS BIGINT) AS bin, count(*) AS n FROM d WHERE distance <= 1 AND floor(distance / 0.01) < 100 GROUP BY 1""")
def _(spark, d):
    return regions.next_frame_histogram(locs(spark, d), 1.0, 0.01, ("fov_index",))


@query("exemplar_pairs", f"""
WITH t AS (SELECT loc_id, fov_index, frame, xc, yc, A_R / {PHOTONS} AS f, A_G / {PHOTONS} AS g, {PHOTONS} AS p FROM locs),
a AS (SELECT * FROM t WHERE sqrt((f - 0.25) * (f - 0.25) + (g - 0.3) * (g - 0.3)) < 0.2 AND p >= 60),
b AS (SELECT * FROM t WHERE sqrt((f - 0.4) * (f - 0.4) + (g - 0.35) * (g - 0.35)) < 0.2 AND p >= 60),
d AS (SELECT a.loc_id, b.loc_id AS r_loc_id, sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) AS distance FROM a JOIN b ON a.fov_index = b.fov_index AND a.frame = b.frame AND a.loc_id <> b.loc_id)
SELECT loc_id, r_loc_id, {rs('distance')} FROM d WHERE distance >= 2 AND distance <= 40 ORDER BY d.distance, loc_id, r_loc_id LIMIT 50""")
def _(spark, d):
    t = exprs.photon_columns(locs(spark, d), normalise=True)
    return regions.exemplar_pairs(t, (0.25, 0.3), (0.4, 0.35), 0.2, 2.0, 40.0, 60.0, 50).select("loc_id", "r_loc_id", "distance")


@query("puncta_anti_join", "SELECT loc_id FROM locs WHERE NOT EXISTS (SELECT 1 FROM locs g WHERE g.A_R > 60 AND g.frame = locs.frame AND g.xc = locs.xc AND g.yc = locs.yc)")
def _(spark, d):
    t = locs(spark, d)
    return regions.without_rows(t, t.where("A_R > 60")).select("loc_id")


@query("neighbour_counts", """
SELECT a.loc_id, count(*) AS n FROM locs a JOIN locs b ON a.fov_index = b.fov_index AND sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) <= 0.2 GROUP BY a.loc_id""")
def _(spark, d):
    t = locs(spark, d).select("loc_id", "fov_index", "xc", "yc")
    return regions.near_pairs(t, t, 0.2, on=("fov_index",)).groupBy("loc_id").agg(F.count("*").alias("n"))


@query("nearest_centre", f"""
WITH c AS (SELECT molecular_index AS centre_id, fov_index, avg(xc) AS x, avg(yc) AS y FROM locs GROUP BY ALL),
n AS (SELECT loc_id, arg_min(centre_id, (d, centre_id)) AS centre_id, min(d) AS distance FROM (
  SELECT l.loc_id, centre_id, sqrt((l.xc - c.x) * (l.xc - c.x) + (l.yc - c.y) * (l.yc - c.y)) AS d FROM locs l JOIN c ON l.fov_index = c.fov_index) WHERE d <= 5 GROUP BY loc_id)
SELECT loc_id, centre_id, {rs('distance')} FROM locs LEFT JOIN n USING (loc_id)""")
def _(spark, d):
    t = locs(spark, d)
    centres = t.groupBy(F.col("molecular_index").alias("centre_id"), "fov_index").agg(F.avg("xc").alias("xc"), F.avg("yc").alias("yc"))
    return regions.nearest_centre(t, centres, 5.0, ("fov_index",)).select("loc_id", "centre_id", "distance")


@query("joint_edges", f"""
WITH m AS (SELECT quantile_cont(xc_err, 0.5) AS e FROM locs),
p AS (SELECT a.loc_id AS a, b.loc_id AS b, (a.xc - b.xc) * (a.xc - b.xc) / (a.xc_err * a.xc_err + b.xc_err * b.xc_err) + (a.yc - b.yc) * (a.yc - b.yc) / (a.yc_err * a.yc_err + b.yc_err * b.yc_err) AS q
  FROM locs a JOIN locs b ON a.fov_index = b.fov_index AND a.loc_id < b.loc_id, m WHERE sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) <= 2 * sqrt(2) * e)
SELECT a, b, {rs('q')} FROM p WHERE q < 4""")
def _(spark, d):
    t = locs(spark, d).select("loc_id", "fov_index", "xc", "yc", "xc_err", "yc_err")
    e = t.agg(F.percentile("xc_err", F.lit(0.5))).first()[0]
    pairs = regions.near_pairs(t, t, 2 * math.sqrt(2) * e, on=("fov_index",)).where("loc_id < r_loc_id")
    q = sum(((F.col(c) - F.col(f"r_{c}")) ** 2 / (F.col(f"{c}_err") ** 2 + F.col(f"r_{c}_err") ** 2) for c in ("xc", "yc")), F.lit(0.0))
    return pairs.select(F.col("loc_id").alias("a"), F.col("r_loc_id").alias("b"), q.alias("q")).where("q < 4")


# aggregations


@query("molecule_average", f"""
SELECT molecular_index, count(*) AS frames, {r(WM.format(c='A_R'), 'A_R')}, {r(f'sum({PHOTONS})', 'photons')}, {r('avg(xc)', 'xc')}, {r('avg(chi_sqr)', 'chi_sqr')}
FROM locs WHERE chi_sqr < (SELECT quantile_cont(chi_sqr, 0.5) FROM locs) AND {QUALITY} GROUP BY molecular_index""")
def _(spark, d):
    t = filters.quality(exprs.photon_columns(locs(spark, d)), **BOUNDS)
    return aggregate.molecules(t).select("molecular_index", "frames", "A_R", "photons", "xc", "chi_sqr")


@query("linked_events", f"""
WITH m AS (SELECT quantile_cont(xc_err, 0.5) FILTER (xc_err > 0) AS ex FROM locs),
g AS (SELECT fov_index, molecular_index, min(frame) AS frame, max(frame) AS last_frame, count(*) AS n, {WM.format(c='xc')} AS xc, {WM.format(c='A_G')} AS A_G, sum({PHOTONS}) AS photons, sum(bg_R) AS bg_R, avg(chi_sqr) AS chi_sqr FROM locs GROUP BY 1, 2)
SELECT fov_index, molecular_index, frame, last_frame, n, last_frame - frame + 1 AS len, {rs('xc', 'A_G', 'photons', 'bg_R', 'chi_sqr')}, {r('photons / n', 'photon_rate')} FROM g WHERE frame > 0 AND last_frame < 499""")
def _(spark, d):
    e = aggregate.linked_events(exprs.photon_columns(locs(spark, d)), 500, "molecular_index", keys=("fov_index",))
    return e.select("fov_index", "molecular_index", "frame", "last_frame", "n", "len", "xc", "A_G", "photons", "bg_R", "chi_sqr", "photon_rate")


@query("group_reductions", f"""
SELECT molecular_index, count(*) AS n, {r('sum(A_R)', 's')}, {r('sum(xc * A_G) / sum(A_G)', 'wm')}, {r('min(xc)', 'least')}, {r('max(xc)', 'most')}, {r('arg_max(yc, loc_id)', 'last')} FROM locs GROUP BY 1""")
def _(spark, d):
    t = locs(spark, d)
    g = "molecular_index"
    out = aggregate.group_count(t, g).withColumnRenamed("n_locs", "n").join(aggregate.group_sum(t, g, "A_R").withColumnRenamed("A_R", "s"), g)
    out = out.join(aggregate.group_weighted_mean(t, g, "xc", "A_G").select(g, F.col("xc").alias("wm")), g).join(aggregate.group_min_max(t, g, "xc"), g)
    return out.join(aggregate.group_last(t, g, "yc").withColumnRenamed("yc", "last"), g)


@query("centre_of_mass", f"SELECT fov_index, {r('sum(xc * A_R) / sum(A_R)', 'xc')}, {r('sum(yc * A_R) / sum(A_R)', 'yc')} FROM locs GROUP BY 1")
def _(spark, d):
    return aggregate.centre_of_mass(locs(spark, d), "A_R", ("fov_index",))


@query("histogram_2d", """
SELECT CAST(least(floor(yc * 32 / 256), 31) AS BIGINT) AS iy, CAST(least(floor(xc * 32 / 256), 31) AS BIGINT) AS ix, round(sum(A_R), 6) + 0.0 AS n FROM locs WHERE xc BETWEEN 0 AND 256 AND yc BETWEEN 0 AND 256 GROUP BY 1, 2""")
def _(spark, d):
    return aggregate.histogram_2d(locs(spark, d), (0.0, 256.0, 32), (0.0, 256.0, 32), "A_R")


@query("histogram_density", f"""
WITH h AS (SELECT CAST(least(floor((chi_sqr - 0) * (50 / 500.0)), 49) AS BIGINT) AS bin, count(*) AS n FROM locs WHERE chi_sqr BETWEEN 0 AND 500 GROUP BY 1)
SELECT bin, n, {r('n / ((SELECT sum(n) FROM h) * 10.0)', 'density')} FROM h""")
def _(spark, d):
    return aggregate.histogram(locs(spark, d), "chi_sqr", 0.0, 500.0, 50, density=True)


@query("wavelength_grid_average", f"""
WITH o AS (SELECT min(xc) AS x, min(yc) AS y FROM locs),
c AS (SELECT *, CAST(floor((xc - x) / 16) AS BIGINT) AS cell_x, CAST(floor((yc - y) / 16) AS BIGINT) AS cell_y FROM locs, o)
SELECT cell_x, cell_y, count(*) AS n_locs, {r('sum(A_R / A_R_err) / sum(1 / A_R_err)', 'A_R')}, {r('1 / sqrt(sum(1 / (A_R_err * A_R_err)))', 'A_R_err')}, {r('sum(s_x / s_x_err) / sum(1 / s_x_err)', 's_x')}
FROM c GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(spark, d):
    return aggregate.cell_average(locs(spark, d), 16.0, ("A_R", "s_x"), 20).select("cell_x", "cell_y", "n_locs", "A_R", "A_R_err", "s_x")


@query("calibration_maps", f"""
WITH p AS (SELECT l_linenumber AS y, l_suppkey AS x, l_quantity AS value, l_extendedprice AS b FROM lineitem)
SELECT y, x, {r('avg(value)', 'offset')}, {r('var_pop(value)', 'variance')}, {r('sum(value * b) / sum(b * b)', 'gain')} FROM p GROUP BY 1, 2""", over_locs=False)
def _(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("y"), F.col("l_suppkey").alias("x"), F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("B"))
    gain = aggregate.camera_gain(p.withColumnRenamed("value", "A"))
    return aggregate.pixel_moments(p).join(gain, ["y", "x"])


@query("channel_model", f"""
SELECT CAST(loc_id % 3 AS INT) AS channel, count(*) AS n, {r('avg(A_R)', 'mean_A_R')}, {r('covar_samp(A_R, A_R) + 1e-6', 'cov_A_R_A_R')}, {r('covar_samp(A_R, A_G)', 'cov_A_R_A_G')} FROM locs GROUP BY 1""")
def _(spark, d):
    t = locs(spark, d).withColumn("channel", (F.col("loc_id") % 3).cast("int"))
    return aggregate.channel_model(t, ("A_R", "A_G"), 5).select("channel", "n", "mean_A_R", "cov_A_R_A_R", "cov_A_R_A_G")


@query("fit_averages", f"""
SELECT frame % 20 AS bootstrap, {r(f'sum(xc * {PHOTONS}) / sum({PHOTONS})', 'xc')}, {r('avg(s_x)', 's_x')}, {r(f'sum(A_R) / sum({PHOTONS})', 'A_R')} FROM locs GROUP BY 1""")
def _(spark, d):
    return aggregate.fit_average(locs(spark, d).withColumn("bootstrap", F.col("frame") % 20)).select("bootstrap", "xc", "s_x", "A_R")


@query("colour_fit_average", f"SELECT loc_id, {r(f'A_R / {PHOTONS}', 'A_R')}, {r('avg(chi_sqr) OVER (PARTITION BY frame % 20)', 'chi_sqr')} FROM locs")
def _(spark, d):
    return aggregate.colour_fit_average(locs(spark, d).withColumn("bootstrap", F.col("frame") % 20)).select("loc_id", "A_R", "chi_sqr")


@query("fit_statistics", f"SELECT fov_index, {r('sqrt(avg((xc - 128) * (xc - 128)))', 'xc_error')}, {r('avg(abs(s_x - 1.3))', 's_x_error')}, {r('stddev_pop(s_x)', 's_x_std')} FROM locs GROUP BY 1")
def _(spark, d):
    return aggregate.fit_statistics(locs(spark, d), {"xc": 128.0, "s_x": 1.3}, ("fov_index",)).select("fov_index", "xc_error", "s_x_error", "s_x_std")


@query("region_statistics", f"""
SELECT molecular_index AS "group", count(*) AS n, {r('avg(xc)', 'x_mean')}, {r('stddev_pop(yc)', 'y_std')}, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS n_frames FROM locs GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, d):
    return aggregate.region_statistics(locs(spark, d).withColumnRenamed("molecular_index", "group"), least=10).select("group", "n", "x_mean", "y_std", "first_frame", "last_frame", "n_frames")


@query("frc_ring_sum", f"""
SELECT CAST(round_even(sqrt((floor(yc) - 128) * (floor(yc) - 128) + (floor(xc) - 128) * (floor(xc) - 128)), 0) AS INT) AS r, {r('sum(A_R)', 'sum')}, count(*) AS n FROM locs GROUP BY 1""")
def _(spark, d):
    p = locs(spark, d).select(F.floor("yc").alias("y"), F.floor("xc").alias("x"), F.col("A_R").alias("value"))
    return aggregate.radial_sum(p, 256, 256)


@query("molecule_summary", f"SELECT molecular_index, count(*) AS n, {r('avg(xc)', 'xc')}, {r('avg(yc)', 'yc')}, min(frame) AS first_frame, max(frame) AS last_frame, arg_min(fov_index, loc_id) AS fov_index FROM locs GROUP BY 1")
def _(spark, d):
    return aggregate.molecule_summary(locs(spark, d))


@query("level_quantiles", f"""
SELECT event_type, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('quantile_cont(value, 0.99)', 'p99')}, count(*) AS n FROM events GROUP BY 1""", over_locs=False)
def _(spark, d):
    return aggregate.level_statistics(table(spark, d, "events"), "event_type", "value")


@query("tail_fraction", f"SELECT event_type, {r('avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END)', 'fraction')} FROM events GROUP BY 1", over_locs=False)
def _(spark, d):
    return aggregate.tail_fraction(table(spark, d, "events"), "event_type", "value", 100.0)


@query("quantile_bins", """
WITH e AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)
SELECT event_id, CAST((CASE WHEN q[1] < value THEN 1 ELSE 0 END) + (CASE WHEN q[2] < value THEN 1 ELSE 0 END) + (CASE WHEN q[3] < value THEN 1 ELSE 0 END) AS INT) AS quantile_bin FROM events, e""", over_locs=False)
def _(spark, d):
    return aggregate.quantile_bins(table(spark, d, "events"), "value", 4).select("event_id", "quantile_bin")


@query("best_parameter", f"""
SELECT l_returnflag, l_linestatus, arg_min(l_linenumber, (l_discount, l_linenumber)) AS l_linenumber, {r('min(l_discount)', 'l_discount')} FROM lineitem GROUP BY 1, 2""", over_locs=False)
def _(spark, d):
    return aggregate.best_parameter(table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus"), "l_linenumber", "l_discount")


@query("pivot_channels", f"""
SELECT fov_index, {r("avg(CASE WHEN loc_id % 3 = 0 THEN chi_sqr END)", 'c0')}, {r("avg(CASE WHEN loc_id % 3 = 1 THEN chi_sqr END)", 'c1')}, {r("avg(CASE WHEN loc_id % 3 = 2 THEN chi_sqr END)", 'c2')} FROM locs GROUP BY 1""")
def _(spark, d):
    t = locs(spark, d).withColumn("c", F.concat(F.lit("c"), (F.col("loc_id") % 3).cast("string")))
    return t.groupBy("fov_index").pivot("c", ["c0", "c1", "c2"]).agg(F.avg("chi_sqr"))


@query("rows_per_cluster_frame", "SELECT molecular_index, frame, count(*) AS n FROM locs GROUP BY 1, 2")
def _(spark, d):
    return locs(spark, d).groupBy("molecular_index", "frame").agg(F.count("*").alias("n"))


@query("track_statistics", f"SELECT fov_index, molecular_index, count(*) AS n, {r('stddev_samp(A_R)', 'colour_std')} FROM locs GROUP BY 1, 2 HAVING stddev_samp(A_R) IS NOT NULL")
def _(spark, d):
    return linking.track_statistics(locs(spark, d), "molecular_index")


@query("semi_join_reference", f"SELECT loc_id FROM locs WHERE molecular_index IN (SELECT molecular_index FROM locs GROUP BY 1 HAVING sum({PHOTONS}) BETWEEN 1500 AND 1700)")
def _(spark, d):
    t = exprs.photon_columns(locs(spark, d))
    chosen = t.groupBy("molecular_index").agg(F.sum("photons").alias("p")).where("p BETWEEN 1500 AND 1700")
    return t.join(chosen, "molecular_index", "left_semi").select("loc_id")


@query("rollup_channels", "SELECT fov_index, CAST(loc_id % 3 AS INT) AS channel, count(*) AS n FROM locs GROUP BY ROLLUP (fov_index, CAST(loc_id % 3 AS INT))")
def _(spark, d):
    return locs(spark, d).withColumn("channel", (F.col("loc_id") % 3).cast("int")).rollup("fov_index", "channel").agg(F.count("*").alias("n"))


# sequences


@query("photon_accumulation", f"""
SELECT molecular_index, loc_id, CAST(row_number() OVER w AS INT) AS frames_accumulated, {r(f'sum({PHOTONS}) OVER w', 'photons_accumulated')},
  {r('sum(A_R / (A_R_err * A_R_err + 1e-12)) OVER w / sum(1 / (A_R_err * A_R_err + 1e-12)) OVER w', 'A_R')}, {r('1 / sqrt(sum(1 / (A_R_err * A_R_err + 1e-12)) OVER w)', 'A_R_err')},
  {r('avg(xc) OVER w', 'xc_mean')}, {r('stddev_pop(xc) OVER w', 'xc_std')}, {r('avg(s_x) OVER w', 's_x_mean')}
FROM locs WINDOW w AS (PARTITION BY molecular_index ORDER BY frame, loc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return sequence.photon_accumulation(exprs.photon_columns(locs(spark, d))).select("molecular_index", "loc_id", "frames_accumulated", "photons_accumulated", "A_R", "A_R_err", "xc_mean", "xc_std", "s_x_mean")


@query("multi_fov_global_index", "SELECT loc_id, dense_rank() OVER (ORDER BY fov_index, molecular_index % 97) - 1 AS molecular_index FROM locs")
def _(spark, d):
    return sequence.global_index(locs(spark, d).withColumn("molecular_index", F.col("molecular_index") % 97)).select("loc_id", F.col("molecular_index").cast("long").alias("molecular_index"))


@query("frame_offset_union", """
, s AS (SELECT fov_index, sum(max(frame) + 1) OVER (ORDER BY fov_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM locs GROUP BY fov_index)
SELECT loc_id, CAST(frame + coalesce(n, 0) AS INT) AS frame FROM locs JOIN s ON s.fov_index = locs.fov_index""")
def _(spark, d):
    return sequence.offset_fields(locs(spark, d).select("fov_index", "loc_id", "frame")).select("loc_id", "frame")


@query("segment_tumbling", "SELECT fov_index, CAST(floor(frame / 50.0) AS INT) AS segment, count(*) AS n FROM locs GROUP BY 1, 2")
def _(spark, d):
    return locs(spark, d).groupBy("fov_index", sequence.frame_segment(F.col("frame"), 50).alias("segment")).agg(F.count("*").alias("n"))


@query("segment_sliding", """
WITH s AS (SELECT loc_id, unnest(range(greatest(CAST(ceil((frame - 49) / 30.0) AS BIGINT), 0), CAST(floor(frame / 30.0) AS BIGINT) + 1)) AS segment FROM locs)
SELECT segment, count(*) AS n, min(loc_id) AS first_id FROM s GROUP BY 1""")
def _(spark, d):
    return sequence.sliding_segments(locs(spark, d), 50, 20).groupBy("segment").agg(F.count("*").alias("n"), F.min("loc_id").alias("first_id"))


@query("standard_frames", "SELECT loc_id, frame + 1 - min(frame) OVER (PARTITION BY fov_index) AS frame FROM locs WHERE frame > 3")
def _(spark, d):
    return sequence.standard_frames(locs(spark, d).where("frame > 3"), ("fov_index",)).select("loc_id", "frame")


GAPS = "SELECT fov_index, frame, CASE WHEN (frame * 7 + fov_index) % 5 < 2 THEN avg(xc) END AS v FROM locs GROUP BY fov_index, frame"


def _gaps(spark, d):
    return locs(spark, d).groupBy("fov_index", "frame").agg(F.avg("xc").alias("a")).select("fov_index", "frame", F.when((F.col("frame") * 7 + F.col("fov_index")) % 5 < 2, F.col("a")).alias("v"))


@query("gap_fill_linear", f"""
, g AS ({GAPS}),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0, last_value(v IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1, first_value(v IGNORE NULLS) OVER a AS v1 FROM g
  WINDOW b AS (PARTITION BY fov_index ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY fov_index ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT fov_index, frame, {r('coalesce(CASE WHEN f0 = f1 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / CAST(f1 - f0 AS DOUBLE) END, v0, v1, 0)', 'v')} FROM n""")
def _(spark, d):
    return sequence.fill_linear(_gaps(spark, d), "frame", "v", ("fov_index",))


@query("interpolate_next_known", f"""
, g AS ({GAPS})
SELECT fov_index, frame, {r('coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY fov_index ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY fov_index ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 'v')} FROM g""")
def _(spark, d):
    g = _gaps(spark, d)
    return sequence.interpolate(g.where("v IS NOT NULL"), g, "frame", "v", "nearest", ("fov_index",)).select("fov_index", "frame", "v")


SERIES = "SELECT user_id AS trace, event_id AS t, CAST(floor(value) AS DOUBLE) AS value FROM events"


def _series(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("t"), F.floor("value").cast("double").alias("value"))


@query("lr_scan_poisson", f"""
WITH s AS ({SERIES}),
c AS (SELECT trace, row_number() OVER w AS k, sum(value) OVER w AS s, count(*) OVER p AS n, sum(value) OVER p AS total FROM s WINDOW w AS (PARTITION BY trace ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY trace)),
l AS (SELECT trace, k, 2 * ((CASE WHEN s > 0 THEN s * ln(s / k) ELSE 0 END) + (CASE WHEN total - s > 0 THEN (total - s) * ln((total - s) / (n - k)) ELSE 0 END) - (CASE WHEN total > 0 THEN total * ln(total / n) ELSE 0 END)) AS score FROM c WHERE k < n)
SELECT trace, arg_max(k, (round(score, 9), -k)) AS split, {r('max(score)', 'score')} FROM l GROUP BY trace""", over_locs=False)
def _(spark, d):
    return sequence.poisson_split(_series(spark, d))


@query("lr_scan_gaussian", f"""
WITH s AS ({SERIES}),
c AS (SELECT trace, row_number() OVER w AS k, sum(value) OVER w AS s, sum(value * value) OVER w AS q, count(*) OVER p AS n, sum(value) OVER p AS ts, sum(value * value) OVER p AS tq FROM s WINDOW w AS (PARTITION BY trace ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY trace)),
l AS (SELECT trace, k, n * ln(greatest((tq - ts * ts / n) / (n - 1), 1e-12)) - k * ln(greatest((q - s * s / k) / (k - 1), 1e-12)) - (n - k) * ln(greatest((tq - q - (ts - s) * (ts - s) / (n - k)) / (n - k - 1), 1e-12)) AS score FROM c WHERE k >= 2 AND n - k >= 2)
SELECT trace, arg_max(k, (round(score, 9), -k)) AS split, {r('max(score)', 'score')} FROM l GROUP BY trace""", over_locs=False)
def _(spark, d):
    return sequence.gaussian_split(_series(spark, d))


@query("msd_by_lag", f"""
, o AS (SELECT user, row_number() OVER (PARTITION BY user ORDER BY loc_id) AS i, count(*) OVER (PARTITION BY user) AS n, xc, yc FROM (SELECT *, molecular_index % 40 AS user FROM locs))
SELECT a.user AS molecule, CAST(b.i - a.i AS INT) AS lag, {r('avg((b.xc - a.xc) * (b.xc - a.xc) + (b.yc - a.yc) * (b.yc - a.yc))', 'msd')}, count(*) AS n_pairs
FROM o a JOIN o b ON a.user = b.user AND b.i > a.i AND b.i - a.i <= 5 GROUP BY 1, 2""")
def _(spark, d):
    t = locs(spark, d).select((F.col("molecular_index") % 40).alias("molecule"), F.col("loc_id").alias("t"), F.col("xc").alias("x"), F.col("yc").alias("y"))
    return sequence.msd(t, max_lag=5)


@query("msd_slope", f"""
, o AS (SELECT user, row_number() OVER (PARTITION BY user ORDER BY loc_id) AS i, xc, yc FROM (SELECT *, molecular_index % 40 AS user FROM locs)),
m AS (SELECT a.user, b.i - a.i AS lag, avg((b.xc - a.xc) * (b.xc - a.xc) + (b.yc - a.yc) * (b.yc - a.yc)) AS msd FROM o a JOIN o b ON a.user = b.user AND b.i > a.i AND b.i - a.i <= 4 GROUP BY 1, 2)
SELECT user AS molecule, {r('regr_slope(msd, lag * 0.5) / 4', 'D')} FROM m GROUP BY 1""")
def _(spark, d):
    t = locs(spark, d).select((F.col("molecular_index") % 40).alias("molecule"), F.col("loc_id").alias("t"), F.col("xc").alias("x"), F.col("yc").alias("y"))
    return sequence.diffusion_from_msd(sequence.msd(t, max_lag=4), 0.5)


ACC = f"SELECT molecular_index, loc_id, row_number() OVER w AS k, sum({PHOTONS}) OVER w AS p FROM locs WINDOW w AS (PARTITION BY molecular_index ORDER BY frame, loc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("reference_argmax", f", a AS ({ACC}) SELECT molecular_index, arg_max(loc_id, (p, k)) AS loc_id, {r('max(p)', 'photons_accumulated')} FROM a WHERE p >= 1400 GROUP BY 1")
def _(spark, d):
    acc = sequence.photon_accumulation(exprs.photon_columns(locs(spark, d)))
    return sequence.reference_rows(acc, 1400.0).select("molecular_index", "loc_id", "photons_accumulated")


@query("photon_bin_first", f"""
, a AS ({ACC}), b AS (SELECT * FROM (VALUES (0, 0, 300), (1, 300, 700), (2, 700, 1200), (3, 1200, 2000)) AS v(photon_bin, low, high)),
m AS (SELECT molecular_index, photon_bin, loc_id, row_number() OVER (PARTITION BY molecular_index, photon_bin ORDER BY k) AS place FROM a JOIN b ON p >= low AND p < high)
SELECT molecular_index, photon_bin, loc_id FROM m WHERE place = 1""")
def _(spark, d):
    acc = sequence.photon_accumulation(exprs.photon_columns(locs(spark, d)))
    return sequence.photon_bins(acc, (0, 300, 700, 1200, 2000)).select("molecular_index", "photon_bin", "loc_id")


@query("histogram_peaks", """
WITH h AS (SELECT CAST(least(floor(value * (50 / 500.0)), 49) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1),
p AS (SELECT a.bin, a.n FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.bin BETWEEN a.bin - 4 AND a.bin + 4 AND (b.n > a.n OR (b.n = a.n AND b.bin < a.bin))))
SELECT bin, n FROM p ORDER BY n DESC, bin LIMIT 3""", over_locs=False)
def _(spark, d):
    return sequence.histogram_peaks(aggregate.histogram(table(spark, d, "events"), "value", 0.0, 500.0, 50), 3)


@query("fiducial_closest_90pct", """
, d AS (SELECT loc_id, molecular_index, sqrt((xc - avg(xc) OVER w) * (xc - avg(xc) OVER w) + (yc - avg(yc) OVER w) * (yc - avg(yc) OVER w)) AS distance, count(*) OVER w AS n FROM locs WINDOW w AS (PARTITION BY molecular_index)),
k AS (SELECT *, row_number() OVER (PARTITION BY molecular_index ORDER BY distance, loc_id) AS place FROM d)
SELECT loc_id FROM k WHERE place <= floor(n * 0.9) AND n >= 7""")
def _(spark, d):
    return sequence.closest_share(locs(spark, d).withColumnRenamed("molecular_index", "group"), share=0.9, least=7).select("loc_id")


@query("change_point_frames")
def _(spark, d):
    return sequence.frames_before_last_change(sequence.change_points(_series(spark, d), method="binary"))


@query("segment_means")
def _(spark, d):
    s = _series(spark, d)
    return sequence.segment_means(s, sequence.change_points(s, method="binary")).select("trace", "t", "segment", "segment_mean")


@query("diffusion_optimal_fit")
def _(spark, d):
    return sequence.diffusion_optimal(simulate.trajectories(spark, 50, 200, 0.5, 0.1, seed=3), 0.1)


@query("roi_traces", """
, p AS (SELECT molecular_index AS punctum, CAST(floor(avg(yc)) AS INT) AS y0, CAST(floor(avg(xc)) AS INT) AS x0 FROM locs GROUP BY 1)
SELECT punctum, frame, round(sum(A_R), 6) + 0.0 AS value FROM locs JOIN p ON CAST(floor(yc) AS INT) BETWEEN y0 - 2 AND y0 + 2 AND CAST(floor(xc) AS INT) BETWEEN x0 - 2 AND x0 + 2 GROUP BY 1, 2""")
def _(spark, d):
    t = locs(spark, d)
    # one row a pixel and frame, so a punctum meets a bounded number of them
    pixels = t.groupBy("frame", F.floor("yc").cast("int").alias("y"), F.floor("xc").cast("int").alias("x")).agg(F.sum("A_R").alias("value"))
    puncta = t.groupBy(F.col("molecular_index").alias("punctum")).agg(F.avg("yc").alias("yc"), F.avg("xc").alias("xc"))
    return sequence.roi_traces(pixels, puncta, 5)


# drift

DRIFT = "SELECT fov_index, frame, CAST(frame * 3 % 64 AS DOUBLE) / 64.0 AS dx, CAST(frame * 5 % 64 AS DOUBLE) / 64.0 AS dy FROM (SELECT DISTINCT fov_index, frame FROM locs WHERE frame BETWEEN 20 AND 450)"


@query("drift_apply", f"""
, d AS ({DRIFT})
SELECT loc_id, {r('xc - dx', 'xc')}, {r('yc - dy', 'yc')} FROM locs JOIN d ON d.fov_index = locs.fov_index AND d.frame = least(greatest(locs.frame, 20), (SELECT max(frame) FROM d e WHERE e.fov_index = locs.fov_index))""")
def _(spark, d):
    t = locs(spark, d)
    table_ = t.where("frame BETWEEN 20 AND 450").select("fov_index", "frame").distinct().withColumns({"dx": (F.col("frame") * 3 % 64) / 64.0, "dy": (F.col("frame") * 5 % 64) / 64.0})
    return drift.apply_drift(t, table_).select("loc_id", "xc", "yc")


FID = "(SELECT *, CAST(loc_id % 5 AS INT) AS g FROM locs)"


@query("fiducial_drift_weighted", f"""
, o AS (SELECT fov_index, g, frame, xc - avg(xc) OVER (PARTITION BY fov_index, g) AS dev FROM {FID}),
p AS (SELECT fov_index, frame, avg(dev) AS mean FROM o GROUP BY 1, 2),
e AS (SELECT o.fov_index, g, avg((dev - mean) * (dev - mean)) AS mse FROM o JOIN p ON o.fov_index = p.fov_index AND o.frame = p.frame GROUP BY 1, 2)
SELECT o.fov_index, o.frame, {r('sum(dev / greatest(mse, 1e-12)) / sum(1 / greatest(mse, 1e-12))', 'dx')} FROM o JOIN e ON o.fov_index = e.fov_index AND o.g = e.g GROUP BY 1, 2""")
def _(spark, d):
    t = locs(spark, d).withColumn("group", (F.col("loc_id") % 5).cast("int"))
    return drift.fiducial_drift(t).select("fov_index", "frame", "dx")


@query("fiducial_variance_filter", f"""
, s AS (SELECT fov_index, molecular_index AS "group", var_pop(xc) + var_pop(yc) AS variance FROM locs GROUP BY 1, 2),
m AS (SELECT fov_index, quantile_cont(variance, 0.5) AS mv, quantile_cont(sqrt(variance), 0.5) AS mr FROM s GROUP BY 1)
SELECT s.fov_index, "group", {rs('variance')} FROM s JOIN m ON s.fov_index = m.fov_index WHERE variance <= 1.1 * mv AND sqrt(variance) <= 1.05 * mr""")
def _(spark, d):
    return drift.good_fiducials(locs(spark, d).withColumnRenamed("molecular_index", "group"), 1.1, 1.05).select("fov_index", "group", "variance")


@query("fiducial_correction", f"""
, f AS (SELECT *, CAST(molecular_index % 4 AS INT) AS g FROM locs WHERE {PHOTONS} > 150),
dup AS (SELECT DISTINCT fov_index, g FROM (SELECT fov_index, g, frame FROM f GROUP BY ALL HAVING count(*) > 1)),
c AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM dup WHERE dup.fov_index = f.fov_index AND dup.g = f.g)),
m AS (SELECT fov_index, g, quantile_cont(xc, 0.5) AS mx FROM c GROUP BY 1, 2),
dr AS (SELECT c.fov_index, c.frame, sum((xc - mx) / (xc_err + 1e-10)) / sum(1 / (xc_err + 1e-10)) AS dx FROM c JOIN m ON c.fov_index = m.fov_index AND c.g = m.g GROUP BY 1, 2)
SELECT loc_id, {r(f'(xc - dx) * {PIXEL_NM}', 'x_nm')}, loc_id IN (SELECT loc_id FROM c) AS is_fiducial FROM locs JOIN dr ON locs.fov_index = dr.fov_index AND locs.frame = dr.frame""")
def _(spark, d):
    t = locs(spark, d)
    fid = t.where(F.col("A_B") + F.col("A_G") + F.col("A_R") > 150).withColumn("group", (F.col("molecular_index") % 4).cast("int"))
    return drift.correct_by_validated(t, fid).select("loc_id", exprs.to_nm(F.col("xc"), PIXEL_NM).alias("x_nm"), "is_fiducial")


@query("aim_shift_counts", """
, a AS (SELECT CAST(round_even(xc / 0.25, 0) AS BIGINT) AS x, CAST(round_even(yc / 0.25, 0) AS BIGINT) AS y, count(*) AS n0 FROM locs WHERE frame < 250 GROUP BY 1, 2),
b AS (SELECT CAST(round_even(xc / 0.25, 0) AS BIGINT) AS x, CAST(round_even(yc / 0.25, 0) AS BIGINT) AS y, count(*) AS n1 FROM locs WHERE frame >= 250 GROUP BY 1, 2),
s AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM range(-3, 4) AS u(i), range(-3, 4) AS v(j))
SELECT i AS shift_xc, j AS shift_yc, CAST(sum(least(n0, n1)) AS BIGINT) AS n FROM b, s, a WHERE a.x = b.x - i AND a.y = b.y - j GROUP BY 1, 2""")
def _(spark, d):
    t = locs(spark, d)
    return drift.shift_counts(t.where("frame < 250"), t.where("frame >= 250"), 0.25, 3)


@query("bag_intersection", """
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT CAST(sum(least(a.n, b.n)) AS BIGINT) AS n FROM a JOIN b USING (user_id, event_type)""", over_locs=False)
def _(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(F.col("event_id") % 2 == i).select("user_id", "event_type") for i in (0, 1))
    return a.intersectAll(b).agg(F.count("*").alias("n"))


# rendering

VIEW = (0.0, 0.0, FOV_SIZE, FOV_SIZE)


@query("render_histogram", "SELECT fov_index, CAST(floor(yc * 4) AS INT) AS py, CAST(floor(xc * 4) AS INT) AS px, count(*) AS value FROM locs WHERE xc > 0 AND xc < 256 AND yc > 0 AND yc < 256 GROUP BY 1, 2, 3")
def _(spark, d):
    return render.histogram(locs(spark, d), 4.0, VIEW, ("fov_index",))


SPLAT = f"""
, q AS (SELECT xc * 2 AS rx, yc * 2 AS ry, greatest(xc_err, 0.3) * 2 AS sx, greatest(yc_err, 0.3) * 2 AS sy, {PHOTONS} AS w, A_R AS c FROM locs WHERE xc > 0 AND xc < 256 AND yc > 0 AND yc < 256),
u AS (SELECT *, unnest(range(greatest(CAST(floor(ry - 3 * sy) AS BIGINT), 0), least(CAST(floor(ry + 3 * sy + 1) AS BIGINT), 512))) AS py FROM q),
v AS (SELECT *, unnest(range(greatest(CAST(floor(rx - 3 * sx) AS BIGINT), 0), least(CAST(floor(rx + 3 * sx + 1) AS BIGINT), 512))) AS px FROM u),
g AS (SELECT CAST(py AS INT) AS py, CAST(px AS INT) AS px, w, c, exp(-((rx - px - 0.5) * (rx - px - 0.5) / (2 * sx * sx) + (ry - py - 0.5) * (ry - py - 0.5) / (2 * sy * sy))) / (2 * pi() * sx * sy) AS g FROM v)"""


@query("render_gaussian", SPLAT + f" SELECT py, px, {r('sum(w * g)', 'value')} FROM g GROUP BY 1, 2")
def _(spark, d):
    return render.gaussian(exprs.photon_columns(locs(spark, d)), 2.0, VIEW, 0.3)


@query("render_gaussian_colour", SPLAT + f" SELECT py, px, {r('sum(w * g)', 'value')}, {r('sum(w * g * c) / sum(w * g)', 'colour')} FROM g GROUP BY 1, 2")
def _(spark, d):
    return render.gaussian_colour(exprs.photon_columns(locs(spark, d)), 2.0, VIEW, "A_R", 0.3).select("py", "px", "value", "colour")


@query("frc_binned", 'SELECT fov_index, CAST(least(floor((yc + 0.5) * 0.5), 127) AS INT) AS py, CAST(least(floor((xc + 0.5) * 0.5), 127) AS INT) AS px, count(*) AS value FROM locs WHERE (yc + 0.5) * 0.5 BETWEEN 0 AND 128 AND (xc + 0.5) * 0.5 BETWEEN 0 AND 128 GROUP BY 1, 2, 3')
def _(spark, d):
    return render.binned(locs(spark, d), 128, 128, 0.5, ("fov_index",))


@query("frc_block_split", "SELECT loc_id, CAST(least(greatest(ceil(frame / CAST(max(frame) OVER (PARTITION BY fov_index) AS DOUBLE) * 20), 1), 20) AS INT) AS block FROM locs")
def _(spark, d):
    return render.block_split(locs(spark, d), 20, keys=("fov_index",)).select("loc_id", "block")


@query("ternary_hexbin", f"""
, t AS (SELECT ((2 * A_G + A_B) / (2 * {PHOTONS})) / (1.0 / 20) AS u, (A_B * (sqrt(3) / 2) / {PHOTONS}) / (sqrt(3) / 20) AS v FROM locs),
h AS (SELECT u, v, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) + 0.5 AS i2, floor(v) + 0.5 AS j2 FROM t),
c AS (SELECT CASE WHEN (u - i1) * (u - i1) + 3 * ((v - j1) * (v - j1)) < (u - i2) * (u - i2) + 3 * ((v - j2) * (v - j2)) THEN i1 ELSE i2 END AS i, CASE WHEN (u - i1) * (u - i1) + 3 * ((v - j1) * (v - j1)) < (u - i2) * (u - i2) + 3 * ((v - j2) * (v - j2)) THEN j1 ELSE j2 END AS j FROM h)
SELECT {r('i * (1.0 / 20)', 'x')}, {r('j * (sqrt(3) / 20)', 'y')}, count(*) AS n FROM c GROUP BY i, j HAVING count(*) >= 2""")
def _(spark, d):
    return render.ternary_hexbin(locs(spark, d), 20, least=2)


@query("rasterise", "SELECT CAST(least(floor(yc / 256 * 100), 99) AS INT) AS py, CAST(least(floor(xc / 256 * 200), 199) AS INT) AS px, count(*) AS value FROM locs WHERE xc BETWEEN 0 AND 256 AND yc BETWEEN 0 AND 256 GROUP BY 1, 2")
def _(spark, d):
    return render.rasterise(locs(spark, d), "xc", "yc", VIEW, (100, 200))


@query("fire_resolution")
def _(spark, d):
    return render.fire_fields(locs(spark, d), 128, 0.5, reps=4, pixel_nm=130.0)


# mixtures

MODEL = mixture.Mixture(("A_R", "A_G"), np.array([0.4, 0.6]), np.array([[30.0, 70.0], [60.0, 40.0]]), np.array([[[200.0, 30.0], [30.0, 250.0]], [[300.0, -40.0], [-40.0, 150.0]]]))


def _log_density(w, m, c) -> str:
    inv = np.linalg.inv(c)
    norm = math.log(w) - 0.5 * (2 * math.log(2 * math.pi) + float(np.linalg.slogdet(c)[1]))
    a, b = f"(A_R - {m[0]})", f"(A_G - {m[1]})"
    return f"{norm!r} - 0.5 * ({a} * {a} * {inv[0, 0]!r} + {a} * {b} * {2 * inv[0, 1]!r} + {b} * {b} * {inv[1, 1]!r})".replace("np.float64(", "(")


_L = [_log_density(w, m, c) for w, m, c in zip(MODEL.weights, MODEL.means, MODEL.covariances)]


@query("posterior_assignment", f"""
, d AS (SELECT loc_id, {_L[0]} AS a, {_L[1]} AS b FROM locs), p AS (SELECT loc_id, 1 / (1 + exp(b - a)) AS p0 FROM d)
SELECT loc_id, CASE WHEN p0 >= 0.5 THEN 0 ELSE 1 END AS likely, {r('greatest(p0, 1 - p0)', 'confidence')} FROM p""")
def _(spark, d):
    return mixture.with_posteriors(locs(spark, d), MODEL).select("loc_id", "likely", "confidence")


@query("nearest_mean", "SELECT loc_id, CASE WHEN (A_R - 30) * (A_R - 30) + (A_G - 70) * (A_G - 70) <= (A_R - 60) * (A_R - 60) + (A_G - 40) * (A_G - 40) THEN 0 ELSE 1 END AS own FROM locs")
def _(spark, d):
    return locs(spark, d).select("loc_id", mixture.nearest_mean(("A_R", "A_G"), MODEL.means).alias("own"))


def _embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("loc_id"), F.col("embedding")[0].cast("double").alias("A_R"), F.col("embedding")[1].cast("double").alias("A_G"), F.lit(0.01).alias("A_R_err"), F.lit(0.01).alias("A_G_err"), F.lit(100.0).alias("photons"))


@query("gmm_unmix")
def _(spark, d):
    out, _model = mixture.unmix(_embeddings(spark, d), 2, confidence=0.8)
    return out.select("loc_id", "channel", "confidence")


@query("gmm_deconvolved")
def _(spark, d):
    out, _model = mixture.unmix(_embeddings(spark, d), 2, confidence=0.8, method="deconvolution")
    return out.select("loc_id", "channel")


@query("robust_covariance")
def _(spark, d):
    m = mixture.robust_covariances(locs(spark, d), ("A_R", "A_G"), MODEL.means)
    return spark.createDataFrame([(i, float(m.weights[i]), *[float(v) for v in m.covariances[i].ravel()]) for i in range(m.k)], "component int, weight double, c00 double, c01 double, c10 double, c11 double")


@query("sampled_confusion")
def _(spark, d):
    return mixture.sampled_confusion(spark, MODEL, 20_000)


# spectra

EMISSION = "SELECT p_brand AS dye_name, CAST(500 + p_size AS DOUBLE) AS wavelength_nm, sum(p_retailprice) AS emission_intensity FROM part GROUP BY 1, 2"


def _emission(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("dye_name"), (F.col("p_size") + 500).cast("double").alias("wavelength_nm")).agg(F.sum("p_retailprice").alias("emission_intensity"))


@query("spectra_channel_fractions", f"""
WITH e AS ({EMISSION}),
f AS (SELECT *, emission_intensity * (wavelength_nm - 480) / 100 AS i, (wavelength_nm - 495) / 60 AS R, 0.5 AS G, (560 - wavelength_nm) / 70 AS B FROM e),
s AS (SELECT dye_name, sum(i * R / (R + G + B)) AS R, sum(i * G / (R + G + B)) AS G, sum(i * B / (R + G + B)) AS B, sum(wavelength_nm * i) / sum(i) AS mean_wavelength FROM f GROUP BY 1)
SELECT dye_name, {r('R / (R + G + B)', 'R')}, {r('G / (R + G + B)', 'G')}, {r('B / (R + G + B)', 'B')}, {rs('mean_wavelength')} FROM s""", over_locs=False)
def _(spark, d):
    e = _emission(spark, d)
    grid = e.select("wavelength_nm").distinct()
    passed = grid.withColumn("transmission", (F.col("wavelength_nm") - 480) / 100)
    qe = grid.withColumns({"R": (F.col("wavelength_nm") - 495) / 60, "G": F.lit(0.5), "B": (560 - F.col("wavelength_nm")) / 70})
    return spectral.channel_fractions(spectral.through_filters(e, passed), qe)


@query("spectral_moment", f"WITH e AS ({EMISSION}) SELECT dye_name AS name, {r('sum(wavelength_nm * emission_intensity) / sum(emission_intensity)', 'moment')} FROM e GROUP BY 1", over_locs=False)
def _(spark, d):
    return spectral.moments(_emission(spark, d).withColumnRenamed("dye_name", "name"), "emission_intensity")


@query("spectral_lookup", f"WITH e AS ({EMISSION}) SELECT dye_name AS name, wavelength_nm, {rs('emission_intensity')} FROM e WHERE dye_name IN ('Brand#11', 'Brand#22')", over_locs=False)
def _(spark, d):
    return spectral.select_spectra(_emission(spark, d).withColumnRenamed("dye_name", "name"), ["Brand#11", "Brand#22"])


@query("photon_colours")
def _(spark, d):
    e = _emission(spark, d).withColumnRenamed("emission_intensity", "intensity")
    grid = e.select("wavelength_nm").distinct()
    qe = grid.withColumns({"R": (F.col("wavelength_nm") - 495) / 60, "G": F.lit(0.5), "B": (560 - F.col("wavelength_nm")) / 70})
    photons = spectral.nearest_efficiency(spectral.sample_photons(e, 500, seed=1), spectral.efficiency_grid(qe, 0.5), 0.5)
    return spectral.bootstrap_colours(photons, 100)


def _wavelength_model():
    grid = np.arange(450.0, 850.0, 1.0)
    qe = np.array([np.exp(-(((grid - c) / 40) ** 2)) for c in (640, 560, 470)])
    return spectral.WavelengthModel(grid, np.ones(len(grid)), qe, 1.4, 69.5)


@query("wavelength_fit")
def _(spark, d):
    return spectral.fit_wavelengths(exprs.photon_columns(locs(spark, d)), _wavelength_model()).select("loc_id", "wavelength", "wavelength_chi")


@query("wavelength_cells")
def _(spark, d):
    return spectral.fit_wavelength_cells(exprs.photon_columns(locs(spark, d)), _wavelength_model(), 16.0, 5, "fov_index").select("loc_id", "wavelength")


# links and clusters


PLANTED = "dense_rank() OVER (PARTITION BY fov_index ORDER BY molecular_index) - 1"


@query("link_greedy", f"SELECT loc_id, {PLANTED} AS link_group FROM locs")
def _(spark, d):
    return linking.link_groups(locs(spark, d), 0.5, 1).select("loc_id", "link_group")


@query("link_events", f"""
WITH p AS (SELECT *, {PLANTED} AS link_group FROM locs),
g AS (SELECT fov_index, link_group, min(frame) AS frame, max(frame) AS last, count(*) AS n, sum({PHOTONS}) AS photons FROM p GROUP BY 1, 2)
SELECT fov_index, link_group, frame, last - frame + 1 AS len, n, {rs('photons')} FROM g WHERE frame > 0 AND last < 499""")
def _(spark, d):
    return linking.link(exprs.photon_columns(locs(spark, d)), 500, 0.5, 1).select("fov_index", "link_group", "frame", "len", "n", "photons")


@query("link_by_place", f"SELECT loc_id, {PLANTED} AS track_id FROM locs")
def _(spark, d):
    return linking.optimal_links(locs(spark, d), 0.5, 1, w_spectral=0.0).select("loc_id", "track_id")


@query("molecules_by_link", f"""
WITH k AS (SELECT * FROM locs WHERE chi_sqr < (SELECT quantile_cont(chi_sqr, 0.5) FROM locs)),
s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY fov_index, molecular_index ORDER BY frame)),
c AS (SELECT *, sum(new) OVER (PARTITION BY fov_index, molecular_index ORDER BY frame) AS part FROM s)
SELECT fov_index, min(frame) AS first, count(*) AS n, {r('avg(xc)', 'xc')}, {r('avg(yc)', 'yc')} FROM c GROUP BY fov_index, molecular_index, part""")
def _(spark, d):
    rows = linking.molecules_by_link(locs(spark, d), 0.5, 1)[1]
    out = rows.groupBy("fov_index", "molecular_index").agg(F.min("frame").alias("first"), F.count("*").alias("n"), F.avg("xc").alias("xc"), F.avg("yc").alias("yc"))
    return out.drop("molecular_index")


@query("mean_event_length", f"SELECT {r('avg(len)', 'mean_length')} FROM (SELECT max(frame) - min(frame) + 1 AS len FROM locs GROUP BY fov_index, molecular_index)")
def _(spark, d):
    return linking.mean_event_length(locs(spark, d), 0.5, 1)


@query("link_optimal")
def _(spark, d):
    return linking.optimal_links(locs(spark, d), 0.5, 1, tolerance=0.5).select("loc_id", "track_id")


@query("dbscan", """
, e AS (SELECT a.loc_id AS a, b.loc_id AS b, sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) AS d FROM locs a JOIN locs b ON a.fov_index = b.fov_index AND abs(a.xc - b.xc) <= 0.1 AND abs(a.yc - b.yc) <= 0.1 WHERE sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) <= 0.1),
core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 4),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk AS (SELECT id AS node, id AS root FROM core UNION SELECT ce.b, walk.root FROM walk JOIN ce ON ce.a = walk.node),
lab AS (SELECT node, min(root) AS root FROM walk GROUP BY node),
best AS (SELECT e.b AS loc_id, arg_min(root, (d, e.a)) AS root FROM e JOIN lab ON e.a = lab.node GROUP BY 1),
num AS (SELECT fov_index, root, row_number() OVER (PARTITION BY fov_index ORDER BY root) - 1 AS k FROM (SELECT DISTINCT locs.fov_index, best.root FROM best JOIN locs USING (loc_id)))
SELECT locs.loc_id, coalesce(k, -1) AS cluster_id FROM locs LEFT JOIN best USING (loc_id) LEFT JOIN num ON num.fov_index = locs.fov_index AND num.root = best.root""")
def _(spark, d):
    return cluster.dbscan(locs(spark, d), 0.1, 4).select("loc_id", "cluster_id")


@query("hdbscan")
def _(spark, d):
    return cluster.hdbscan(locs(spark, d), 5).select("loc_id", "cluster_id")


@query("static_rows", ORACLE_SQL["dbscan"].replace("SELECT locs.loc_id, coalesce(k, -1) AS cluster_id FROM", "SELECT locs.loc_id, k IS NOT NULL AS is_static FROM"), over_locs=False)
def _(spark, d):
    return cluster.flag_static(locs(spark, d), 0.1, 4).select("loc_id", "is_static")


WALK = """
walk AS (SELECT node, node AS root FROM nodes UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node),
lab AS (SELECT node, min(root) AS root FROM walk GROUP BY node)"""


@query("joint_clusters", f"""
, m AS (SELECT quantile_cont(xc_err, 0.5) AS m FROM locs),
h AS (SELECT a.loc_id AS a, b.loc_id AS b, """ + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c}) / (a.{c}_err * a.{c}_err + b.{c}_err * b.{c}_err)" for c in ("xc", "yc", "A_R", "A_G")) + f""" AS q
  FROM locs a JOIN locs b ON a.fov_index = b.fov_index AND a.loc_id < b.loc_id, m WHERE sqrt((a.xc - b.xc) * (a.xc - b.xc) + (a.yc - b.yc) * (a.yc - b.yc)) <= 2 * sqrt(2) * m),
e AS (SELECT a, b FROM h WHERE q < 4 UNION ALL SELECT b, a FROM h WHERE q < 4), nodes AS (SELECT loc_id AS node FROM locs), {WALK},
big AS (SELECT root FROM lab GROUP BY root HAVING count(*) >= 3),
num AS (SELECT root, row_number() OVER (PARTITION BY fov_index ORDER BY root) - 1 AS k FROM big JOIN locs ON loc_id = root)
SELECT loc_id, coalesce(k, -1) AS cluster_id FROM locs JOIN lab ON node = loc_id LEFT JOIN num USING (root)""")
def _(spark, d):
    return cluster.joint_clusters(exprs.photon_columns(locs(spark, d)), 2.0, 3).select("loc_id", "cluster_id")


@query("image_regions", f"""
, px AS (SELECT fov_index, CAST(floor(yc) AS BIGINT) AS y, CAST(floor(xc) AS BIGINT) AS x, count(*) AS v FROM locs WHERE xc > 0 AND xc < 256 AND yc > 0 AND yc < 256 GROUP BY ALL),
bright AS (SELECT *, fov_index * 100000 + y * 257 + x AS id FROM px WHERE v > (SELECT quantile_cont(v, 0.95) FROM px)),
e AS (SELECT a.id AS a, b.id AS b FROM bright a JOIN bright b ON a.fov_index = b.fov_index AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id),
nodes AS (SELECT id AS node FROM bright), {WALK},
big AS (SELECT fov_index, root FROM lab JOIN bright ON id = node GROUP BY 1, 2 HAVING sum(v) >= 3),
num AS (SELECT fov_index, root, row_number() OVER (PARTITION BY fov_index ORDER BY root) - 1 AS aggregate_id FROM big)
SELECT locs.fov_index, aggregate_id, count(*) AS n_locs, {r('avg(A_R)', 'mean_R')}, {r('sum(xc / xc_err) / sum(1 / xc_err)', 'xc')}, {r('1 / sqrt(sum(1 / (yc_err * yc_err)))', 'yc_err')}, {r(f'sum({PHOTONS})', 'photons')}
FROM locs JOIN bright ON bright.fov_index = locs.fov_index AND bright.y = CAST(floor(yc) AS BIGINT) AND bright.x = CAST(floor(xc) AS BIGINT) JOIN lab ON node = id JOIN num ON num.root = lab.root
GROUP BY 1, 2""")
def _(spark, d):
    rows, stats = cluster.image_regions(exprs.photon_columns(locs(spark, d)), FOV_SIZE, FOV_SIZE, 1.0, least_rows=3)
    mean = rows.where("aggregate_id >= 0").groupBy("fov_index", "aggregate_id").agg(F.avg("A_R").alias("mean_R"))
    return stats.select("fov_index", "aggregate_id", "n_locs", "xc", "yc_err", "photons").join(mean, ["fov_index", "aggregate_id"])


@query("unmix_by_cluster")
def _(spark, d):
    return mixture.unmix_by_cluster(exprs.photon_columns(locs(spark, d)), 2, 2.0, 3)[0].select("loc_id", "channel", "assignment_code")


@query("misidentification_bins")
def _(spark, d):
    acc = sequence.photon_accumulation(exprs.photon_columns(locs(spark, d)))
    return mixture.misidentification_by_photons(acc, MODEL, (0, 500, 1000, 2000), 4000)


@query("nena_precision")
def _(spark, d):
    s, e = mixture.nena(regions.next_frame_histogram(locs(spark, d), 1.0, 0.01, ("fov_index",)), 0.01)
    return spark.createDataFrame([(float(s), float(e))], "precision double, spread double")


DRIFTING = "xc + frame * 0.002 * (fov_index % 3 - 1) AS xc, yc - frame * 0.003 * (fov_index % 2) AS yc"


@query("undrift_multi_fov", f"SELECT fov_index, TRUE AS along, TRUE AS across FROM locs GROUP BY fov_index")
def _(spark, d):
    t = locs(spark, d).select("loc_id", "fov_index", "frame", F.col("xc").alias("x0"), F.col("yc").alias("y0"), "xc", "yc")
    # the same places in every frame, as markers have; each field drifts its own way
    steady = t.withColumns({"xc": F.round("x0"), "yc": F.round("y0")})
    places = steady.select("fov_index", "xc", "yc").distinct().join(steady.select("fov_index", "frame").distinct(), "fov_index")
    seen = places.where("(CAST(xc AS INT) * 31 + CAST(yc AS INT) * 17 + frame) % 5 = 0").selectExpr("fov_index", "frame", "xc AS x0", "yc AS y0", DRIFTING.split(", ")[0], DRIFTING.split(", ")[1])
    moved = drift.undrift(seen, "aim", params=drift.Params(100, 0.2, 1.6))
    left = moved.groupBy("fov_index", "x0", "y0").agg(F.stddev_pop("xc").alias("sx"), F.stddev_pop("yc").alias("sy"))
    return left.groupBy("fov_index").agg((F.avg("sx") < 0.08).alias("along"), (F.avg("sy") < 0.08).alias("across"))


@query("aim_drift")
def _(spark, d):
    return drift.aim_fields(locs(spark, d), drift.Params(125, 0.25, 1.0))


# images, generators, streams


def _movie(spark):
    emitters = spark.range(40).select((F.col("id") % 4).cast("int").alias("frame"), (F.col("id") * 29 % 50 + 7.3).alias("xc"), (F.col("id") * 17 % 50 + 6.6).alias("yc"), F.lit(3000.0).alias("photons"))
    return simulate.movie(emitters, 4, 64, 64, background=5.0)


UNIT = (("R", "G"), ("G", "B"))


#: Spots far from each other and from the border, three frames in each of two files, each file at its own places.
SCENE_SQL = """SELECT CAST(f AS INT) AS f, CAST(n AS INT) AS frame, CAST(12 + 16 * (i % 4) + f * 3 + (n + i) % 5 * 0.2 AS DOUBLE) AS xc,
  CAST(14 + 16 * floor(i / CAST(4 AS DOUBLE)) - f * 2 + (n * 3 + i) % 5 * 0.2 AS DOUBLE) AS yc FROM range(2) AS a(f), range(3) AS b(n), range(16) AS c(i)"""


def _scene(spark):
    """The planted spots, and movies of them as one table with two files."""
    rows = spark.sql(SCENE_SQL).withColumn("photons", F.lit(6000.0))
    movies = [simulate.movie(rows.where(F.col("f") == f), 3, 80, 80, background=5.0, seed=f, file=f"scene{f}") for f in (0, 1)]
    return rows.withColumn("file", F.concat(F.lit("scene"), F.col("f").cast("string"))), movies[0].union(movies[1])


def _matched(truth, found, reach: float, *more):
    """Each planted spot with the found ones around it, and those around none as frame -1."""
    pairs = regions.near_pairs(truth, found, reach, on=("file", "frame"))
    seen = pairs.groupBy("file", "frame", "xc", "yc").agg(F.count("*").alias("n"), *more)
    held = truth.join(seen, ["file", "frame", "xc", "yc"], "left").select("file", "frame", "xc", "yc", F.coalesce("n", F.lit(0)).alias("n"), *[c for c in seen.columns if c not in ("file", "frame", "xc", "yc", "n")])
    return held, found.count() - pairs.count()


FOUND_SQL = f"SELECT 'scene' || f AS file, frame, {rs('xc', 'yc')}, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS false_spots FROM ({SCENE_SQL})"


@query("planted_spots_detected", FOUND_SQL, over_locs=False)
def _(spark, d):
    truth, frames = _scene(spark)
    found = image.detect_frames(image.map_frames(frames, lambda i: (i - 100.0) / 2.0), 10.0, 1.3, pfa=1e-7, share=0.5)
    held, false = _matched(truth, found.select("file", "frame", (F.col("x") + 0.5).alias("xc"), (F.col("y") + 0.5).alias("yc")), 1.5)
    return held.withColumn("false_spots", F.lit(false).cast("long"))


@query("planted_spots_identified", FOUND_SQL, over_locs=False)
def _(spark, d):
    truth, frames = _scene(spark)
    found = image.identify_frames(frames, 4000.0, 7)
    held, false = _matched(truth, found.select("file", "frame", (F.col("x") + 0.5).alias("xc"), (F.col("y") + 0.5).alias("yc")), 1.5)
    return held.withColumn("false_spots", F.lit(false).cast("long"))


@query("localise_multi_file", f"SELECT 'scene' || f AS file, frame, {rs('xc', 'yc')}, CAST(1 AS BIGINT) AS n, TRUE AS near, TRUE AS bright, TRUE AS wide FROM ({SCENE_SQL})", over_locs=False)
def _(spark, d):
    truth, frames = _scene(spark)
    found = fitting.localise(frames, UNIT, variance=2.0, gain=2.0, offset=100.0).select("file", "frame", "xc", "yc", "s_x", "s_y", (F.col("A_R") + 2 * F.col("A_G") + F.col("A_B")).alias("A"))
    light = F.avg(F.col("r_A") / 4 * 2 * math.pi * F.col("r_s_x") * F.col("r_s_y"))
    held, _false = _matched(truth, found, 1.0, (F.max("distance") < 0.15).alias("near"), F.abs(light / 6000 - 1).alias("light"), (F.max(F.abs(F.col("r_s_x") - 1.3)) < 0.2).alias("wide"))
    return held.withColumn("bright", F.col("light") < 0.15).drop("light")


@query("simulated_light", f"SELECT 'scene' || f AS file, frame, TRUE AS near FROM ({SCENE_SQL}) GROUP BY ALL", over_locs=False)
def _(spark, d):
    light = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + (x - 100.0) / 2.0)
    return _scene(spark)[1].select("file", "frame", (F.abs(light / (16 * 6000 + 80 * 80 * 5) - 1) < 0.02).alias("near"))


@query("simulated_movie")
def _(spark, d):
    return _movie(spark).select("frame", "height", "width", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("light"))


@query("detected_spots")
def _(spark, d):
    return image.detect_frames(image.map_frames(_movie(spark), lambda i: (i - 100.0) / 2.0), 10.0, 1.3).select("frame", "y", "x")


@query("localised_movie")
def _(spark, d):
    return fitting.localise(_movie(spark), UNIT, variance=2.0, gain=2.0, offset=100.0).select("frame", "xc", "yc", "s_x", "s_y", "A_R", "A_G", "A_B")


@query("identified_spots")
def _(spark, d):
    return image.identify_frames(_movie(spark), 2000.0, 7)


@query("blinking_schedule")
def _(spark, d):
    return simulate.blinking(spark.range(200).select(F.col("id").alias("candidate_id")), 100, 0.05, 0.3, seed=2, bleach_after=2)


@query("random_walks")
def _(spark, d):
    return simulate.random_walk(spark, 50, 50, 0.5, 0.1, 1, 20.0, "reflective")


@query("binding_simulation")
def _(spark, d):
    return simulate.simulate_binding(spark, [("r", 0.1, 0.05), ("g", 0.1, 0.05), ("r", 0.2, 0.1)], 20, 0.1, simulate.Reaction(2.0, 0.5, {("r", "g"): 2.0}, {("r", "g"): 0.5}), (1, 2))


@query("fit_sweep")
def _(spark, d):
    return simulate.fit_sweep(spark, (500.0, 2000.0), ("STANDARD_DATA", "NOCOLOUR"), n=4).select("n_photons", "strategy", "bootstrap", "xc", "yc")


@query("json_metadata", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.v') AS VARCHAR) AS v FROM events""", over_locs=False)
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.v").alias("v"))


@query("windows_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY 1, 2", over_locs=False)
def _(spark, d):
    return streaming.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_blinks", f"""
WITH o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, {r('sum(value)', 'total')} FROM s GROUP BY user_id, k""", over_locs=False)
def _(spark, d):
    out = streaming.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("camera_registry", "SELECT * FROM (VALUES ('ximea', CAST(0.069 AS DOUBLE), 'BGGR', 'CS505CU_QE.csv'), ('zwo', CAST(0.0715 AS DOUBLE), 'RGGB', 'ASI585MC_QE.csv')) AS v(camera, pixel_um, mosaic, efficiency_file)", over_locs=False)
def _(spark, d):
    return tables.cameras(spark)


# sources and sinks


def _folder(spark, name: str) -> str:
    return shared_folder(spark, name)


@query("stored_locs", f"SELECT loc_id, frame, {r(PHOTONS, 'photons')}, {r(f'A_R / {PHOTONS}', 'A_R')} FROM locs WHERE frame >= 10")
def _(spark, d):
    path = _folder(spark, "locs")
    tables.write_locs(locs(spark, d), path)
    tables.rewrite_sorted(spark, path, f"{path}-sorted")
    return tables.read_locs(spark, f"{path}-sorted", first_frame=10).select("loc_id", "frame", "photons", "A_R")


@query("stored_frames_follow", "SELECT loc_id, CAST(CASE WHEN fov_index = 0 THEN frame ELSE frame + 1 + (SELECT max(frame) FROM locs WHERE fov_index = 0) END AS INT) AS frame FROM locs")
def _(spark, d):
    path, t = _folder(spark, "locs"), locs(spark, d)
    tables.write_locs(t.where("fov_index = 0"), path)
    tables.write_locs(t.where("fov_index > 0").withColumn("frame", F.col("frame").cast("double")), path, append=True, follow=True)
    return tables.in_frame_order(tables.read_locs(spark, path)).select("loc_id", "frame")


@query("csv_round_trip", f"SELECT loc_id, frame, {rs('xc', 'chi_sqr')} FROM locs")
def _(spark, d):
    path = _folder(spark, "csv")
    tables.write_csv(locs(spark, d).select("loc_id", "frame", "xc", "chi_sqr"), path)
    return tables.read_csv(spark, path, "loc_id long, frame int, xc double, chi_sqr double")


@query("numbers", f"SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, event_type FROM events", over_locs=False)
def _(spark, d):
    return tables.as_numbers(table(spark, d, "events").select("event_id", "user_id", "event_type"))


@query("movie_metadata", """
SELECT event_id, CAST(event_id % 7 AS INT) AS x, 2 AS y, 64 AS width, CAST(user_id AS INT) AS height, round(value, 2) + 0.0 AS exposure_ms, 2 AS n_frames, CAST(event_id AS INT) AS vendor_x FROM events""", over_locs=False)
def _(spark, d):
    key = F.format_string('"FrameKey-%d-0-0": {"ROI": "%d-2-64-%d", "Exposure-ms": %s}', F.lit(0), F.col("event_id") % 7, F.col("user_id"), F.round("value", 2).cast("string"))
    text = F.concat(F.lit('{"Summary": {"a": 1}, '), key, F.lit(', "FrameKey-1-0-0": {"ROI": "9-9-9-9"}}'))
    vendor = F.format_string('{"ROI": {"x": %d, "y": 0, "width": 5, "height": 6}}', F.col("event_id"))
    t = table(spark, d, "events").select("event_id", tables.imaging_metadata(text).alias("m"), tables.frame_count(text).alias("n_frames"), tables.vendor_roi(vendor).alias("v"))
    return t.select("event_id", "m.x", "m.y", "m.width", "m.height", "m.exposure_ms", "n_frames", F.col("v.x").alias("vendor_x"))


#: Small frames of two files by whole-number arithmetic.
PIXELS_SQL = "SELECT concat('movie', f) AS file, CAST(n AS INT) AS frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST((x * x * 7 + y * 13 + x * y * n + f * 31 + n * 5) % 101 AS DOUBLE) AS value FROM range(2) AS a(f), range(6) AS b(n), range(10) AS c(y), range(12) AS d(x)"


def _frames(spark):
    line = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "value"))), lambda p: p["value"].cast("float"))
    return spark.sql(PIXELS_SQL).groupBy("file", "frame").agg(line.alias("pixels")).select("file", "frame", F.lit(10).alias("height"), F.lit(12).alias("width"), "pixels")


@query("tiff_round_trip", f"SELECT file, frame, y, x, value, 6 AS n_frames, CAST(frame // 2 AS INT) AS t, CAST(frame % 2 AS INT) AS c FROM ({PIXELS_SQL})", over_locs=False)
def _(spark, d):
    folder = _folder(spark, "tiff").removeprefix("file://")
    tiff.write_tiff(_frames(spark), folder).count()
    counted = tiff.frame_counts(spark, folder).select(exprs.fov_name("path").alias("file"), "n_frames")
    back = image.explode_pixels(tiff.read_hyperstack(spark, folder, 1, 2, frames_per_task=4).drop("z")).withColumn("file", exprs.fov_name(F.col("file")))
    return back.join(counted, "file").select("file", "frame", "y", "x", F.col("value").cast("double").alias("value"), "n_frames", "t", F.col("c").cast("int").alias("c"))


def _near_sql(what: str, by: str = "") -> str:
    """A value from each pixel and those around it; the border stands for what lies beyond."""
    return f"""WITH p AS ({PIXELS_SQL}), s AS (SELECT i, j FROM range(-1, 2) AS u(i), range(-1, 2) AS v(j))
SELECT a.file, a.frame, a.y, a.x, {r(what, 'value')} FROM p a, s, p b WHERE b.file = a.file AND b.frame = a.frame {by or 'AND b.y = least(greatest(a.y + i, 0), 9) AND b.x = least(greatest(a.x + j, 0), 11)'} GROUP BY ALL"""


def _as_rows(frames):
    return image.explode_pixels(frames).select("file", "frame", "y", "x", F.col("value").cast("double").alias("value"))


@query("median_filtered", _near_sql("quantile_cont(b.value, 0.5)"), over_locs=False)
def _(spark, d):
    return _as_rows(image.median_filter_frames(_frames(spark), 3))


@query("variance_weighted", _near_sql("sum(b.value / (1 + (b.y + b.x) % 3)) / sum(1.0 / (1 + (b.y + b.x) % 3))", "AND b.y = a.y + i AND b.x = a.x + j").replace("round(sum", "round(sum"), over_locs=False)
def _(spark, d):
    y, x = np.indices((10, 12))
    out = image.map_frames(image.variance_weighted_filter(_frames(spark), 1.0 + (y + x) % 3, 3), lambda i: i, "double")
    return _as_rows(out).withColumn("value", F.round("value", 3))


@query("smoothed_twice", _near_sql("avg(b.value)"), over_locs=False)
def _(spark, d):
    return _as_rows(image.smooth_frames(_frames(spark), numeric.uniform_filter, 3, mode="symmetric")).withColumn("value", F.round("value", 3))


for _name in ("variance_weighted", "smoothed_twice"):  # the planes are single floats
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(", 6) + 0.0) AS value", ", 3) + 0.0) AS value")


@query("binned_frames", f"WITH p AS ({PIXELS_SQL}) SELECT a.file, a.frame, a.y, a.x, sum(b.value) AS value FROM p a JOIN p b ON b.file = a.file AND b.frame = a.frame AND b.y // 2 = a.y // 2 AND b.x // 2 = a.x // 2 GROUP BY ALL", over_locs=False)
def _(spark, d):
    return _as_rows(image.bin_frames(_frames(spark), 2))


@query("pixel_maps", f"SELECT file, frame, CAST(y - 3 AS INT) AS y, CAST(x - 2 AS INT) AS x, {r('(value - 10) * 0.25', 'photons')} FROM ({PIXELS_SQL}) WHERE value > 20 AND x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 8", over_locs=False)
def _(spark, d):
    lit = image.crop_maps(image.pixels_above(_frames(spark), 20.0), 2, 3, 5, 6)
    return lit.select("file", "frame", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), image.to_photons(F.col("value"), 10.0, 0.5, 2.0).cast("double").alias("photons"))


@query("mask_frames", f"SELECT file, frame, y, x, CAST(CASE WHEN value > 90 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM ({PIXELS_SQL}) WHERE (file, frame) IN (SELECT (file, frame) FROM ({PIXELS_SQL}) WHERE value > 90)", over_locs=False)
def _(spark, d):
    return _as_rows(image.mask_of(spark.sql(PIXELS_SQL).where("value > 90"), 10, 12))


@query("summed_files", f"SELECT file, 0 AS frame, y, x, sum(value) AS value FROM ({PIXELS_SQL}) WHERE frame < 4 GROUP BY ALL", over_locs=False)
def _(spark, d):
    return _as_rows(fitting.summed_frames(_frames(spark), 4))


# more expressions, filters and reductions


@query("scalar_formulas", f"""
SELECT loc_id, {r('1239.841984 / (500 + s_x)', 'energy')}, {r('coalesce(A_R / (A_R + A_G), 0)', 'duty')}, {r('s_x * sqrt(1 + A_R * 0.01 / 4)', 'moving')},
  {r('CASE WHEN bg_R > 15 THEN 1e-8 ELSE 1 / (greatest(A_R - 20, 0) + 1 + bg_R * bg_R) END', 'weight')}, {r('5 * exp(-((xc - 100) * (xc - 100) + (yc - 90) * (yc - 90)) / (2 * 40 * 40))', 'spot')}, {r('s_x / (2 * sqrt(2 * ln(2)))', 'sigma')} FROM locs""")
def _(spark, d):
    c = F.col
    return locs(spark, d).select(
        "loc_id", exprs.photon_energy_ev(500 + c("s_x")).alias("energy"), exprs.duty_cycle(c("A_R"), c("A_G")).alias("duty"), (exprs.dynamic_error(1.0, 2.0, c("A_R"), 0.01) * c("s_x")).alias("moving"),
        exprs.pixel_weight(c("A_R") - 20, c("bg_R"), 15.0).alias("weight"), exprs.gauss2d(c("xc"), c("yc"), 100.0, 90.0, 40.0, 5.0).alias("spot"), exprs.sigma_of_fwhm(c("s_x")).alias("sigma"),
    )


@query("photoelectron_arrays", f"SELECT vec_id, i, {r('(CAST(embedding[i] AS DOUBLE) - 0.5) / 2 / 0.8', 'value')} FROM (SELECT vec_id, embedding, CAST(unnest(range(1, len(embedding) + 1)) AS INT) AS i FROM embeddings)", over_locs=False)
def _(spark, d):
    v = F.col("embedding").cast("array<double>")
    same = lambda x: F.transform(v, lambda _: F.lit(x))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(exprs.photoelectrons(v, same(2.0), same(0.5), same(0.8))).alias("p", "value"))
    return rows.select("vec_id", (F.col("p") + 1).alias("i"), "value")


@query("rows_in_circle", "SELECT loc_id FROM locs WHERE (xc - 100) * (xc - 100) + (yc - 90) * (yc - 90) < 2500")
def _(spark, d):
    return filters.in_circle(filters.validated(locs(spark, d)), 100.0, 90.0, 50.0).select("loc_id")


@query("rows_in_polygon", f"SELECT loc_id FROM locs WHERE {_poly_sql(POLY)}")
def _(spark, d):
    xs, ys = zip(*POLY[:-1])
    return filters.in_polygon(locs(spark, d), xs, ys).select("loc_id")


@query("rows_in_rectangle", f"SELECT loc_id FROM locs WHERE {_poly_sql([*zip(*RECT.corners()), None])}")
def _(spark, d):
    return filters.in_rectangle(locs(spark, d), *RECT.corners()).select("loc_id")


@query("pick_many_rectangles", f"""
WITH p AS (SELECT i AS g, CAST(i * 37 % 240 AS DOUBLE) AS x, CAST(i * 91 % 240 AS DOUBLE) AS y FROM range(1200) AS v(i))
SELECT loc_id, CAST(g AS INT) AS "group", CAST(floor((xc - (x + 4)) * 10 + 0.001) AS BIGINT) AS along, CAST(floor(abs(yc - y) * 10 + 0.001) AS BIGINT) AS across FROM locs JOIN p ON abs(xc - (x + 4)) < 3.9999 AND abs(yc - y) < 1.9999""")
def _(spark, d):
    picks = [regions.Rectangle(float(i * 37 % 240), float(i * 91 % 240), float(i * 37 % 240) + 8, float(i * 91 % 240), 4.0) for i in range(1200)]
    out = regions.picked(locs(spark, d), picks).where("abs(y_pick_rot) < 3.9999 AND abs(x_pick_rot) < 1.9999")  # not the edges
    return out.select("loc_id", "group", F.floor(F.col("y_pick_rot") * 10 + 0.001).alias("along"), F.floor(F.abs("x_pick_rot") * 10 + 0.001).alias("across"))


@query("index_blocks", "SELECT loc_id FROM locs WHERE floor(xc / 20) BETWEEN 4 AND 6 AND floor(yc / 20) BETWEEN 3 AND 5")
def _(spark, d):
    return regions.row_places(locs(spark, d), regions.around(locs(spark, d), 100.0, 90.0, 20.0)).select("loc_id")


@query("group_means", f"SELECT molecular_index, {r('CAST(CAST(avg(A_R) AS FLOAT) AS DOUBLE)', 'A_R')} FROM locs GROUP BY 1")
def _(spark, d):
    return aggregate.group_mean(locs(spark, d), "molecular_index", "A_R").withColumn("A_R", F.col("A_R").cast("double"))


@query("grid_edges", f"""
WITH b AS (SELECT 'x' AS axis, min(xc) AS lo, max(xc) AS hi FROM locs UNION ALL SELECT 'y', min(yc), max(yc) FROM locs)
SELECT axis, i, {r('lo + i * 16', 'edge')}, {r('lo + i * 16 + 8', 'centre')} FROM (SELECT axis, lo, unnest(range(0, CAST(ceil((hi - lo) / 16) AS BIGINT) + 1)) AS i FROM b)""")
def _(spark, d):
    return aggregate.spatial_grid(locs(spark, d), 16.0)


@query("labelled_molecules", f"SELECT molecular_index + 5 AS molecular_index, count(*) AS frames, {r('avg(xc)', 'xc')} FROM locs WHERE molecular_index % 3 <> 0 GROUP BY 1")
def _(spark, d):
    t = exprs.photon_columns(locs(spark, d)).withColumn("cluster_id", F.when(F.col("molecular_index") % 3 == 0, F.lit(-1)).otherwise(F.col("molecular_index"))).drop("molecular_index")
    return aggregate.finish_clustering(t, offset=5)[0].select("molecular_index", "frames", "xc")


@query("render_smooth", """
, h AS (SELECT CAST(floor(yc * 2) AS INT) AS y, CAST(floor(xc * 2) AS INT) AS x, count(*) AS v FROM locs WHERE xc > 0 AND xc < 256 AND yc > 0 AND yc < 256 GROUP BY 1, 2),
k AS (SELECT CAST(i AS INT) AS i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * q * q)) FROM range(-4, 5) AS w(q)) AS w FROM range(-4, 5) AS u(i))
SELECT CAST(y + a.i AS INT) AS py, CAST(x + b.i AS INT) AS px, round(sum(v * a.w * b.w), 6) + 0.0 AS value FROM h, k a, k b WHERE y + a.i BETWEEN 0 AND 511 AND x + b.i BETWEEN 0 AND 511 GROUP BY 1, 2""")
def _(spark, d):
    return render.render(locs(spark, d), 2.0, VIEW, "smooth")


@query("render_rgb", SPLAT.replace("A_R AS c", "A_R AS c, A_G AS c2") .replace("w, c, exp", "w, c, c2, exp") + f" SELECT py, px, {r('sum(w * g)', 'value')}, {r('sum(w * g * c) / sum(w * g)', 'A_R')}, {r('sum(w * g * c2) / sum(w * g)', 'A_G')} FROM g GROUP BY 1, 2")
def _(spark, d):
    return render.gaussian_rgb(exprs.photon_columns(locs(spark, d)), 2.0, VIEW, 0.3).select("py", "px", "value", "A_R", "A_G")


@query("segment_edges", "SELECT CAST(i AS INT) AS segment, CAST(floor(i * 999 / 10.0) AS INT) AS start, CAST(floor((i + 1) * 999 / 10.0) AS INT) AS stop FROM range(10) AS v(i)", over_locs=False)
def _(spark, d):
    return sequence.segment_bounds(spark, 1000, 100)


# markers of several fields of view

MARKERS_SQL = """
SELECT CAST(f AS INT) AS fov_index, CAST(n AS INT) AS frame, CAST(20 + 25 * i + 7 * f AS DOUBLE) + 0.5 + n * 0.004 * (f - 1) AS xc, CAST(30 + 20 * i - 4 * f AS DOUBLE) + 0.5 - n * 0.003 * f AS yc
FROM range(3) AS a(f), range(200) AS b(n), range(3) AS c(i)"""


@query("markers_per_field", "SELECT CAST(f AS INT) AS fov_index, CAST(i AS INT) AS place, TRUE AS near FROM range(3) AS a(f), range(3) AS c(i)", over_locs=False)
def _(spark, d):
    found = drift.detect_fiducials(spark.sql(MARKERS_SQL), 128.0, 128.0, 200, percentile=0.5)
    place = F.round((F.col("xc") - 20.5 - 7 * F.col("fov_index")) / 25).cast("int")
    near = (F.abs(F.col("xc") - 20.5 - 7 * F.col("fov_index") - 25 * place) < 1) & (F.abs(F.col("yc") - 30.5 + 4 * F.col("fov_index") - 20 * place) < 1)
    return found.select("fov_index", place.alias("place"), near.alias("near"))


@query("undrift_by_markers", "SELECT CAST(f AS INT) AS fov_index, method, TRUE AS along, TRUE AS across FROM range(3) AS a(f), (VALUES ('auto'), ('fiducial')) AS m(method)", over_locs=False)
def _(spark, d):
    t = spark.sql(MARKERS_SQL).withColumn("place", F.round((F.col("yc") + 4 * F.col("fov_index") - 30.5) / 20).cast("int"))
    t = t.withColumn("loc_id", (F.col("fov_index") * 1000 + F.col("frame")) * 10 + F.col("place"))
    out = None
    for method, options in (("auto", {}), ("fiducial", {"percentile": 0.5})):
        moved = drift.undrift(t, method, width=128.0, height=128.0, n_frames=200, **options)
        left = moved.groupBy("fov_index", "place").agg(F.stddev_pop("xc").alias("sx"), F.stddev_pop("yc").alias("sy"))
        part = left.groupBy("fov_index").agg((F.max("sx") < 0.1).alias("along"), (F.max("sy") < 0.1).alias("across")).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out
