"""Row filters of localisation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.aggregate import exact_percentile
from lumenframe.schema import AMPLITUDES, BACKGROUNDS, require


def below(name: str, limit: float | Column) -> Column:
    """Strictly below; null and NaN are not."""
    return (F.col(name) < limit) & ~F.isnan(F.col(name))


def quality(df: DataFrame, chi: float | None = None, position_error: float | None = None, colour_error: float | None = None, sigma: tuple[float, float] | None = None, sigma_error: float | None = None, photons: tuple[float, float] | None = None) -> DataFrame:
    """Rows strictly inside all the given bounds.

    Without ``chi`` the limit is the median of ``chi_sqr`` in the unfiltered
    input, computed when called.  Colour errors are tested as they stand in
    the table.
    """
    keep = F.lit(True)
    for names, limit in ((("xc_err", "yc_err"), position_error), (tuple(f"{c}_err" for c in AMPLITUDES + BACKGROUNDS), colour_error), (("s_x_err", "s_y_err"), sigma_error)):
        if limit is not None:
            for c in names:
                keep &= below(c, limit)
    for names, bounds in ((("s_x", "s_y"), sigma), (("photons",), photons)):
        if bounds is not None:
            for c in names:
                keep &= (F.col(c) > bounds[0]) & below(c, bounds[1])
    if chi is not None:
        return df.where(keep & below("chi_sqr", chi))
    median = exact_percentile(df, "chi_sqr")
    return df.where(keep & (below("chi_sqr", median) if median is not None else F.lit(False)))


def physical(df: DataFrame, width: float, height: float) -> DataFrame:
    """Complete fits inside the image, of positive widths under 3 pixels, with positive amplitudes and backgrounds."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    keep = F.lit(True)
    for c in df.columns:
        keep &= F.col(c).isNotNull()
    for c in numbers:
        keep &= ~F.isnan(c)
    for c, limit in (("xc", width), ("yc", height), ("s_x", 3.0), ("s_y", 3.0)):
        keep &= (F.col(c) > 0) & (F.col(c) < limit)
    for c in df.columns:
        if c in (*AMPLITUDES, *BACKGROUNDS, "A", "bg"):
            keep &= F.col(c) > 0
    return df.where(keep)


def validated(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if it has the columns a localisation needs; fails at run time on values that aren't finite."""
    columns = columns or ("xc", "yc", "frame")
    require(df, *columns)
    checks = [F.assert_true(F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(f"{c} is not finite")) for c in columns]
    return df.where(F.coalesce(*[c.cast("boolean") for c in checks], F.lit(True)))


def in_circle(df: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Rows strictly inside a circle."""
    return df.where((F.col("xc") - x) ** 2 + (F.col("yc") - y) ** 2 < radius**2)


def in_polygon(df: DataFrame, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """Rows inside a polygon by the even-odd rule; one boolean for each edge."""
    return df.where(polygon_test(F.col("xc"), F.col("yc"), xs, ys))


def polygon_test(x: Column, y: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """An edge counts from its lower end, included, to its upper one, left out: a corner's level counts once."""
    crossings = F.lit(0)
    for i in range(len(xs)):
        xi, yi, xj, yj = map(float, (xs[i], ys[i], xs[i - 1], ys[i - 1]))
        if yi == yj:
            continue
        lo, hi = min(yi, yj), max(yi, yj)
        span = (y >= lo) & (y < hi)
        crossings = crossings + F.when(span & (x < (xj - xi) * (y - yi) / (yj - yi) + xi), 1).otherwise(0)
    return crossings % 2 == 1


def in_rectangle(df: DataFrame, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """Rows inside a rotated rectangle, given by its corners in order."""
    return df.where(polygon_test(F.col("xc"), F.col("yc"), xs, ys))


def remove_fiducials(locs: DataFrame, aggregates: DataFrame, n_frames: int, density: float | None = None, above: Mapping[str, float] | None = None, under: Mapping[str, float] | None = None, require_all: bool = False) -> DataFrame:
    """Drop the rows of aggregates that look like fiducial markers.

    ``aggregates`` has ``aggregate_id``, ``n_locs`` and colour columns; a
    marker has at least ``density`` rows a frame, colours above or under the
    limits, any of them or all.
    """
    tests = [F.col("n_locs") / n_frames >= density] if density is not None else []
    tests += [F.col(c) > v for c, v in (above or {}).items()] + [F.col(c) < v for c, v in (under or {}).items()]
    if not tests:
        return locs
    flag = tests[0]
    for t in tests[1:]:
        flag = flag & t if require_all else flag | t
    return locs.join(aggregates.where(flag).select("aggregate_id"), "aggregate_id", "left_anti")


def bright_enough(dyes: DataFrame, efficiency: DataFrame, power: float, time_ms: float, least: float) -> DataFrame:
    """Dyes whose detected photons reach a minimum.

    ``dyes`` has ``dye_name`` and ``photons_100ms``; ``efficiency`` has
    ``dye_name`` and the channels R, G, B, averaged with G twice.  Each dye
    keeps its own efficiency; dyes without photons are left out.
    """
    mean = (F.col("B") + 2 * F.col("G") + F.col("R")) / 4
    detected = (F.col("photons_100ms") * mean * power * time_ms / 100).alias("detected_photons")
    return dyes.where(F.col("photons_100ms").isNotNull()).join(efficiency, "dye_name").select("dye_name", detected).where(F.col("detected_photons") >= least)


def enough(df: DataFrame, least: int) -> DataFrame:
    """``df``, or no rows of its schema if it has under ``least``; decided in one pass without fetching rows."""
    some = df.limit(least).agg(F.count("*").alias("n__")).where(F.col("n__") >= least).select(F.lit(1).alias("go__"))
    return df.crossJoin(F.broadcast(some)).drop("go__")


def complete_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every measurement is null or NaN."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    if not numbers:
        return df
    empty = F.lit(True)
    for c in numbers:
        empty &= F.col(c).isNull() | F.isnan(c)
    return df.where(~empty)
