"""Joins of localisations with regions, with each other, and with lookups.

Distance joins never compare all pairs: both sides carry a grid cell of the
search radius, one side is repeated to the cells around its own, and an
equi-join on the cell meets the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import exprs
from lumenframe.operators.filters import polygon_test
from lumenframe.schema import ensure_loc_id

#: So many picks go into one expression; more are joined through a grid.  The result is the same.
INLINE_PICKS = 64


@dataclass(frozen=True)
class Circle:
    x: float
    y: float
    radius: float

    def box(self) -> tuple[float, float, float, float]:
        return self.x - self.radius, self.y - self.radius, self.x + self.radius, self.y + self.radius


@dataclass(frozen=True)
class Rectangle:
    """Around the segment from (x0, y0) to (x1, y1)."""

    x0: float
    y0: float
    x1: float
    y1: float
    width: float

    def corners(self) -> tuple[list[float], list[float]]:
        angle = math.atan2(self.y1 - self.y0, self.x1 - self.x0)
        dx, dy = math.sin(angle) * self.width / 2, math.cos(angle) * self.width / 2
        return [self.x0 - dx, self.x0 + dx, self.x1 + dx, self.x1 - dx], [self.y0 + dy, self.y0 - dy, self.y1 - dy, self.y1 + dy]

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = self.corners()
        return min(xs), min(ys), max(xs), max(ys)


@dataclass(frozen=True)
class Polygon:
    points: tuple[tuple[float, float], ...]

    def corners(self) -> tuple[list[float], list[float]] | None:
        """None while the polygon is open."""
        if len(self.points) < 4 or self.points[0] != self.points[-1]:
            return None
        return [p[0] for p in self.points[:-1]], [p[1] for p in self.points[:-1]]

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.points)
        return min(xs), min(ys), max(xs), max(ys)


Pick = Circle | Rectangle | Polygon


def contains(pick: Pick, x: Column, y: Column) -> Column:
    if isinstance(pick, Circle):
        return (x - pick.x) ** 2 + (y - pick.y) ** 2 < pick.radius**2
    corners = pick.corners()
    return F.lit(False) if corners is None else polygon_test(x, y, *corners)


def picked(locs: DataFrame, picks: Sequence[Pick], group: str = "group") -> DataFrame:
    """Rows inside picks, with the pick's place as ``group``.

    Overlapping picks repeat a row.  Rectangles add coordinates along and
    across their axis, ``x_pick_rot`` and ``y_pick_rot``.  Few picks are one
    expression for each row; many are a table, met through grid cells.
    """
    x, y = F.col("xc"), F.col("yc")
    if len(picks) > INLINE_PICKS:
        return _picked_by_grid(locs, picks, group)
    hits = F.array(*[F.when(contains(p, x, y), F.lit(i)) for i, p in enumerate(picks)]) if picks else F.array().cast("array<int>")
    out = locs.withColumn(group, F.explode(F.array_compact(hits)))
    if any(isinstance(p, Rectangle) for p in picks):
        sides = [F.array(*[F.lit(v).cast("double") for v in side]) for side in zip(*map(_axis, picks))]
        out = _rotated(out, [F.element_at(side, F.col(group) + 1) for side in sides])
    return out


def _axis(pick: Pick) -> tuple[float | None, ...]:
    """Centre, cosine and sine of a rectangle's axis; nulls for other shapes."""
    if not isinstance(pick, Rectangle):
        return None, None, None, None
    angle = 0.5 * math.pi - math.atan2(pick.y1 - pick.y0, pick.x1 - pick.x0)
    return (pick.x0 + pick.x1) / 2, (pick.y0 + pick.y1) / 2, math.cos(angle), math.sin(angle)


def _rotated(df: DataFrame, axis: Sequence[Column]) -> DataFrame:
    cx, cy, cos, sin = axis
    dx, dy = F.col("xc") - cx, F.col("yc") - cy
    return df.withColumns({"x_pick_rot": dx * cos - dy * sin, "y_pick_rot": dx * sin + dy * cos})


def _picked_by_grid(locs: DataFrame, picks: Sequence[Pick], group: str) -> DataFrame:
    spark = locs.sparkSession
    boxes = [p.box() for p in picks]
    cell = max(1e-9, sorted(max(b[2] - b[0], b[3] - b[1]) for b in boxes)[len(boxes) // 2])
    rows = []
    for i, (p, b) in enumerate(zip(picks, boxes)):
        corners = None if isinstance(p, Circle) else p.corners()
        if isinstance(p, Circle):
            rows.append((i, *map(float, b), float(p.x), float(p.y), float(p.radius), None, None, *_axis(p)))
        elif corners:
            rows.append((i, *map(float, b), None, None, None, [float(v) for v in corners[0]], [float(v) for v in corners[1]], *_axis(p)))
    table = spark.createDataFrame(rows, f"`{group}` int, x0 double, y0 double, x1 double, y1 double, px double, py double, pr double, pxs array<double>, pys array<double>, ax double, ay double, ac double, as double")
    at = lambda c: F.floor(F.col(c) / cell)
    table = table.withColumn("gx__", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy__", F.explode(F.sequence(at("y0"), at("y1"))))
    met = locs.withColumns({"gx__": at("xc"), "gy__": at("yc")}).join(table, ["gx__", "gy__"])
    x, y = F.col("xc"), F.col("yc")
    inside = F.when(F.col("pr").isNotNull(), (x - F.col("px")) ** 2 + (y - F.col("py")) ** 2 < F.col("pr") ** 2).otherwise(exprs.in_polygon(x, y, F.col("pxs"), F.col("pys")))
    out = met.where(inside).drop("gx__", "gy__", "x0", "y0", "x1", "y1", "px", "py", "pr", "pxs", "pys")
    axis = ["ax", "ay", "ac", "as"]
    return (_rotated(out, [F.col(c) for c in axis]) if any(isinstance(p, Rectangle) for p in picks) else out).drop(*axis)


def grid_cells(df: DataFrame, size: float, x: str = "xc", y: str = "yc") -> DataFrame:
    """Add the cell of each row: ``cell_x``, ``cell_y``."""
    return df.withColumns({"cell_x": F.floor(F.col(x) / size), "cell_y": F.floor(F.col(y) / size)})


def grid_shape(width: float, height: float, size: float) -> tuple[int, int]:
    """Rows and columns of the grid over an image."""
    return math.ceil(height / size), math.ceil(width / size)


def around(df: DataFrame, x: float, y: float, size: float) -> DataFrame:
    """Rows of the nine cells around a point."""
    cx, cy = math.floor(x / size), math.floor(y / size)
    return grid_cells(df, size).where(F.col("cell_x").between(cx - 1, cx + 1) & F.col("cell_y").between(cy - 1, cy + 1)).drop("cell_x", "cell_y")


def near_pairs(left: DataFrame, right: DataFrame, radius: float | Column, on: Sequence[str] = (), x: str = "xc", y: str = "yc", cell: float | None = None, prefix: str = "r_") -> DataFrame:
    """Pairs at most ``radius`` apart that agree in ``on``; adds ``distance``.

    The right side's columns get ``prefix``, and it is the side that is
    repeated to nine cells.
    """
    size = float(cell if cell is not None else radius)
    if size <= 0:
        raise ValueError("the radius must be positive")
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumns({"gx__": F.floor(F.col(x) / size), "gy__": F.floor(F.col(y) / size)})
    b = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns], F.explode(shift).alias("s__"))
    b = b.select(*[c for c in b.columns if c != "s__"], (F.floor(F.col(f"{prefix}{x}") / size) + F.col("s__.i")).alias("hx__"), (F.floor(F.col(f"{prefix}{y}") / size) + F.col("s__.j")).alias("hy__"))
    same = (F.col("gx__") == F.col("hx__")) & (F.col("gy__") == F.col("hy__"))
    for c in on:
        same &= F.col(c) == F.col(f"{prefix}{c}")
    squared = (F.col(x) - F.col(f"{prefix}{x}")) ** 2 + (F.col(y) - F.col(f"{prefix}{y}")) ** 2
    limit = radius if isinstance(radius, Column) else F.lit(float(radius))
    return a.join(b, same).withColumn("distance", F.sqrt(squared)).where(F.col("distance") <= limit).drop("gx__", "gy__", "hx__", "hy__")


def next_frame_histogram(locs: DataFrame, d_max: float = 1.0, bin_size: float = 0.001, by: Sequence[str] = ("group",), hundreds: bool = False) -> DataFrame:
    """Histogram of distances to rows one frame later, within a group.

    Returns ``bin`` and ``n``.  Every row is a probe; with ``hundreds`` the
    last N mod 100 rows in table order are none.
    """
    locs = ensure_loc_id(locs)
    by = [c for c in by if c in locs.columns]
    probes = _first_hundreds(locs) if hundreds else locs
    later = locs.select("loc_id", "frame", "xc", "yc", *by).withColumn("frame", F.col("frame") - 1)
    pairs = near_pairs(probes.select("loc_id", "frame", "xc", "yc", *by), later, d_max, on=("frame", *by))
    return pairs.select(F.floor(F.col("distance") / bin_size).alias("bin")).where(F.col("bin") < int(round(d_max / bin_size))).groupBy("bin").agg(F.count("*").alias("n"))


def _first_hundreds(locs: DataFrame) -> DataFrame:
    """All but the last N mod 100 rows in id order."""
    n = locs.agg(F.count("*").alias("n"))
    rest = n.select((F.col("n") % 100).cast("int").alias("rest")).first().rest
    if not rest:
        return locs
    last = locs.select("loc_id").orderBy(F.col("loc_id").desc()).limit(rest).agg(F.min("loc_id").alias("edge__"))
    return locs.crossJoin(F.broadcast(last)).where(F.col("loc_id") < F.col("edge__")).drop("edge__")


def exemplar_pairs(locs: DataFrame, mean_0: Sequence[float], mean_1: Sequence[float], tolerance: float, nearest: float, farthest: float, least_photons: float, top: int = 10, channels: Sequence[str] = ("A_R", "A_G")) -> DataFrame:
    """Pairs of different dyes in one frame, a given distance (pixels) apart, closest first."""

    def like(mean: Sequence[float]) -> DataFrame:
        apart = sum(((F.col(c) - m) ** 2 for c, m in zip(channels, mean)), F.lit(0.0))
        return locs.where((F.sqrt(apart) < tolerance) & (F.col("photons") >= least_photons)).select("fov_index", "frame", "loc_id", "xc", "yc")

    pairs = near_pairs(like(mean_0), like(mean_1), farthest, on=("fov_index", "frame"))
    found = pairs.where((F.col("distance") >= nearest) & (F.col("loc_id") != F.col("r_loc_id")))
    return found.orderBy("distance", "loc_id", "r_loc_id").limit(top)


def without_rows(locs: DataFrame, gone: DataFrame, keys: Sequence[str] = ("frame", "xc", "yc")) -> DataFrame:
    """Rows whose keys are not in ``gone``."""
    return locs.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def row_places(locs: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of ``locs`` that ``some`` names by ``loc_id``."""
    return locs.join(some.select("loc_id").distinct(), "loc_id", "left_semi")


def with_group(locs: DataFrame, picked_rows: DataFrame, group: str = "group") -> DataFrame:
    """Each row's pick, -1 for the rest; of several the first."""
    first = picked_rows.groupBy("loc_id").agg(F.min(group).alias(group))
    return locs.drop(group).join(first, "loc_id", "left").withColumn(group, F.coalesce(group, F.lit(-1)))


def nearest_centre(rows: DataFrame, centres: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """Each row with its nearest centre within ``radius``: ``centre_id``, ``distance`` (null if none)."""
    pairs = near_pairs(rows.select("loc_id", "xc", "yc", *on), centres.select("centre_id", "xc", "yc", *on), radius, on=on)
    best = pairs.groupBy("loc_id").agg(F.min(F.struct("distance", F.col("r_centre_id").alias("centre_id"))).alias("best"))
    return rows.join(best.select("loc_id", "best.centre_id", "best.distance"), "loc_id", "left")


def refine_assignment(rows: DataFrame, centres: DataFrame, eps: float, clear: float, overlap: float, rounds: int = 10, least_new: int = 1, keys: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Assign unassigned rows (``channel`` -1) by the channels whose centres lie within ``eps``.

    With one channel around, the row's ``confidence`` must reach ``clear``;
    with several, ``overlap``; with none it stays.  ``likely`` is the
    candidate channel.  Repeats with new centres until few rows change.
    Centres count in their own field of view.
    """
    from lumenframe.runtime import checkpointed

    keys = [k for k in keys if k in rows.columns]
    now = checkpointed(rows)
    for _ in range(rounds):
        free = now.where(F.col("channel") == -1)
        pairs = near_pairs(free.select(*keys, "loc_id", "xc", "yc", "likely"), centres.select(*keys, "channel", "xc", "yc"), eps, on=keys)
        seen = pairs.groupBy(*keys, "loc_id").agg(F.count_distinct("r_channel").alias("n"), F.max((F.col("r_channel") == F.col("likely")).cast("int")).alias("own"))
        won = free.join(seen, [*keys, "loc_id"]).where((F.col("own") == 1) & (F.col("confidence") >= F.when(F.col("n") == 1, clear).otherwise(overlap))).select(*keys, "loc_id", F.col("likely").alias("new__"))
        now = checkpointed(now.join(won, [*keys, "loc_id"], "left").withColumn("channel", F.coalesce("new__", "channel")))
        changed = now.where(F.col("new__").isNotNull()).count()
        now = now.drop("new__")
        if changed < least_new:
            break
        centres = punctum_centres(now.where("channel >= 0"), keys) if "cluster" in now.columns else centres
    return now


def punctum_centres(rows: DataFrame, keys: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Mean position of each punctum of each channel of each field of view."""
    return rows.groupBy(*[k for k in keys if k in rows.columns], "channel", "cluster").agg(F.avg("xc").alias("xc"), F.avg("yc").alias("yc"))


def link_candidates(candidates: DataFrame, n_chunks: int, radius: float, share: float = 0.6, keys: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Tracks of candidates across chunks of a movie, by greedy nearest neighbours.

    ``candidates`` has the keys, ``chunk``, ``candidate_id``, ``x``,
    ``y`` and a few hundred rows for each field of view.  Each candidate is
    used once; tracks seen in ``share`` of the chunks stay.
    """

    def track(rows):
        import pandas as pd

        tracks: list[dict] = []
        for chunk, part in rows.sort_values(["chunk", "candidate_id"]).groupby("chunk"):
            free = list(part.itertuples())
            for t in tracks:
                if not free:
                    break
                d = [math.hypot(c.x - t["x"], c.y - t["y"]) for c in free]
                i = min(range(len(d)), key=d.__getitem__)
                if d[i] <= radius:
                    c = free.pop(i)
                    t |= {"x": c.x, "y": c.y, "members": [*t["members"], (chunk, c.candidate_id, c.x, c.y)]}
            tracks += [{"x": c.x, "y": c.y, "members": [(chunk, c.candidate_id, c.x, c.y)]} for c in free]
        out = [(*[rows[c].iloc[0] for c in keys], k, *m) for k, t in enumerate(tracks) if len(t["members"]) >= share * n_chunks for m in t["members"]]
        return pd.DataFrame(out, columns=[*keys, "track", "chunk", "candidate_id", "x", "y"])

    kinds = dict(candidates.dtypes)
    fields = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    grouped = candidates.groupBy(*keys) if keys else candidates.groupBy(F.lit(0).alias("one__"))
    return grouped.applyInPandas(track, f"{fields}track long, chunk int, candidate_id long, x double, y double")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | Column = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place__", place).where(F.col("place__") <= n).drop("place__")
