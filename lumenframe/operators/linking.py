"""Linking localisations of consecutive frames.

One field of view is one sequential problem: rows are read in frame order and
the state is the set of tracks still open.  So a field of view (or a group
within it) is one task, and fields run side by side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators import aggregate, filters
from lumenframe.schema import AMPLITUDES, ensure_loc_id


def chain_ids(frame: np.ndarray, x: np.ndarray, y: np.ndarray, d_max: float, dark: int) -> np.ndarray:
    """Chains in table order: a row takes the first later row, not the nearest, that
    is free, at most ``dark + 1`` frames on and within ``d_max``.

    Rows are sorted by frame.  Cells of the search radius hold the free rows.
    """
    out = np.full(len(frame), -1, dtype=np.int64)
    size = max(d_max, 1e-12)
    cells: dict[tuple[int, int], deque[int]] = {}
    cx, cy = np.floor(x / size).astype(int), np.floor(y / size).astype(int)
    for i in range(len(frame)):
        cells.setdefault((cx[i], cy[i]), deque()).append(i)
    chain = 0
    for i in range(len(frame)):
        if out[i] >= 0:
            continue
        at, out[i] = i, chain
        while True:
            best = None
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    rows = cells.get((cx[at] + a, cy[at] + b), ())
                    # rows at or before the chain's first frame can't be taken any more
                    while rows and (out[rows[0]] >= 0 or frame[rows[0]] < frame[i]) and rows[0] <= i:
                        rows.popleft()
                    for j in rows:
                        if frame[j] - frame[at] > dark + 1 or (best is not None and j >= best):
                            break
                        if out[j] < 0 and frame[j] > frame[at] and (x[j] - x[at]) ** 2 + (y[j] - y[at]) ** 2 <= d_max * d_max:
                            best = j
                            break
            if best is None:
                break
            out[best], at = chain, best
        chain += 1
    return out


def link_groups(locs: DataFrame, d_max: float, dark: int, by: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Add ``link_group``, numbered within each of ``by``."""
    locs = ensure_loc_id(locs)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in locs.select(*by).schema)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame", "loc_id"])
        ids = chain_ids(part["frame"].to_numpy(), part["xc"].to_numpy(float), part["yc"].to_numpy(float), d_max, dark)
        return part[[*by, "loc_id"]].assign(link_group=ids)

    narrow = locs.select(*by, "loc_id", "frame", "xc", "yc").groupBy(*by).applyInPandas(link, f"{fields}, loc_id long, link_group long")
    return locs.join(narrow, [*by, "loc_id"])


def link(locs: DataFrame, n_frames: int, d_max: float, dark: int, ambiguous: str | None = "frames", by: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Linked events: chains collapsed to one row each."""
    return aggregate.linked_events(link_groups(locs, d_max, dark, by), n_frames, ambiguous=ambiguous, keys=by)


def molecules_by_link(locs: DataFrame, d_max: float, dark: int, by: Sequence[str] = ("fov_index",), **bounds) -> tuple[DataFrame, DataFrame]:
    """Quality filter, chains, molecule and frame tables."""
    rows = link_groups(filters.quality(locs, **bounds), d_max, dark, by).drop("molecular_index").withColumnRenamed("link_group", "molecular_index")
    return aggregate.molecules(rows, keys=by), rows


def mean_event_length(locs: DataFrame, d_max: float, dark: int, most: int | None = None, by: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Mean number of frames of linked events, the kinetics of the dye; of the first ``most`` rows if given.

    Chains stay within a field of view; a table without ``by`` is one field.
    """
    rows = ensure_loc_id(locs)
    for k in by:
        rows = rows if k in rows.columns else rows.withColumn(k, F.lit(0))
    if most is not None:
        rows = rows.orderBy("frame", "loc_id").limit(most)
    chains = link_groups(rows, d_max, dark, by).groupBy(*by, "link_group").agg((F.max("frame") - F.min("frame") + 1).alias("len"))
    return chains.agg(F.avg("len").alias("mean_length"))


# optimal assignment


@dataclass
class Tracks:
    """Open tracks of one field of view; what a stream keeps between frames."""

    d_max: float
    dark: int
    w_spatial: float = 1.0
    w_spectral: float = 1.0
    tolerance: float = 0.1
    diffusion: float | None = None
    dt: float = 1.0
    next_id: int = 0
    ids: list[int] = field(default_factory=list)
    seen: list[int] = field(default_factory=list)
    places: list[tuple[float, float]] = field(default_factory=list)
    colours: list[tuple[float, ...]] = field(default_factory=list)

    def step(self, frame: int, places: np.ndarray, colours: np.ndarray) -> list[int]:
        """Track ids of one frame's rows; every row gets one.

        Cost is squared distance over the radius plus squared colour distance
        over the tolerance; a pair must cost less than leaving both alone,
        w_spatial + w_spectral.  Colours are made to sum to one first.
        """
        total = colours.sum(axis=1, keepdims=True)
        colours = colours / np.where(total == 0, 1, total)
        live = [i for i, s in enumerate(self.seen) if frame - s <= self.dark + 1]
        for name in ("ids", "seen", "places", "colours"):
            setattr(self, name, [getattr(self, name)[i] for i in live])
        out = [-1] * len(places)
        if self.ids and len(places):
            gap = np.maximum(1, frame - np.array(self.seen))
            radius = np.full(len(self.ids), self.d_max)
            if self.diffusion is not None:
                radius = np.minimum(radius, 3 * np.sqrt(4 * self.diffusion * self.dt * gap))
            spatial = ((np.array(self.places)[:, None] - places[None]) ** 2).sum(axis=2) / np.maximum(radius, 1e-12)[:, None] ** 2
            spectral = ((np.array(self.colours)[:, None] - colours[None]) ** 2).sum(axis=2) / self.tolerance**2
            limit = self.w_spatial + self.w_spectral
            cost = self.w_spatial * spatial + self.w_spectral * spectral
            cost = np.where((spatial <= 1) & (cost < limit), cost, 1e6)
            n, m = cost.shape
            full = np.full((n + m, n + m), 1e6)
            full[:n, :m] = cost
            full[:n, m:][np.arange(n), np.arange(n)] = limit / 2
            full[n:, :m][np.arange(m), np.arange(m)] = limit / 2
            full[n:, m:] = 0.0
            for r, c in zip(*numeric.assign(full)):
                if r < n and c < m and cost[r, c] < limit:
                    out[c] = self.ids[r]
                    self.seen[r], self.places[r], self.colours[r] = frame, tuple(places[c]), tuple(colours[c])
        for c, t in enumerate(out):
            if t < 0:
                out[c] = self.next_id
                self.ids.append(self.next_id)
                self.seen.append(frame)
                self.places.append(tuple(places[c]))
                self.colours.append(tuple(colours[c]))
                self.next_id += 1
        return out


def optimal_links(locs: DataFrame, d_max: float, dark: int, w_spatial: float = 1.0, w_spectral: float = 1.0, tolerance: float = 0.1, colours: Sequence[str] = AMPLITUDES, diffusion: float | None = None, dt: float = 1.0, by: Sequence[str] = ("fov_index",)) -> DataFrame:
    """Add ``track_id`` by optimal assignment of open tracks to each frame's rows."""
    locs = ensure_loc_id(locs)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in locs.select(*by).schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame", "loc_id"])
        tracks, out = Tracks(d_max, dark, w_spatial, w_spectral, tolerance, diffusion, dt), []
        for frame, rows in part.groupby("frame", sort=True):
            out += tracks.step(int(frame), rows[["xc", "yc"]].to_numpy(float), rows[list(colours)].to_numpy(float))
        return part[[*by, "loc_id"]].assign(track_id=out)

    narrow = locs.select(*by, "loc_id", "frame", "xc", "yc", *colours).groupBy(*by).applyInPandas(run, f"{fields}, loc_id long, track_id long")
    return locs.join(narrow, [*by, "loc_id"])


def molecules_by_track(locs: DataFrame, d_max: float, dark: int, min_frames: int = 1, static_eps: float | None = None, static_samples: int = 10, by: Sequence[str] = ("fov_index",), **options) -> tuple[DataFrame, DataFrame]:
    """Static rows out, optimal links, molecules of enough frames, numbered without gaps."""
    from lumenframe.operators import cluster

    locs = ensure_loc_id(locs)
    if static_eps is not None:
        locs = cluster.flag_static(locs, static_eps, static_samples, by).where("NOT is_static").drop("is_static")
    rows = optimal_links(locs, d_max, dark, by=by, **options)
    sizes = rows.groupBy(*by, "track_id").agg(F.count("*").alias("n__")).where(F.col("n__") >= min_frames)
    numbered = sizes.withColumn("molecular_index", F.row_number().over(Window.partitionBy(*by).orderBy("track_id")) - 1).drop("n__")
    rows = rows.drop("molecular_index").join(numbered, [*by, "track_id"]).drop("track_id")
    return aggregate.molecules(rows, keys=by), rows


def track_statistics(rows: DataFrame, label: str = "track_id", by: Sequence[str] = ("fov_index",), colour: str = "A_R") -> DataFrame:
    """Length and colour spread of each track; single rows have no spread and go."""
    return rows.groupBy(*by, label).agg(F.count("*").alias("n"), F.stddev_samp(colour).alias("colour_std")).where("colour_std IS NOT NULL")
