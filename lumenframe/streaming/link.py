"""Streaming forms: optimal links with the track table as state, and windows with watermarks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.linking import Tracks

OUT = "fov_index int, loc_id long, frame int, track_id long"
STATE = "open string, waiting string"


def stream_links(locs: DataFrame, d_max: float, dark: int, late_frames: int = 1, **options) -> DataFrame:
    """Optimal links of a stream of localisations, a field of view a key.

    State is the open tracks and the rows of frames not yet complete.  A
    frame is complete once one ``late_frames`` later has been seen; rows
    that come later still are dropped, as those behind a watermark are, and
    the last frames wait for more.  Same links as the batch operator on
    ordered input.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracks, waiting, done = Tracks(d_max, dark, **options), {}, -1
        if state.exists:
            opened, held = state.get
            saved = json.loads(opened)
            done = saved.pop("done")
            for name, value in saved.items():
                setattr(tracks, name, [tuple(v) for v in value] if name in ("places", "colours") else value)
            waiting = {int(f): rows for f, rows in json.loads(held).items()}
        for p in parts:
            for r in p.itertuples(index=False):
                if r.frame > done:
                    waiting.setdefault(int(r.frame), []).append([int(r.loc_id), float(r.xc), float(r.yc), float(r.A_B), float(r.A_G), float(r.A_R)])
        newest = max(waiting, default=done)
        out = []
        for f in sorted(waiting):
            if f > newest - late_frames:
                break
            rows = sorted(waiting.pop(f))
            values = np.array([r[1:] for r in rows])
            out += [(key[0], r[0], f, t) for r, t in zip(rows, tracks.step(f, values[:, :2], values[:, 2:]))]
            done = f
        saved = {"ids": tracks.ids, "seen": [int(s) for s in tracks.seen], "places": [list(map(float, p)) for p in tracks.places], "colours": [list(map(float, c)) for c in tracks.colours], "next_id": tracks.next_id, "done": done}
        state.update((json.dumps(saved), json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["fov_index", "loc_id", "frame", "track_id"])

    rows = locs.select("fov_index", "loc_id", "frame", "xc", "yc", "A_B", "A_G", "A_R")
    return rows.groupBy("fov_index").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sums of windows of event time, for streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Bursts of a key's events, closed by a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
