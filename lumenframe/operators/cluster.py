"""Spatial clustering: density clusters, joint clusters, a density hierarchy, image regions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators import aggregate, filters, linking
from lumenframe.operators.regions import near_pairs
from lumenframe.runtime import checkpointed, components, hot_join
from lumenframe.schema import ensure_loc_id


def _numbered(labelled: DataFrame, keys: Sequence[str], label: str, out: str) -> DataFrame:
    """Replace labels (null: noise) by 0, 1, ... within keys, in the order of the labels."""
    distinct = labelled.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    order = Window.partitionBy(*keys).orderBy(label)
    ids = distinct.withColumn(out, F.row_number().over(order) - 1)
    return labelled.join(ids, [*keys, label], "left").withColumn(out, F.coalesce(out, F.lit(-1)).cast("long")).drop(label)


def with_field(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``field__``: fields of view (a row each) numbered from 0 in the order of ``keys``, of whatever type."""
    if not keys:
        return rows.withColumn("field__", F.lit(0).cast("long"))
    names = rows.select(*[F.col(k).alias(f"k__{k}") for k in keys]).distinct()
    names = checkpointed(names.withColumn("field__", F.row_number().over(Window.orderBy(*[f"k__{k}" for k in keys])).cast("long") - 1))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k__{k}"))
    return rows.join(names, same).drop(*[f"k__{k}" for k in keys])


#: Ids of rows stay below; a node's number is its field's times this plus the row's.
ID_STEP = 1 << 42


def _nodes(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Rows as nodes of a graph: ``node`` is unique over the fields of view, ``loc_id`` only within one."""
    fine = F.assert_true(F.col("loc_id").between(0, ID_STEP - 1), F.lit("loc_id is out of range"))
    node = F.col("field__") * F.lit(ID_STEP) + F.col("loc_id") + F.coalesce(fine.cast("long"), F.lit(0))
    return checkpointed(with_field(rows.select(*keys, "loc_id", *columns), keys).withColumn("node", node).drop("field__"))


def dbscan(locs: DataFrame, eps: float, min_samples: int, keys: Sequence[str] = ("fov_index",), out: str = "cluster_id") -> DataFrame:
    """Density clusters in ``out``, -1 for noise.

    A row with ``min_samples`` rows within ``eps``, itself included, is a
    core; cores within ``eps`` of each other share a cluster; a border row
    joins the cluster of its nearest core (ties: the smallest id), which
    makes the result independent of the order of rows.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    rows = ensure_loc_id(locs)
    points = _nodes(rows, keys, "xc", "yc")
    place = points.select(*keys, "node", "xc", "yc")
    pairs = checkpointed(near_pairs(place, place, eps, on=keys).select("node", F.col("r_node").alias("other"), "distance"))
    cores = checkpointed(pairs.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("node"))
    from_core = hot_join(pairs, cores, "node", "left_semi")
    edges = hot_join(from_core.select("node", F.col("other").alias("o")), cores.withColumnRenamed("node", "o"), "o", "left_semi")
    roots = components(edges.where("node < o").select(F.col("node").alias("a"), F.col("o").alias("b")))
    core_labels = checkpointed(hot_join(cores, roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    reached = hot_join(from_core, core_labels, "node")
    best = reached.groupBy("other").agg(F.min(F.struct("distance", "node", "root")).alias("best")).select(F.col("other").alias("node"), F.col("best.root").alias("root__"))
    label = hot_join(points.select(*keys, "loc_id", "node"), best, "node").drop("node")
    return _numbered(rows.join(label, [*keys, "loc_id"], "left"), keys, "root__", out)


def flag_static(locs: DataFrame, eps: float, min_samples: int, keys: Sequence[str] = ("fov_index",)) -> DataFrame:
    """``is_static``: the row lies in some density cluster."""
    return dbscan(locs, eps, min_samples, keys, "static__").withColumn("is_static", F.col("static__") >= 0).drop("static__")


def joint_clusters(locs: DataFrame, d: float, least: int, spatial: Sequence[str] = ("xc", "yc"), spectral: Sequence[str] = ("A_R", "A_G"), keys: Sequence[str] = ("fov_index",), out: str = "cluster_id") -> DataFrame:
    """Clusters in position and colour together, -1 for small ones.

    Candidates lie within d * sqrt(2) * median position error; a pair links
    if the sum over axes of (difference / combined error)^2 is below d^2.
    """
    rows = ensure_loc_id(locs)
    median = aggregate.exact_percentile(rows, f"{spatial[0]}_err")
    if median is None:
        return rows.withColumn(out, F.lit(-1).cast("long"))
    axes = [*spatial, *spectral]
    errors = [f"{c}_err" for c in axes]
    points = _nodes(rows, keys, *axes, *errors)
    place = points.drop("loc_id")
    pairs = near_pairs(place, place, d * math.sqrt(2) * median, on=keys, x=spatial[0], y=spatial[1]).where("node < r_node")
    squared = sum(((F.col(c) - F.col(f"r_{c}")) ** 2 / (F.col(f"{c}_err") ** 2 + F.col(f"r_{c}_err") ** 2) for c in axes), F.lit(0.0))
    edges = pairs.where(squared < d * d).select(F.col("node").alias("a"), F.col("r_node").alias("b"))
    rooted = hot_join(points.select(*keys, "loc_id", "node"), components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n__")).where(F.col("n__") >= least)
    label = hot_join(rooted, sizes, "root").select(*keys, "loc_id", F.col("root").alias("root__"))
    return _numbered(rows.join(label, [*keys, "loc_id"], "left"), keys, "root__", out)


def hierarchy_labels(points: np.ndarray, least: int, eps: float = 0.0) -> np.ndarray:
    """Clusters of the condensed density hierarchy, by excess of mass.

    Mutual reachability distances, their minimum spanning tree, the tree of
    merges with branches under ``least`` points left out, and the branches of
    largest stability; branches born below ``eps`` are merged into their
    parents.  Memory is linear: distances are computed a row at a time.
    """
    n = len(points)
    if n < max(2, least):
        return np.full(n, -1, dtype=np.int64)
    k = min(least, n) - 1
    core = np.empty(n)
    for i in range(n):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        core[i] = np.partition(d, k)[k]
    # Prim's algorithm
    reach, link, inside = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(np.sqrt(((points - points[at]) ** 2).sum(axis=1)), core), core[at])
        closer = ~inside & (d < reach)
        reach[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(inside, np.inf, reach)))
        edges.append((reach[at], link[at], at))
    edges.sort()
    # merges, as a binary tree over 2n - 1 nodes
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    left, right, height = [0] * (2 * n - 1), [0] * (2 * n - 1), [0.0] * (2 * n - 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j, (w, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + j
        parent[a] = parent[b] = new
        left[new], right[new], height[new], size[new] = a, b, w, size[a] + size[b]

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [left[x], right[x]]
        return out

    # condense
    born, stability, children, members = [0.0], [0.0], [[]], [2 * n - 2]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        while node >= n:
            lam = 1.0 / max(height[node], 1e-12)
            a, b = left[node], right[node]
            big = [x for x in (a, b) if size[x] >= least]
            stability[c] += (lam - born[c]) * (size[node] if len(big) != 1 else size[a] + size[b] - size[big[0]])
            if len(big) == 1:
                node = big[0]
                continue
            for x in big:
                born.append(lam)
                stability.append(0.0)
                children.append([])
                members.append(x)
                children[c].append(len(born) - 1)
                stack.append((x, len(born) - 1))
            break
    chosen = [False] * len(born)
    best = [0.0] * len(born)
    for c in range(len(born) - 1, -1, -1):
        below = sum(best[x] for x in children[c])
        close = bool(children[c]) and eps > 0 and all(1.0 / born[x] < eps for x in children[c])
        if c > 0 and (not children[c] or stability[c] >= below or close):
            chosen[c], best[c] = True, max(stability[c], below)
        else:
            best[c] = below
    labels, number, stack = np.full(n, -1, dtype=np.int64), 0, [0]
    while stack:
        c = stack.pop()
        if chosen[c]:
            labels[leaves(members[c])] = number
            number += 1
        else:
            stack += children[c][::-1]
    return labels


def hdbscan(locs: DataFrame, least: int, eps: float | None = None, keys: Sequence[str] = ("fov_index",), out: str = "cluster_id") -> DataFrame:
    """Clusters of the density hierarchy of each field of view.

    ``eps`` defaults to the field's mean position error.  One field is one
    task, with work quadratic in its rows.
    """
    rows = ensure_loc_id(locs)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near = eps if eps is not None else float((part["xc_err"].mean() + part["yc_err"].mean()) / 2)
        part = part.sort_values("loc_id")
        return part[[*keys, "loc_id"]].assign(**{out: hierarchy_labels(part[["xc", "yc"]].to_numpy(float), least, near)})

    errors = [c for c in ("xc_err", "yc_err") if c in rows.columns]
    narrow = rows.select(*keys, "loc_id", "xc", "yc", *errors).groupBy(*keys).applyInPandas(run, f"{fields}, loc_id long, `{out}` long")
    return rows.join(narrow, [*keys, "loc_id"])


def mean_error_eps(locs: DataFrame, multiplier: float = 1.0) -> float:
    """Mean localisation error times a factor; must be positive."""
    eps = locs.agg(F.avg((F.col("xc_err") + F.col("yc_err")) / 2)).first()[0]
    eps = (eps or 0.0) * multiplier
    if eps <= 0:
        raise ValueError("the mean localisation error is not positive")
    return eps


def molecules_by_dbscan(locs: DataFrame, min_samples: int, multiplier: float = 1.0, keys: Sequence[str] = ("fov_index",), **bounds) -> tuple[DataFrame, DataFrame]:
    rows = filters.quality(locs, **bounds)
    return _finish(dbscan(rows, mean_error_eps(rows, multiplier), min_samples, keys), keys)


def molecules_by_hdbscan(locs: DataFrame, least: int, keys: Sequence[str] = ("fov_index",), **bounds) -> tuple[DataFrame, DataFrame]:
    return _finish(hdbscan(filters.quality(locs, **bounds), least, None, keys), keys)


def _finish(labelled: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    frames = labelled.where("cluster_id >= 0").drop("molecular_index").withColumnRenamed("cluster_id", "molecular_index")
    return aggregate.molecules(frames, keys=keys), frames


METHODS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {
    "DBSCAN": molecules_by_dbscan,
    "HDBSCAN": molecules_by_hdbscan,
    "LINKED": linking.molecules_by_link,
    "OPTIMAL": linking.molecules_by_track,
}


def filter_and_cluster(locs: DataFrame, method: str, **options) -> tuple[DataFrame, DataFrame]:
    """Molecule and frame tables by the named method."""
    if method.upper() not in METHODS:
        raise ValueError(f"unknown clustering method {method}; known: {', '.join(METHODS)}")
    return METHODS[method.upper()](locs, **options)


def seed_clusters(assigned: DataFrame, eps: float, least: int) -> DataFrame:
    """Density clusters of each channel; ids are channel * 100000 + cluster, or a larger step if a channel has more clusters."""
    rows = checkpointed(dbscan(assigned.where("channel >= 0"), eps, least, ("fov_index", "channel"), "cluster"))
    step = max(100_000, (rows.agg(F.max("cluster")).first()[0] or 0) + 1)
    return rows.withColumn("cluster", F.when(F.col("cluster") >= 0, F.col("channel") * F.lit(step).cast("long") + F.col("cluster")).otherwise(F.lit(-1)))


def image_regions(locs: DataFrame, width: float, height: float, oversampling: float = 8.0, threshold: str = "percentile", least_pixels: int = 1, least_rows: int = 1, keys: Sequence[str] = ("fov_index",)) -> tuple[DataFrame, DataFrame]:
    """Regions of a rendered histogram: rows with ``aggregate_id`` (-1 outside), and statistics.

    The threshold comes from the histogram's pixel counts (Otsu, Li, or their
    95th percentile); pixels above it are joined to regions with their
    neighbours as a graph, so no image is held anywhere.
    """
    at = {"px": F.floor(F.col("xc") * oversampling).cast("long"), "py": F.floor(F.col("yc") * oversampling).cast("long")}
    rows = locs.withColumns(at)
    inside = (F.col("xc") > 0) & (F.col("xc") < width) & (F.col("yc") > 0) & (F.col("yc") < height)
    pixels = checkpointed(rows.where(inside).groupBy(*keys, "py", "px").agg(F.count("*").alias("value")))
    limit = count_threshold(pixels, threshold)
    wide = int(math.ceil(width * oversampling)) + 1
    area = wide * (int(math.ceil(height * oversampling)) + 1)
    bright = with_field(pixels.where(F.col("value") > limit), keys)
    bright = checkpointed(bright.withColumn("id", F.col("field__") * F.lit(area).cast("long") + F.col("py") * wide + F.col("px")).drop("field__"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    side = bright.select(*keys, F.col("id").alias("a"), "py", "px", steps.alias("s")).select(*keys, "a", (F.col("py") + F.col("s.dy")).alias("py"), (F.col("px") + F.col("s.dx")).alias("px"))
    edges = side.join(bright.select(*keys, "py", "px", F.col("id").alias("b")), [*keys, "py", "px"]).select("a", "b")
    roots = components(edges)
    labelled = hot_join(bright, roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = labelled.groupBy("root").agg(F.count("*").alias("area"), F.sum("value").alias("rows__")).where((F.col("area") >= least_pixels) & (F.col("rows__") >= least_rows))
    kept = hot_join(labelled, sizes, "root").select(*keys, "py", "px", F.col("root").alias("root__"))
    member = rows.join(kept, [*keys, "py", "px"], "left").drop("px", "py")
    member = _numbered(member, keys, "root__", "aggregate_id")
    stats = [F.count("*").alias("n_locs")]
    for c in ("xc", "yc", "A_R", "A_G", "A_B"):
        if c in locs.columns and f"{c}_err" in locs.columns:
            mean, error = aggregate.inverse_error_mean(F.col(c), F.col(f"{c}_err"))
            stats += [mean.alias(c), error.alias(f"{c}_err")]
    if "photons" in locs.columns:
        stats.append(F.sum("photons").alias("photons"))
    return member, member.where("aggregate_id >= 0").groupBy(*keys, "aggregate_id").agg(*stats)


def count_threshold(pixels: DataFrame, method: str) -> float:
    """A threshold from the distribution of pixel counts, which has few distinct values."""
    if method == "percentile":
        found = pixels.agg(F.percentile("value", F.lit(0.95))).first()[0]
        return float(found) if found is not None else 0.0
    top = pixels.agg(F.max("value"), F.min("value")).first()
    if top[0] is None:
        return 0.0
    bins = pixels.groupBy(aggregate.bin_index(F.col("value").cast("double"), float(top[1]), float(max(top[0], top[1] + 1)), 256).alias("bin")).agg(F.avg("value").alias("v"), F.count("*").alias("n")).orderBy("bin").collect()
    values = np.repeat([float(r.v) for r in bins], [max(1, round(r.n / sum(x.n for x in bins) * 100_000)) for r in bins])
    return numeric.otsu(values) if method == "otsu" else numeric.li(values)
