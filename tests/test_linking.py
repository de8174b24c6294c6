import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import aggregate, cluster, linking


def tracks(rng, missing=None):
    """Three molecules whose colours cross."""
    rows = []
    for f in range(20):
        for true, (x, y, colour) in enumerate([(5 + 0.5 * f, 10.0, (0.7, 0.2, 0.1)), (15 - 0.5 * f, 10.0, (0.15, 0.7, 0.15)), (10.0, 5.0, (0.1, 0.15, 0.75))]):
            if (f, true) == missing:
                continue
            c = np.array(colour) + rng.normal(0, 0.02, 3)
            rows.append((0, len(rows), f, true, x + rng.normal(0, 0.05), y + rng.normal(0, 0.05), *map(float, c)))
    return rows


@pytest.mark.parametrize("missing, dark", [(None, 0), ((10, 2), 2)])
def test_optimal_links_keep_crossing_molecules_apart(spark, missing, dark):
    rows = tracks(np.random.default_rng(42), missing)
    df = spark.createDataFrame(rows, "fov_index int, loc_id long, frame int, true_id int, xc double, yc double, A_R double, A_G double, A_B double")
    out = linking.optimal_links(df, 1.5, dark, tolerance=0.2, colours=("A_R", "A_G", "A_B"))
    assert out.select("track_id").distinct().count() == 3
    best = out.groupBy("track_id", "true_id").count().groupBy("track_id").agg(F.max("count").alias("m")).agg(F.sum("m")).first()[0]
    assert best / len(rows) >= 0.95


def plain_chain(frame, x, y, d, dark):
    out, chain = [-1] * len(frame), 0
    for i in range(len(frame)):
        if out[i] >= 0:
            continue
        at, out[i] = i, chain
        while True:
            found = next((j for j in range(at + 1, len(frame)) if out[j] < 0 and 0 < frame[j] - frame[at] <= dark + 1 and (x[j] - x[at]) ** 2 + (y[j] - y[at]) ** 2 <= d * d), None)
            if found is None:
                break
            out[found], at = chain, found
        chain += 1
    return out


@pytest.mark.parametrize("dark", [0, 1, 3])
def test_chains_take_the_first_row(dark):
    rng = np.random.default_rng(dark)
    frame = np.sort(rng.integers(0, 30, 200))
    x, y = rng.uniform(0, 6, 200), rng.uniform(0, 6, 200)
    assert linking.chain_ids(frame, x, y, 1.0, dark).tolist() == plain_chain(frame, x, y, 1.0, dark)


def test_events_at_the_movies_ends_are_dropped(spark):
    rows = [(0, i, f, 1.0, 1.0, g, 10.0, e) for i, (f, g, e) in enumerate([(0, 0, 0.1), (1, 0, 0.1), (3, 1, 0.0), (4, 1, 0.2), (8, 2, 0.1), (9, 2, 0.1)])]
    df = spark.createDataFrame(rows, "fov_index int, loc_id long, frame int, xc double, yc double, link_group long, photons double, xc_err double")
    out = aggregate.linked_events(df, 10, keys=("fov_index",)).collect()
    assert [(r.link_group, r.len, r.n, r.photons) for r in out] == [(1, 2, 2, 20.0)]
    assert aggregate.linked_events(df, 10, ambiguous="movie", keys=("fov_index",)).count() == 2
    assert aggregate.linked_events(df, 10, ambiguous=None, keys=("fov_index",)).count() == 3


def plain_dbscan(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label = [-1] * n
    k = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = k
        while stack:
            a = stack.pop()
            for b in near[a]:
                if core[b] and label[b] < 0:
                    label[b] = k
                    stack.append(b)
        k += 1
    for i in range(n):
        if not core[i]:
            cores = [(math.dist(points[i], points[j]), j) for j in near[i] if core[j]]
            if cores:
                label[i] = label[min(cores)[1]]
    return label


def test_density_clusters(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (3, 0), (0, 4))] + [rng.uniform(-2, 6, (30, 2))])
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "fov_index int, loc_id long, xc double, yc double")
    got = [r.cluster_id for r in cluster.dbscan(df, 0.4, 5).orderBy("loc_id").collect()]
    assert got == plain_dbscan(pts.tolist(), 0.4, 5)
    with pytest.raises(ValueError):
        cluster.dbscan(df, 0.0, 5)
    assert cluster.dbscan(df.limit(0), 0.4, 5).count() == 0


def test_hierarchy_finds_blobs(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 5), (10, 0))])
    labels = cluster.hierarchy_labels(pts, 10)
    assert all(len(set(labels[a : a + 60]) - {-1}) == 1 for a in (0, 60, 120)) and len(set(labels) - {-1}) == 3
    assert (cluster.hierarchy_labels(pts[:5], 10) == -1).all()


def test_regions_of_a_rendered_image(spark):
    rng = np.random.default_rng(42)
    rows = []
    for (cx, cy), s in (((50, 50), 2.0), ((150, 150), 3.0), ((100, 200), 1.5)):
        for _ in range(500):
            rows.append((0, len(rows), int(rng.integers(0, 1000)), float(rng.normal(cx, s)), float(rng.normal(cy, s)), float(rng.uniform(0.5, 1.5)), float(rng.uniform(0.5, 1.5)), float(rng.uniform(1000, 5000))))
    df = spark.createDataFrame(rows, "fov_index int, loc_id long, frame int, xc double, yc double, xc_err double, yc_err double, photons double")
    for threshold in ("percentile", "otsu", "li"):
        member, stats = cluster.image_regions(df, 250.0, 250.0, 0.5, threshold, least_rows=50)
        found = stats.collect()
        assert 1 <= len(found) <= 3 and member.count() == len(rows)
        for s in found:
            assert min(math.hypot(s.xc - a, s.yc - b) for a, b in ((50, 50), (150, 150), (100, 200))) < 3


def test_joint_clusters_need_colour_too(spark):
    rows = []
    for i in range(20):
        rows.append((0, i, 10.0 + 0.01 * (i % 3), 10.0, 0.1, 0.1, 0.3 if i < 10 else 0.7, 0.3, 0.02, 0.02))
    df = spark.createDataFrame(rows, "fov_index int, loc_id long, xc double, yc double, xc_err double, yc_err double, A_R double, A_G double, A_R_err double, A_G_err double")
    got = {r.loc_id: r.cluster_id for r in cluster.joint_clusters(df, 2.0, 3).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[i] for i in range(10, 20)} == {1}
    assert set(r.cluster_id for r in cluster.joint_clusters(df, 2.0, 11).collect()) == {-1}


def test_ids_that_begin_again_in_each_field(spark):
    """Row ids are a field's own: equal ids of two fields never meet, and fields may have names."""
    rows = [(f, i, 10.0 + 0.01 * i + 50 * (i >= 6) * (f == "b"), 10.0) for f in "ab" for i in range(12)]
    df = spark.createDataFrame(rows, "fov_name string, loc_id long, xc double, yc double")
    got = {}
    for r in cluster.dbscan(df, 0.05, 3, ("fov_name",)).collect():
        got.setdefault(r.fov_name, {}).setdefault(r.cluster_id, set()).add(r.loc_id)
    assert got["a"] == {0: set(range(12))} and got["b"] == {0: set(range(6)), 1: set(range(6, 12))}
    member, stats = cluster.image_regions(df.withColumn("part", F.lit("x")), 100.0, 100.0, 1.0, least_rows=2, keys=("fov_name", "part"))
    assert member.count() == 24 and {r.fov_name for r in stats.collect()} <= {"a", "b"}


def test_event_lengths_stay_in_their_field(spark):
    rows = [(f, f * 100 + n, n, 5.0, 5.0) for f in (0, 1) for n in range(10 * f, 10 * f + 10)]
    df = spark.createDataFrame(rows, "fov_index int, loc_id long, frame int, xc double, yc double")
    assert linking.mean_event_length(df, 0.5, 0).first()[0] == 10.0
    assert linking.mean_event_length(df, 0.5, 0, most=5).first()[0] == 5.0
