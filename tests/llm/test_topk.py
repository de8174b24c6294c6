import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import topk


def brute(vectors, queries, k):
    out = set()
    for qi, q in queries:
        hits = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qi and len(v) == len(q))
        out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])}
    return out


def whole(rows):
    return [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("k", [1, 20])
def test_against_brute_force_with_ties_and_bad_rows(spark, k):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)] + [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2020, [float("nan")] * 6), (2040, [float("inf")] * 6), (None, [1.0] * 6), (3000, [0.1, 0.2]), (3020, [0.3, 0.4]), (4000, []), (4001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    vectors = topk.whole_vectors(df, "vec_id", "embedding")
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("id % 20 = 0"), k=k, shard_rows=64, query_block=8).collect()}
    own = whole(rows)
    assert got == brute(own, [(i, v) for i, v in own if i % 20 == 0], k)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_repeated_rows_and_few_candidates(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 20 = 0")).collect())
    assert got == [(20, 1, 1, 4096), (20, 2, 1, 4096)]


def test_of_rows_with_one_id_the_smallest_vector_asks(spark):
    rows = [(20, [2.0, 0.0]), (20, [1.0, 5.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    for parts in (1, 4):
        again = vectors.repartition(parts)
        got = sorted(tuple(r) for r in topk.top_k(again, again.where("id % 20 = 0")).collect())
        assert got == [(20, 1, 1, 6 * 4096), (20, 2, 2, 3 * 4096)]


def test_queries_skip_cells_and_a_hot_cell_is_dealt(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.05).tolist()) for i in range(4000)] + [(10_000 + i, centres[0].tolist()) for i in range(2000)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    sent: dict = {}
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("id % 20 = 0 AND id < 4000"), k=5, shard_rows=100, query_block=32, sent=sent).collect()}
    own = whole(rows)
    assert got == brute(own, [(i, v) for i, v in own if i % 20 == 0 and i < 4000], 5)
    assert sent["searched"] < sent["all"] / 2


def test_cells_cover_space():
    rng = np.random.default_rng(3)
    rows = {3: rng.normal(size=(500, 3)), 2: rng.normal(size=(100, 2)), 0: np.zeros((4, 0))}
    cells = topk.Cells(rows, 64)
    for d, v in rows.items():
        at = cells.of(d, v)
        assert at.min() >= 0 and at.max() < cells.n and len(np.unique(at)) > (d > 0)
    assert (cells.of(7, np.zeros((2, 7))) == cells.rest).all()


def test_pruning_keeps_the_result_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, size=(30, 8))
    rows = (centres[rng.integers(0, 30, 3000)] + rng.integers(-2, 3, size=(3000, 8))).astype(float)
    tree = topk.KDTree(np.arange(3000), rows, leaf=32)
    q = rows[:50]
    at, ids, score = tree.search(np.arange(50), q, 10, np.full(50, -np.inf))
    want = brute([(i, list(map(int, r))) for i, r in enumerate(rows)], [(i, list(map(int, r))) for i, r in enumerate(q)], 10)
    assert {(int(a), int(i), int(s)) for a, i, s in zip(at, ids, score)} == {(a, i, s) for a, _, i, s in want}
    for low, high, cuts in zip(tree.low, tree.high, tree.cuts):
        for lo, hi, a, b in zip(low, high, cuts[:-1], cuts[1:]):
            assert (tree.rows[a:b] >= lo).all() and (tree.rows[a:b] <= hi).all()


def test_large_numbers_are_exact():
    big = 2.0**40
    table = lambda ids, v: pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array(v, pa.list_(pa.float64()))})
    got = topk.search_shard(table([1], [[big, 1.0]]), table([1, 2, 3], [[big, big], [big, 3.0], [big, 2.0]]), 2, np.full(1, -np.inf))
    assert list(zip(*got)) == [(1, 2, 2**63 - 1 if 2**80 > 2**63 else 0), (1, 3, 2**63 - 1)]
    small = topk.search_shard(table([1], [[2.0**30, 1.0]]), table([2, 3], [[2.0**30, 3.0], [2.0**30, 4.0]]), 2, np.full(1, -np.inf))
    assert list(zip(*small)) == [(1, 3, 2**60 + 4), (1, 2, 2**60 + 3)]
