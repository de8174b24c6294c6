import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import toxicity

CLEAN = ["river", "stone", "garden", "walk", "evening", "muslim", "christian", "bridge", "bread", "song", "window", "letter"]
BAD = ["awfulword", "nastyterm", "vilething"]


def corpus(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.3
        words = [rnd.choice(CLEAN) for _ in range(rnd.randrange(5, 40))]
        if toxic:
            # one group is over-represented among the toxic texts
            words += [rnd.choice(BAD) + rnd.choice(["", "xy", "q"]), "muslim" if rnd.random() < 0.9 else "christian"]
        rnd.shuffle(words)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "vilething")], "doc_id long, text string").withColumn("source", F.lit("s"))
    marks = spark.createDataFrame(labels + [(1, None), (None, 1), (1, labels[1][1])], "doc_id long, toxic int")
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == 903
    known = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert len(held) > 200 and sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.2 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    again = {r.doc_id: r.score for r in toxicity.classify(docs.repartition(7), marks).collect()}
    assert all(abs(again[i] - by[i].score) < 1e-9 for i in again)
    kept = toxicity.keep(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.7 for r in got)


def test_the_penalty_evens_out_groups(spark):
    rows, labels = corpus(900, 2)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    a, b = (model.score({"a", "quiet", g, "garden"}) for g in ("muslim", "christian"))
    assert abs(a - b) < 0.05
    # without the penalty the group that toxic texts mention scores higher
    rows_, y = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], dtype=int)] * 10, np.array([1, 1, 0, 0] * 10, dtype=float)
    free = toxicity.fit_logistic(rows_, y, 2, [])[1]
    tied = toxicity.fit_logistic(rows_, y, 2, [(np.array([1]), np.array([0]), 1.0)])[1]
    assert free[0] - free[1] > 3 and abs(tied[0] - tied[1]) < 0.3


def test_the_sparse_fit_is_the_dense_one():
    rng = np.random.default_rng(5)
    x = (rng.random((200, 6)) < 0.4).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0, -2.0]) - 0.5)))).astype(float)
    pairs = [(np.array([0]), np.array([1]), 0.5), (np.array([2, 3]), np.array([], dtype=int), 0.3), (np.array([], dtype=int), np.array([5]), 0.2)]
    ridge, fairness = 1e-3, 0.2
    bias, w = toxicity.fit_logistic([np.flatnonzero(r) for r in x], y, 6, pairs, ridge, fairness)
    # Newton's method on the plain matrices
    full = np.hstack([np.ones((200, 1)), x])
    d = np.zeros((3, 7))
    d[0, 1], d[0, 2], d[1, 3], d[1, 4], d[2, 6] = 1, -1, 1, 1, -1
    share, v = np.diag([0.5, 0.3, 0.2]), np.zeros(7)
    tied = np.diag([0.0] + [ridge] * 6) + 2 * fairness * d.T @ share @ d
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ v))
        v = v - np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) / 200 + tied, full.T @ (p - y) / 200 + tied @ v)
    assert np.allclose([bias, *w], v, atol=1e-3)


def test_clean_words_can_lower_a_score(spark):
    rnd = random.Random(4)
    toxic = [(i, f"vilething {rnd.choice(CLEAN)} {rnd.choice(['doubt', 'x'])}") for i in range(0, 300)]
    clean = [(i, f"{rnd.choice(CLEAN)} {rnd.choice(CLEAN)} sources cited") for i in range(300, 600)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 300)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert model.score({"vilething"}) > 0.9 > model.score({"vilething", "sources", "cited"})
    assert abs(model.score({"muslim"}) - model.score({"christian"})) < 1e-3


def test_swaps_change_the_named_group_only():
    out = toxicity.swaps("A muslim baker. No one here.")
    assert len(out) == len(toxicity._PEERS["muslim"])
    for gained, lost in out:
        assert lost == toxicity.features_of("muslim") and len(gained) == 1
    assert toxicity.swaps("nobody") == [] == toxicity.swaps(None)


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "vilething")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(docs, none).first().predicted == 0
    one = spark.createDataFrame([(0, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs, one).first().predicted == 0
    assert toxicity.classify(docs.limit(0), none).count() == 0
