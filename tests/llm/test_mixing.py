import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing


def plain_targets(sizes):
    """Reshare until no target is above three times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: 3 * sizes[s] for s in over}


def documents(n, seed, sources):
    rnd = random.Random(seed)
    names, shares = zip(*sources)
    return [(i, rnd.choices(names, shares)[0], " ".join(["w"] * rnd.randrange(1, 60))) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [10, 4096])
def test_targets_are_met_and_reruns_agree(spark, bucket_rows):
    rows = documents(3000, 1, [("hot", 60), ("b", 20), ("é", 10), ("Z", 9), (None, 8), ("tiny", 1)]) + [(5000, "b", None), (5001, "empty", ""), (5001, "empty", ""), (None, "b", "one two"), (7, "b", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("name", F.lit("clash")).withColumn("key", F.lit(0))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    targets = {r.source: (r.source_size, r.target) for r in mixing.targets(docs.select("source", F.size(F.split("text", " ")).alias("size")).limit(0).union(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size int"))).collect()}
    assert {s: t for s, (_, t) in targets.items()} == pytest.approx(want)
    got = mixing.mix(docs, bucket_rows=bucket_rows, keep_source=True).collect()
    assert len(got) == len(rows)
    taken, budget = defaultdict(int), sum(sizes.values())
    for r in got:
        source = None if r.name == "n" else r.name[1:]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[source] += r.taken
    assert budget - 60 <= sum(taken.values()) <= budget
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mixing.mix(docs.repartition(5), bucket_rows=bucket_rows, keep_source=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixture.collect()) == pytest.approx(sum(taken.values()), abs=120)


def test_bucket_size_never_changes_the_mix(spark):
    docs = spark.createDataFrame(documents(500, 3, [("a", 5), ("b", 1)]), "doc_id long, source string, text string")
    results = [sorted(map(str, mixing.mix(docs, bucket_rows=n, range_rows=m).collect())) for n, m in ((7, 5), (100, 60), (10000, 10000))]
    assert results[0] == results[1] == results[2]


def test_one_id_on_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    rows = documents(400, 8, [("a", 5), ("b", 1)]) + [(None, "a", "w w w")] * 120 + [(7000, "b", "w w")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, keep_source=True).collect()
    assert len(got) == len(rows)
    assert len({(r.copies, r.first_time) for r in got if r.doc_id is None}) == 1
    assert len({(r.copies, r.first_time) for r in got if r.doc_id == 7000}) == 1
    assert sum(r.taken for r in got) <= sum(len(t.split()) for _, _, t in rows)
    assert mixing.mixture(docs).count() == sum(r.copies for r in got)


def test_empty_tables_and_no_words(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs).count() == 0
