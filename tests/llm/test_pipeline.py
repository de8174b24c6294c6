import itertools
import random

from lumenframe.llm import pieces, quality, simhash
from tests.llm.test_mixing import plain_targets

import corpus_pipeline


def test_stages_against_the_plain_way(spark, tmp_path):
    rnd = random.Random(7)
    vocabulary = [a + b for a in "ka re mi to lu".split() for b in "na so vi pe du zo".split()]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(160):
        body = text(rnd.randrange(60, 120))
        if i % 8 == 0:
            body += " hatefulword really hatefulword"
        rows.append((i, body, "en", rnd.choice(["a", "b", "c"]), len(body)))
    rows += [(200 + i, rows[1][1], "en", "a", 0) for i in range(20)] + [(300, "too few", "en", "a", 0), (301, text(60).replace(" ", " ### "), "en", "b", 0), (302, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 0)) for i in range(160) if i != 16]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept[name] = now.collect()
        now = spark.createDataFrame(kept[name], docs.schema)
    passing = {r[0] for r in rows if 100 * quality.measure((r[1] or "").encode())[5] <= 50 * quality.measure((r[1] or "").encode())[0] and len((r[1] or "").split()) >= 50 and "###" not in (r[1] or "")}
    assert {r.doc_id for r in kept["quality_rules"]} == passing
    assert {r.doc_id for r in kept["non_toxic"]} == {i for i in passing if i >= 160 or i % 8}
    prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in kept["non_toxic"]}
    gone = set()
    parent = {i: i for i in prints}
    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
    gone = {i for i in parent if parent[i] != i}
    assert len(gone) >= 20 and {r.doc_id for r in kept["near_duplicates"]} == prints.keys() - gone
    sizes, taken = {}, {}
    for r in kept["near_duplicates"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in kept["source_mix"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken[s] - t) <= 120 for s, t in plain_targets(sizes).items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept["source_mix"] for _ in range(2))
    v = pieces.vocabulary(open(corpus_pipeline.tokenizer_path(), "rb").read())
    texts = {r[0]: r[1] for r in rows}
    assert all(v.decode(r.ids).decode() == texts[r.doc_id] for r in out)
