import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import simhash
from lumenframe.llm.common import components


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


TEXTS = [None, "", " \t\n", "a", "A", "a b", "one two three", "One\u00a0two three  four", "É é ß", "x " * 5000, "one two three four five six seven " * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_the_same_hash_as_sparks(spark):
    word = "straße ok word"
    assert spark.sql("select xxhash64('straße ok word') as h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(word.encode(), 42)


def test_links_find_every_pair_within_two_bits(spark):
    rnd = random.Random(3)
    values = {0, 1, 3, -1, -(1 << 63), (1 << 63) - 1, 1 << 62}
    for _ in range(40):
        v = rnd.getrandbits(64) - (1 << 63)
        for _ in range(rnd.randrange(6)):
            values.add(v)
            v ^= (1 << rnd.randrange(63)) | (1 << rnd.randrange(63))
        values.add(v ^ (-(1 << 63)))
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(apart(a, b) <= 2 for a, b in edges)
    near = [(a, b) for a, b in itertools.combinations(values, 2) if apart(a, b) <= 2]
    assert near and roots(values, near) == roots(values, edges)


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + list(itertools.combinations(range(300, 308), 2)) + [(7, 7), (-3, 9), (9, -3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert {n: r for n, r in want.items() if n != r} == {n: r for n, r in got.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_with_nulls_ties_and_repeats(spark):
    long = "lorem ipsum dolor sit amet " * 60
    rows = [(3, long), (1, long), (None, long), (4, None), (2, ""), (9, "something else entirely here"), (9, "something else entirely here"), (None, "only null id here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("hash__", F.lit(1))
    prints = docs.select("doc_id", simhash.fingerprint_column(F.col("text")).alias("fp"))
    got = sorted((r.component_id is None, r.component_id, r.doc_id is None, r.doc_id) for r in simhash.near_duplicates(prints).collect())
    fingerprints = [plain_fingerprint(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 2]
    group = roots(range(len(rows)), near)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[group[i]] = min((x for x in (least.get(group[i]), d) if x is not None), default=None)
    assert got == sorted((least[group[i]] is None, least[group[i]], d is None, d) for i, (d, _) in enumerate(rows))
    clash = prints.withColumn("root", F.lit(5)).withColumn("component_id", F.lit("clash"))
    assert sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(clash).collect()) == sorted(str((d, least[group[i]])) for i, (d, _) in enumerate(rows))
    kept = simhash.near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 9), (True, None)]


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {" ".join(words)} if words else set()


def plain_jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_planted_edited_copies_go(spark, crowd):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, least = [(0, None), (1, " "), (2, "few words"), (None, "few words")], {}
    for g in range(40):
        base = [word() for _ in range(rnd.randrange(80, 300))]
        rows.append((g * 100 + 10, " ".join(base)))
        for c in range(30 if g == 0 else 3):
            copy = list(base)
            for _ in range(rnd.randrange(1, len(base) // 40 + 2)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((g * 100 + 11 + c, " ".join(copy)))
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if plain_jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert sum(plain_jaccard(rows[a][1], rows[b][1]) < 0.9 for a, b in near) > 50
    group = roots(range(len(rows)), near)
    for k, (d, _) in enumerate(rows):
        least[group[k]] = min((x for x in (least.get(group[k]), d) if x is not None), default=None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash__", F.lit(1))
    kept = simhash.near_copies(docs, crowd)
    assert kept.columns == docs.columns
    got, want = sorted(r.doc_id for r in kept.collect()), sorted(least.values())
    assert set(want) <= set(got) and len(got) <= len(want) + 2
    assert simhash.near_copies(docs.limit(0)).count() == 0
