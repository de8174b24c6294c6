import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text))


TEXTS = [None, "", "\n\n \t", "a b c a b c", "x x x x", "é\u00a0ü ß", "line one\nline one\n \nline one", "#tag <b> $5|6", "A B\r\nA B\r", "one two " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_measure_is_the_plain_one(text):
    assert quality.measure(None if text is None else text.encode()) == plain(text)


def test_ledger_policies_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, 5), (2, "same words again " * 40, 6), (3, "few", 7), (None, None, 8), (5, " ".join(f"w{i}###" for i in range(60)), 9), (1, clean, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed int").withColumn("measures__", F.lit(0))
    led = quality.ledger(docs)
    got = {(r.doc_id, r.n_words): (r.base, r.now) for r in led.select("*", quality.passes("base").alias("base"), quality.passes().alias("now")).collect()}
    assert got == {(1, 60): (True, True), (2, 120): (False, False), (3, 1): (False, False), (None, 0): (False, False), (5, 60): (True, False)}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    table = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(led).collect()}
    masks = [r.failed & quality.policy_mask(quality.CURRENT) for r in led.collect()]
    for i, rule in enumerate(quality.RULES):
        if rule.name in quality.POLICIES[quality.CURRENT]:
            assert table[rule.name] == (sum(m >> i & 1 for m in masks), sum(m == 1 << i for m in masks))
    assert quality.ledger(docs.limit(0)).count() == 0


def test_keep_filters_with_the_ledger_mask(spark):
    docs = spark.createDataFrame([(1, "few")], "doc_id long, text string")
    for policy in quality.POLICIES:
        plan = quality.keep(docs, policy)._jdf.queryExecution().optimizedPlan().toString()
        assert f"& {quality.policy_mask(policy)})" in plan
