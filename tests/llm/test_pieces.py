import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import pieces

public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")
TEXTS = ["", "a", "hello world  x\n\ny 漢͸ é", " lead", "trail ", "\n", "\t\r\n ", "a" * 700, "word " * 500, "𝔘𝔫𝔦 \u0000 ½", "<s> <0x41>"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def enumerate_all(v, text):
    """Every segmentation of a short text, with its probability."""
    table = {v.library.id_to_piece(i): i for i in range(v.library.get_piece_size()) if not (v.library.is_byte(i) or v.library.is_control(i) or v.library.is_unknown(i))}
    found = {}

    def go(rest, path, lp):
        if not rest:
            found[tuple(path)] = lp
        for n in range(1, len(rest) + 1):
            if rest[:n] in table:
                go(rest[n:], [*path, table[rest[:n]]], lp + v.logp[table[rest[:n]]])

    go(pieces.normalise(text), [], 0.0)
    top = max(found.values())
    total = sum(math.exp(x - top) for x in found.values())
    return {p: math.exp(x - top) / total for p, x in found.items()}


def test_round_trips(vocabulary):
    v = vocabulary
    for text in TEXTS:
        rows = pieces.sample_block(v, [1], [text], k=4)[0]
        assert rows and len({tuple(r[0].tolist()) for r in rows}) == len(rows)
        for ids, *_ in rows:
            assert v.decode(ids.tolist()) == text.encode()
            assert v.library.decode(ids.tolist()) == text
        assert v.decode(v.library.encode(text)) == text.encode()


def test_samples_follow_the_lattice_without_replacement(vocabulary):
    v, text, n = vocabulary, "the cat", 6000
    prob = enumerate_all(v, text)
    assert len(prob) > 20
    # a flatter distribution, so that all segmentations are seen
    flat = pieces.Vocabulary(open(MODEL, "rb").read(), power=0.0)
    flat.logp = flat.logp / 8
    prob = enumerate_all(flat, text)
    first, pairs, weighed = Counter(), Counter(), Counter()
    for rows in pieces.sample_block(flat, list(range(n)), [text] * n, k=2):
        a, b = (tuple(r[0].tolist()) for r in rows)
        assert a != b and rows[0][2] >= rows[1][2]
        first[a] += 1
        pairs[a, b] += 1
        for r in rows:
            s = tuple(r[0].tolist())
            assert r[1] == pytest.approx(math.log(prob[s]), abs=1e-6) and r[3] <= 0
            weighed[s] += math.exp(r[1] - r[3])
    assert max(abs(first[s] / n - p) for s, p in prob.items()) < 4.5 * math.sqrt(0.25 / n)
    assert max(abs(pairs[a, b] / n - prob[a] * prob[b] / (1 - prob[a])) for a in prob for b in prob if a != b) < 4.5 * math.sqrt(0.25 / n)
    # inclusion scores make the sample unbiased
    assert sum(weighed.values()) / n == pytest.approx(1, abs=0.05)


def test_draws_depend_on_key_and_text_only(vocabulary):
    v = vocabulary
    alone = [[r[0].tolist() for r in pieces.sample_block(v, [i], [t], k=3)[0]] for i, t in enumerate(TEXTS)]
    together = [[r[0].tolist() for r in rows] for rows in pieces.sample_block(v, list(range(len(TEXTS))), TEXTS, k=3)]
    assert alone == together
    other = [[r[0].tolist() for r in rows] for rows in pieces.sample_block(v, list(range(len(TEXTS))), TEXTS, k=3, seed=9)]
    assert other != together


def test_few_segmentations_all_come_back(vocabulary):
    rows = pieces.sample_block(vocabulary, [1], ["a"], k=5)[0]
    assert len(rows) == 2 and all(r[3] == 0 for r in rows) and sum(math.exp(r[1]) for r in rows) == pytest.approx(1)


def test_long_words_use_logs(vocabulary):
    long = "abcdefghij" * 40
    codes = np.frombuffer((long + long[:100]).encode("utf-32-le"), dtype=np.uint32)
    grid = pieces.Lattices(vocabulary, codes, np.array([400, 100]))
    sums = np.add.reduceat(grid.prob, grid.off[:-1][np.diff(grid.off) > 0])
    assert np.allclose(sums, 1)


def test_columns(spark, vocabulary):
    rows = [*enumerate(TEXTS), (None, "x y"), (50, None), (2, TEXTS[2]), (60, "▁ a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_pieces", F.lit("clash")).withColumn("sample", F.lit(1))
    got = pieces.sample(docs, MODEL, k=2).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert all(r.round_trip == (r.doc_id != 60) and len(r.ids) == r.n_pieces for r in got)
    again = pieces.sample(docs.repartition(3), MODEL, k=2, with_ids=False)
    assert sorted(str((r.doc_id, r.sample, r.ids_digest)) for r in again.collect()) == sorted(str((r.doc_id, r.sample, r.ids_digest)) for r in got)
    assert pieces.sample(docs.limit(0), MODEL).count() == 0
    both = docs.select("text", pieces.encode_column(spark, MODEL, F.col("text")).alias("ids")).select("text", "ids", pieces.decode_column(spark, MODEL, F.col("ids")).alias("back"))
    for r in both.collect():
        assert r.ids == vocabulary.library.encode(r.text or "") and r.back == (r.text or "").replace("▁", " ")


def test_words_are_cut_where_no_piece_crosses():
    texts = ["a  b\n\nc d", "", "\nx", " "]
    codes, starts, bounds = pieces.lay_out(texts)
    spelled = "".join(map(pieces.normalise, texts))
    assert [spelled[a:b] for a, b in zip(starts, [*starts[1:], len(spelled)])] == ["▁a", "▁▁b", "\n\n", "c", "▁d", "▁", "\n", "x", "▁▁"]
    assert bounds.tolist() == [0, 10, 10, 13, 15]


def test_a_full_store_and_equal_hashes_change_nothing(vocabulary):
    texts = [f"word{i} some other{i % 7} text{i % 3}" for i in range(200)]
    want = [[r[0].tolist() for r in rows] for rows in pieces.sample_block(vocabulary, range(200), texts)]
    own = pieces.Vocabulary(open(MODEL, "rb").read())
    own.store = pieces.Store(own, most=50)
    for n in (3, 60, 200):
        got = [[r[0].tolist() for r in rows] for a in range(0, 200, n) for rows in pieces.sample_block(own, range(a, min(a + n, 200)), texts[a : a + n])]
        assert got == want
    own.store = pieces.Store(own)
    own.store.factors = np.full(1000, 1 << 62, dtype=np.uint64)  # most words collide
    assert [[r[0].tolist() for r in rows] for rows in pieces.sample_block(own, range(200), texts)] == want


def test_running_sums_are_a_words_own(vocabulary):
    """Behind other words of a block a word's lattice is the same, bit for bit."""
    words = ["▁segmentation", "▁a", "▁uncharacteristically", "x" * 300]
    lay = lambda ws: pieces.Lattices(vocabulary, np.frombuffer("".join(ws).encode("utf-32-le"), dtype=np.uint32), np.array([len(w) for w in ws]))
    crowd = [f"▁word{i}" for i in range(3000)]
    among = lay(crowd + words)
    for w, first, last in zip(words, among.first[-len(words) :], among.last[-len(words) :]):
        alone, part = lay([w]), slice(among.off[first], among.off[last + 1] if last + 1 < len(among.off) else None)
        for name in ("piece", "step", "prob", "upto"):
            assert np.array_equal(getattr(alone, name), getattr(among, name)[part]), name
    ends = alone.off[1:][np.diff(alone.off) > 0] - 1
    assert (alone.upto[ends] == 2).all()
