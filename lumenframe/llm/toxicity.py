"""A toxicity classifier with a counterfactual penalty.

A text is the set of its words and word beginnings, hashed.  Features that
toxic or clean labels clearly favour are found by a distributed count; a
logistic model over them is fitted on the driver from a bounded sample.  In
the labelled sentences that mention a group of people the group's name is
swapped for its peers, and the squared change of the sentence's log-odds is
part of the loss, so a neutral mention of any one group doesn't move the
score.  (The score is the logistic function of the log-odds, whose slope is a
quarter at most: its squared change is at most a sixteenth of what is
penalised, and the loss stays convex.)  Labels are read for the fit only; a
score is a function of the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import checkpointed, own_name, tidy

#: The fit uses at most so many labelled texts of each class, those with the
#: smallest hashes of their ids; selection and counts cover all of these.
SAMPLE = 4000
#: A feature counts if one class has it so many times as often as the other;
#: for clean texts that must also be as many standard errors away, for rare
#: words of toxic ones are wanted.  However many pass, all are taken.
RATIO, CLEAR = 4, 3.5
#: A word stands for itself and for its beginnings of these lengths.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

#: Peers that are swapped for one another.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "transgender"),
    ("man", "woman"), ("men", "women"), ("male", "female"),
    ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "turkish", "polish"),
    ("christ", "muslime", "jude"), ("christen", "muslime", "juden"), ("frau", "mann"),
    ("chrétien", "musulman", "juif"), ("femme", "homme"), ("cristiano", "musulmán", "judío"), ("mujer", "hombre"),
)

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_PEERS: dict[str, tuple[str, ...]] = {}
for _g in IDENTITY_GROUPS:
    for _t in _g:
        _PEERS[_t] = (*_PEERS.get(_t, ()), *(x for x in _g if x != _t))


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and its beginnings, as signed 32-bit numbers."""
    names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n and word not in _PEERS)]
    return tuple(h - (1 << 32) if (h := zlib.crc32(x.encode())) >> 31 else h for x in names)


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def text_features(words: set[str]) -> set[int]:
    return {f for w in words for f in features_of(w)}


def swaps(text: str | None) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each sentence with an identity term and each peer: features gained and lost."""
    if not text or not any(w in _PEERS for w in distinct_words(text)):
        return []
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = _WORD.findall(sentence)
        for term in {w for w in words if w in _PEERS}:
            own = text_features(set(words))
            for peer in _PEERS[term]:
                other = text_features({peer if w == term else w for w in words})
                out.append((tuple(sorted(other - own)), tuple(sorted(own - other))))
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: Mapping[int, float]

    def score(self, words: set[str]) -> float:
        x = self.bias + sum(self.weights[f] for f in text_features(words) if f in self.weights)
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _flat(lists: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which list each number is of, and all numbers: a sparse matrix of ones by rows."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)


def loss_of(rows: Sequence[np.ndarray], labels: np.ndarray, size: int, pairs: Sequence[tuple[np.ndarray, np.ndarray, float]], ridge: float, fairness: float):
    """The function to minimise: bias and weights in one vector to its value and gradient."""
    row_of, at = _flat(rows)
    up_of, up = _flat([p[0] for p in pairs])
    down_of, down = _flat([p[1] for p in pairs])
    share = np.array([p[2] for p in pairs])

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w = v[1:]
        x = v[0] + np.bincount(row_of, weights=w[at], minlength=len(rows))
        error = (0.5 * (1 + np.tanh(x / 2)) - labels) / len(rows)
        value = float((np.logaddexp(0, x) - labels * x).mean() + 0.5 * ridge * (w @ w))
        g = np.bincount(at, weights=error[row_of], minlength=size) + ridge * w
        if len(pairs):
            change = np.bincount(up_of, weights=w[up], minlength=len(pairs)) - np.bincount(down_of, weights=w[down], minlength=len(pairs))
            value += float(fairness * (share * change * change).sum())
            slope = 2 * fairness * share * change
            g += np.bincount(up, weights=slope[up_of], minlength=size) - np.bincount(down, weights=slope[down_of], minlength=size)
        return value, np.concatenate([[error.sum()], g])

    return loss


def minimise(loss, start: np.ndarray, rounds: int = 500, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with backtracking for a convex function."""
    v = start
    value, g = loss(v)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max(initial=0) <= tolerance:
            break
        d, kept = g.copy(), []
        for s, y, r in reversed(steps):
            kept.append(r * (s @ d))
            d -= kept[-1] * y
        if steps:
            s, y, r = steps[-1]
            d /= r * (y @ y)
        for (s, y, r), a in zip(steps, reversed(kept)):
            d += s * (a - r * (y @ d))
        slope, length = float(g @ d), 1.0 if steps else min(1.0, 1.0 / np.abs(g).max())
        for _ in range(40):
            new = v - length * d
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = new - v, new_g - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[-(memory - 1) :], (s, y, 1.0 / (s @ y))]
        v, value, g = new, new_value, new_g
    return v


def fit_logistic(rows: Sequence[np.ndarray], labels: np.ndarray, size: int, pairs: Sequence[tuple[np.ndarray, np.ndarray, float]], ridge: float = 1e-5, fairness: float = 10.0) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise log loss + ridge + counterfactual penalty.

    ``rows`` hold the features of each text; ``pairs`` features gained and
    lost by a swap and its share of all swaps.
    """
    if not len(rows):
        return 0.0, np.zeros(size)
    v = minimise(loss_of(rows, labels, size, pairs, ridge, fairness), np.zeros(size + 1))
    return float(v[0]), v[1:]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_SEEN = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("swaps", T.ArrayType(T.StructType([T.StructField("gained", T.ArrayType(T.IntegerType())), T.StructField("lost", T.ArrayType(T.IntegerType()))])))])


@F.arrow_udf(_SEEN)
def _seen(texts: pa.Array) -> pa.Array:
    rows = []
    for x in texts:
        text = x.as_py()
        rows.append({"features": sorted(text_features(distinct_words(text))), "swaps": [{"gained": list(a), "lost": list(b)} for a, b in swaps(text)]})
    ints = pa.list_(pa.int32())
    return pa.array(rows, type=pa.struct([("features", ints), ("swaps", pa.list_(pa.struct([("gained", ints), ("lost", ints)])))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = 10.0) -> Model:
    """Fit from the labelled rows that aren't held out.

    Labels whose id or ``toxic`` is null are ignored; an id labelled twice
    counts as toxic if one label says so; of the texts of a repeated id each
    counts.  Without toxic or without clean labels (an empty table, say) the
    model gives every text 0.  The driver receives the counted features of at
    most ``2 * sample`` texts, and the distinct swaps among them, no more than
    there are pairs of peers and of what a sentence already holds of them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    by_class = {t: n for t, n in known.groupBy("toxic").count().collect()}
    toxic, clean = (known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(sample) for t in (1, 0))
    if not by_class.get(1) or not by_class.get(0):
        return Model(-40.0, {})
    chosen = F.broadcast(toxic.union(clean))  # at most 2 * sample rows of two numbers
    read = checkpointed(docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", _seen("text").alias("seen")))
    n = {t: c for t, c in read.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model(-40.0, {})
    counts = read.select("toxic", F.explode("seen.features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    rate = (F.col("pos") + 0.5) / (n[1] + 1), (F.col("neg") + 0.5) / (n[0] + 1)
    apart = (rate[0] - rate[1]) / F.sqrt(rate[0] / n[1] + rate[1] / n[0])
    of_toxic = (F.col("pos") >= max(2, n[1] // 1000)) & (rate[0] > RATIO * rate[1])
    of_clean = (rate[1] > RATIO * rate[0]) & (apart <= -CLEAR)
    features = {r.f for r in counts.where(of_toxic | of_clean).select("f").collect()}
    for term in _PEERS:
        features.update(features_of(term))
    place = {f: i for i, f in enumerate(sorted(features))}
    wanted = docs.sparkSession.sparkContext.broadcast(np.array(sorted(features), dtype=np.int32))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(lists: pa.Array) -> pa.Array:
        own, out = wanted.value, []
        for x in lists:
            f = np.asarray(x.values, dtype=np.int32)
            at = np.minimum(np.searchsorted(own, f), len(own) - 1)
            out.append(np.sort(at[own[at] == f]).astype(np.int32))
        return pa.array(out, type=pa.list_(pa.int32()))

    texts = read.select("toxic", places("seen.features").alias("f")).collect()
    changes = read.select(F.explode("seen.swaps").alias("s")).select(places("s.gained").alias("gained"), places("s.lost").alias("lost")).groupBy("gained", "lost").count().collect()
    # in an order of their own, so that a rerun adds up alike
    texts = sorted((r.toxic, r.f) for r in texts)
    changes = sorted((r.gained, r.lost, r["count"]) for r in changes)
    total = sum(c for *_, c in changes)
    at = lambda x: np.array(x, dtype=np.int64)
    bias, w = fit_logistic([at(f) for _, f in texts], np.array([float(t) for t, _ in texts]), len(place), [(at(a), at(b), c / total) for a, b, c in changes], fairness=fairness)
    return Model(float(bias), {f: float(w[i]) for f, i in place.items()})


def score_column(model: Model, text: Column, spark) -> Column:
    """Score from 0 to 1 of a text column; null counts as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        own = sent.value
        if _WORDS.get("of") is not own:
            _WORDS.update(of=own, hits={})
        hits_of, weights, out = _WORDS["hits"], own.weights, np.empty(len(texts))
        for i, x in enumerate(texts):
            hits: set[int] = set()
            for word in distinct_words(x.as_py()):
                found = hits_of.get(word)
                if found is None:
                    if len(hits_of) > 100_000:
                        hits_of.clear()
                    found = hits_of[word] = tuple(f for f in features_of(word) if f in weights)
                if found:
                    hits.update(found)
            out[i] = own.bias + sum(weights[f] for f in sorted(hits))
        return tidy(pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40)))))

    return scored(text)


#: A worker's model, and which of its features each word seen has: nearly always none.
_WORDS: dict = {}


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Whole texts are scored, however long; null and empty ones as the text
    without words.  Repeated rows get a row each, null ids are not held out,
    an empty table gives an empty one; a score of exactly the threshold is
    toxic.  Other columns of ``docs``, whatever their names, go.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold; odd input as in ``classify``."""
    (score,) = own_name(docs, "score__")
    model = fit(docs, labels)
    return docs.withColumn(score, score_column(model, F.col("text"), docs.sparkSession)).where(F.col(score) < threshold).drop(score)
