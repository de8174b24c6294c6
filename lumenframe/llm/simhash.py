"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at Hamming distance 2 have a value within distance 1
of both.  So every distinct fingerprint emits its ball of radius 1 (itself and
64 one-bit flips), the variants are shuffled, and fingerprints that meet in a
variant are at most 2 apart.  The members of a variant's bucket are the
variant with single bits flipped, so a 64-bit mask and a flag hold the whole
bucket: the aggregation has a fixed-size buffer, combines on the map side and
never lists a group.  Within a bucket all members are linked with each other;
a star around one of them keeps the bucket connected without all its pairs.

That is the op1 query.  ``near_copies`` looks for texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more, which differ in some 15 % of
their SimHash bits, too many for a ball.  It takes ``WIDE`` bits, lets
texts meet in ``BLOCKS`` blocks of ``BLOCK_BITS`` of them, and compares the
whole shingle sets of those that met and whose longer fingerprints are close.
A large group of near copies isn't compared pair by pair: members are first
linked to their nearest in a few blocks, and then only texts of different
groups are compared in all blocks.  The longer fingerprints go only to the
blocks in which a text meets another group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import checkpointed, components, hot_join, own_name, tidy

SHINGLE = 3
RADIUS = 1  # half the greatest linked distance

COPY_SHINGLE = 5
SIMILARITY = 0.8
WIDE = 512
BLOCKS, BLOCK_BITS = 96, 18
CHECK_RADIUS = 20  # of the first 64 bits; a pair at the least similarity has 9.7 +- 2.9, an unrelated one 32 +- 4
#: Bits of those that meet another group, and how many may differ: a pair at
#: the least similarity has 931 +- 28, one at 0.75 1058 +- 30.
FINE, FINE_RADIUS = 6144, 1040
FIRST, NEAREST = 8, 2  # blocks in which members are linked to their nearest, and to how many
CROWD = 64  # larger buckets are compared row by row in blocks, others all at once
_PLACES = np.random.default_rng(5).permuted(np.tile(np.arange(WIDE), (BLOCKS, 1)), axis=1)[:, :BLOCK_BITS]
#: The bits of each block, as a mask over the words of a fingerprint.
_MASKS = np.packbits((np.arange(WIDE) == _PLACES[..., None]).any(axis=1), axis=1, bitorder="little").view("<u8")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of one text.

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    shingles are ``shingle`` words joined by one space, repeats included;
    fewer words make one shingle, none (or null) give 0.  A bit is set if over
    half of the XXH64 values (seed 42) have it.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(x, 42) for x in parts), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    raw = texts.cast(pa.large_binary())
    out = np.fromiter((fingerprint(x.as_py()) for x in raw), dtype=np.uint64, count=len(raw))
    return tidy(pa.array(out.view(np.int64)))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text column as a signed long (same 64 bits)."""
    return _fingerprints(text)


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints at most 2 bits apart.

    ``fingerprints`` has one row per distinct long ``fp``.  Each returned edge
    is verified; each pair within distance 2 is connected by a path of
    edges through its shared bucket.
    """
    flips = F.array(*[F.lit(0 if i == 64 else 1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(65)])
    # a ball is 65 times its fingerprint, so few rows of input make a large task
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = fingerprints.repartition(n, "fp").select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    buckets = balls.groupBy("variant").agg(F.bit_or("flip").alias("mask"), F.max(F.col("flip") == 0).alias("centre"))
    met = buckets.where(F.bit_count("mask") + F.col("centre").cast("int") > 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    members = met.select("variant", "mask", "centre", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where(F.col("mask").bitwiseAND(bit) != 0)
    # the bucket's own value is its hub if present, else the member with the lowest set bit
    least = F.lit(-(1 << 63)).cast("long")  # has no negative
    lowest = F.when(F.col("mask") == least, least).otherwise(F.col("mask").bitwiseAND(-F.col("mask")))
    hub = F.when(F.col("centre"), F.col("variant")).otherwise(F.col("variant").bitwiseXOR(lowest))
    pairs = members.select(hub.alias("a"), F.col("variant").bitwiseXOR(bit).alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * RADIUS).distinct()


def near_duplicates(fingerprinted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Groups of rows whose fingerprints are chained by at most 2 bits.

    ``fingerprinted`` has ``id_col`` (long) and ``fp`` (long), and should be
    cheap to read twice.  Adds ``root`` (the group's label, a fingerprint) and
    ``component_id``, the smallest id of the group (nulls count last; null if
    all are); columns of these names are replaced.  Rows with equal ids stay
    separate rows.  Texts without words have fingerprint 0 and are linked like
    any other; long ones are hashed whole.  Empty in, empty out.
    """
    fingerprinted = fingerprinted.drop("root", "component_id")
    distinct = checkpointed(fingerprinted.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = components(links(distinct.select("fp")))
    rooted = hot_join(distinct, labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = checkpointed(rooted)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = hot_join(rooted.select("fp", "root"), smallest, "root")
    return hot_join(fingerprinted, groups, "fp")


def shingles(text: bytes | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles, words and shingles as in ``fingerprint``."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    parts = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h64(x, 42) for x in parts), dtype="<u8"))


def wide_bits(hashes: np.ndarray, n: int = WIDE) -> np.ndarray:
    """``n`` SimHash bits of a set of shingles, each counted once."""
    votes = np.zeros(n, dtype=np.int64)
    steps = np.arange(1, n // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[at : at + (1 << 12), None] + steps  # SplitMix64 makes more bits of one hash
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).astype("<u8")
        votes += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return (2 * votes > len(hashes)).astype(np.uint8)


@F.arrow_udf(T.StructType([T.StructField("check", T.LongType()), T.StructField("keys", T.ArrayType(T.IntegerType()))]))
def _meeting_keys(texts: pa.Array) -> pa.Array:
    raw = texts.cast(pa.large_binary())
    check, keys = np.zeros(len(raw), dtype="<i8"), np.zeros((len(raw), BLOCKS), dtype=np.int32)
    powers, blocks = 1 << np.arange(BLOCK_BITS), np.arange(BLOCKS) << BLOCK_BITS
    for i, x in enumerate(raw):
        bits = wide_bits(shingles(x.as_py()))
        check[i] = np.packbits(bits[:64], bitorder="little").view("<i8")[0]
        keys[i] = bits[_PLACES] @ powers + blocks
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * BLOCKS, type=pa.int32()), pa.array(keys.ravel()))
    return tidy(pa.StructArray.from_arrays([pa.array(check), lists], names=["check", "keys"]))


@F.arrow_udf(T.BinaryType())
def _fine_bits(sets: pa.Array) -> pa.Array:
    return tidy(pa.array([np.packbits(wide_bits(np.frombuffer(x.as_py(), dtype="<u8"), FINE), bitorder="little").tobytes() for x in sets], type=pa.binary()))


@F.arrow_udf(T.BinaryType())
def _shingle_set(texts: pa.Array) -> pa.Array:
    return tidy(pa.array([shingles(x.as_py()).tobytes() for x in texts.cast(pa.large_binary())], type=pa.binary()))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = ((np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")) for x, y in zip(a, b))
    return tidy(pa.array([jaccard(x, y) >= SIMILARITY for x, y in pairs], type=pa.bool_()))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=int)
    return starts, np.diff(np.r_[starts, len(key)])


def _nearest(key: np.ndarray, node: np.ndarray, check: np.ndarray, crowd: int = CROWD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each node and its ``NEAREST`` in equal keys, within ``CHECK_RADIUS``."""
    order = np.lexsort((node, key))
    key, node, check = key[order], node[order], check[order]
    starts, sizes = _buckets(key)
    calm = np.repeat(sizes <= crowd, sizes)
    far, near = np.full((len(key), NEAREST), 255), np.zeros((len(key), NEAREST), dtype=np.int64)

    def offer(rows: np.ndarray, others: np.ndarray, apart: np.ndarray) -> None:
        for j in range(NEAREST):
            closer = apart < far[rows, j]
            old, held = far[rows, j].copy(), near[rows, j].copy()
            far[rows, j], near[rows, j] = np.where(closer, apart, old), np.where(closer, others, held)
            apart, others = np.where(closer, old, apart), np.where(closer, held, others)

    for d in range(1, min(crowd, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[d:] == key[:-d]) & calm[d:])
        apart = _apart(check[i], check[i + d]).astype(np.int64)
        offer(i, i + d, apart)
        offer(i + d, i, apart)
    for j in range(NEAREST):
        i = np.flatnonzero(far[:, j] <= CHECK_RADIUS)
        yield node[i], node[near[i, j]]
    for s, n in zip(starts[sizes > crowd], sizes[sizes > crowd]):
        ids, words = node[s : s + n], check[s : s + n]
        for at in range(0, n, 256):
            apart = _apart(words[at : at + 256, None], words[None, :]).astype(np.int16)
            apart[np.arange(len(apart)), at + np.arange(len(apart))] = 255
            some = np.argpartition(apart, NEAREST - 1, axis=1)[:, :NEAREST]
            i, j = np.repeat(np.arange(len(apart)), NEAREST), some.ravel()
            keep = apart[i, j] <= CHECK_RADIUS
            yield ids[at + i[keep]], ids[j[keep]]


def _between(key: np.ndarray, node: np.ndarray, check: np.ndarray, root: np.ndarray, fine: np.ndarray | None = None, crowd: int = CROWD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, as two arrays of places, of all pairs of nodes with different roots in equal keys within ``CHECK_RADIUS``, and ``FINE_RADIUS`` if their bits are given.

    With these a pair comes from the first block alone that both share, however many they meet in.
    In a crowded bucket everything is compared with what lies outside its
    largest group, so a group that fills it costs nothing.
    """
    order = np.lexsort((node, key))
    key, check, root = key[order], check[order], root[order]
    starts, sizes = _buckets(key)
    calm = np.repeat(sizes <= crowd, sizes)

    def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if fine is not None and len(i):
            parts = []
            for k in np.array_split(np.arange(len(i)), len(i) // 4096 + 1):
                left, right = order[i[k]], order[j[k]]
                near = _apart(fine[left], fine[right]).sum(axis=1, dtype=np.int32) <= FINE_RADIUS
                k, left, right = k[near], left[near], right[near]
                differ = fine[left, : WIDE // 64] ^ fine[right, : WIDE // 64]
                shared = np.stack([((differ & m) == 0).all(axis=1) for m in _MASKS], axis=1)
                parts.append(k[shared.argmax(axis=1) == key[i[k]] >> BLOCK_BITS])
            keep = np.concatenate(parts)
            i, j = i[keep], j[keep]
        return order[i], order[j]

    for d in range(1, min(crowd, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[d:] == key[:-d]) & calm[d:])
        i = i[root[i] != root[i + d]]
        i = i[_apart(check[i], check[i + d]) <= CHECK_RADIUS]
        yield close(i, i + d)
    for s, n in zip(starts[sizes > crowd], sizes[sizes > crowd]):
        groups, words = root[s : s + n], check[s : s + n]
        names, counts = np.unique(groups, return_counts=True)
        outside = groups != names[counts.argmax()]
        others = np.flatnonzero(outside)
        for at in range(0, len(others), 256):
            own = others[at : at + 256]
            i, j = np.nonzero((_apart(words[own, None], words[None, :]) <= CHECK_RADIUS) & (groups[own, None] != groups[None, :]))
            once = ~outside[j] | (own[i] < j)  # two from outside the largest group meet twice
            yield close(s + own[i[once]], s + j[once])


def _meet(rows: DataFrame, work, schema: str, names: tuple[str, ...]) -> DataFrame:
    """``work`` over the columns ``key`` and ``names`` of all rows of a task, dealt by key."""
    rows = rows.select("key", *names).repartition(_parts(rows), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c) for c in ("key", *names)] for b in batches]
        if held:
            columns = [pa.concat_arrays(list(c)) for c in zip(*held)]
            del held
            plain = [np.frombuffer(b"".join(c.to_pylist()), dtype="<u8").reshape(len(c), FINE // 64) if n == "fine" else c.to_numpy(zero_copy_only=False) for n, c in zip(("key", *names), columns)]
            yield from work(*plain)

    return rows.mapInArrow(run, schema)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _blocks(nodes: DataFrame, names: tuple[str, ...], first: int = BLOCKS) -> DataFrame:
    """``names`` of each node with each of its first ``keys``; a node has many, so few rows of input make a large task."""
    return nodes.repartition(_parts(nodes), "node").select(*names, F.explode(F.slice("keys", 1, first)).alias("key"))


def _pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in parts:
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_copies(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` for each group of near copies, all columns as they are.

    Texts are near copies if the Jaccard similarity of their sets of five-word
    shingles is ``SIMILARITY`` or more; groups are chains of such pairs.  Each
    linked pair is verified on its whole sets.  A pair at the least similarity
    meets in a block and is close enough with a probability of some 0.99, a
    more similar one more likely; of very short texts some such pairs are
    lost (4 shingles against 5: all).  Members are first linked to their nearest
    in a few blocks; then every pair that meets in any block and isn't yet of
    one group is compared, whatever the size of its bucket.  Which row
    stays: the one with the smallest id (null ids come last; of rows that
    share it, one with the smallest content hash).  Repeated rows are copies
    of each other.  Null and empty texts, and those without words, form one
    group; whole texts are compared, however long; an empty table gives an
    empty one.  Names of ``docs`` never clash with those used here.
    """
    c, h, i, none = own_name(docs, "content__", "hash__", "id__", "none__")
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    made = docs.select("doc_id", content.alias("node"), _meeting_keys(F.col("text")).alias("made"))
    prints = checkpointed(made.select("doc_id", "node", "made.check", "made.keys"))
    nodes = checkpointed(prints.select("node", "check", "keys").dropDuplicates(["node"]))

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = hot_join(docs.select(content.alias("node"), "text"), wanted, "node").dropDuplicates(["node"])
        return checkpointed(texts.select("node", _shingle_set(F.col("text")).alias("set")))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = hot_join(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        both = hot_join(left, sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return checkpointed(both.where(_similar(F.col("set_a"), F.col("set_b"))).select(pairs.columns))

    def rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return hot_join(rows, labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def opened(key, node, check, root) -> Iterator[pa.RecordBatch]:
        meets = np.zeros(len(key), dtype=bool)
        for i, j in _between(key, node, check, root, crowd=crowd):
            meets[i] = meets[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[meets]) for x in (key, node, check, root)], names=["key", "node", "check", "root"])

    def close(key, node, check, root, fine) -> Iterator[pa.RecordBatch]:
        for i, j in _between(key, node, check, root, fine, crowd):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], root[i], root[j])], names=["a", "b", "root_a", "root_b"])

    near = checkpointed(_meet(_blocks(nodes, ("node", "check"), FIRST), lambda *x: _pairs(_nearest(*x, crowd=crowd)), "a long, b long", ("node", "check")).distinct())
    edges = verified(near, sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    grouped = checkpointed(rooted(nodes, components(edges)))
    # who meets another group, and where; only these are compared by their longer fingerprints
    every = _blocks(grouped, ("node", "check", "root"))
    met = _meet(every, opened, "key int, node long, check long, root long", ("node", "check", "root"))
    met = checkpointed(met.groupBy("node").agg(F.first("check").alias("check"), F.first("root").alias("root"), F.collect_list("key").alias("keys")))
    sets = sets_of(met.select("node"))
    rest = hot_join(met, sets.select("node", _fine_bits("set").alias("fine")), "node")
    between = checkpointed(_meet(_blocks(rest, ("node", "check", "root", "fine")), close, "a long, b long, root_a long, root_b long", ("node", "check", "root", "fine")))
    joined = components(verified(between, sets).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    final = hot_join(grouped.select("node", "root"), joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    final = final.select("node", F.coalesce("top", "root").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias(none), F.col("doc_id").alias(i), F.col("node").alias(h))).alias(c)
    stay = hot_join(prints.select("doc_id", "node"), final, "node").groupBy("root").agg(first)
    stay = stay.select(F.coalesce(F.col(f"{c}.{i}").cast("string"), F.lit("null")).alias(i), F.col(f"{c}.{h}").alias(h))
    keyed = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn(h, content)
    return keyed.join(stay.distinct(), [i, h], "left_semi").dropDuplicates([i, h]).drop(i, h)


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
