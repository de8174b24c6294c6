"""Shared folders, checkpoints, joins that survive hot keys, and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``, or the application by
    ``setCheckpointDir``.  Only in a local session that does neither, as in
    tests, a temporary folder takes its place.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors see")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lumenframe-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def own_name(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def dealt_key(key: Column) -> Column:
    """A long join key that no earlier partitioning satisfies.

    With it both sides of a sort-merge join get an exchange of their own,
    which is what adaptive execution needs to split a hot key.
    """
    return F.bitwise_not(key)


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one long column that may have hot keys on the left.

    Nulls in the key match nothing.  The key of the left side is kept.
    """
    (k,) = own_name(left, "k__")
    other = right.select(dealt_key(F.col(key)).alias(k), *[c for c in right.columns if c != key])
    return left.withColumn(k, dealt_key(F.col(key))).join(other, k, how).drop(k)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of a graph by alternating stars.

    ``edges`` has long columns ``a`` and ``b``.  Returns ``node`` and
    ``root``, the smallest node of its component, for every node that has an
    edge to a smaller one.  Large star hangs each larger neighbour below the
    smallest one, small star does so for the smaller ones; the longest path
    halves about every round.  Each round is checkpointed; the driver sees
    only three numbers, and at the end collects its garbage, so that Spark
    removes what the rounds wrote.  No edges give no rows.
    """

    def pairs_of(df: DataFrame, *names: tuple[str, str]) -> DataFrame:
        both = F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in names]))
        return df.select(both)

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = pairs_of(e, ("a", "b"), ("b", "a"))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        return hot_join(both, m, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = least(down)
        return pairs_of(hot_join(down, m, "u"), ("v", "m"), ("u", "m")).select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        x = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.sum(F.shiftright(x, 20)), F.bit_xor(x)).first())

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = checkpointed(small(large(now)))
        before, seen = seen, mark(now)
        if before == seen:
            now.sparkSession.sparkContext._jvm.System.gc()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if seen[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
