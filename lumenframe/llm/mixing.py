"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their ids; a document's
virtual finish time is the source's words up to its end over the source's
target, so at any virtual time all sources have given the same share of their
targets.  All documents are sorted into ranges of that time over the whole
cluster, and the mix is cut where the total budget is reached: the words of
each range tell which holds the cut, and that one alone is gone through in
order.  A source may be gone through up to three times.

Running sums over a hot source never meet in one task: hashes are spread
evenly, so equal ranges of them make even buckets; sums of buckets are added up
first and only what lies inside a bucket is ordered.  Nothing is sampled but
the borders of ranges, which never show, so a rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, checkpointed, own_name

PASSES = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 256
#: At most so many buckets of a source are added up in order by one task; their rows then grow.
BUCKETS = 1 << 20
#: A range of virtual time with more rows is cut into ranges again.
RANGE_ROWS = 16_384
#: So many equal rows are dealt out at once.
CHUNK_ROWS = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source of ``sizes`` (``source``, ``size``): ``source_size``, ``target``.

    Sources in the order of their code points, null last, weigh ``weights``,
    repeating.  They share the total by weight; a target stops at ``passes``
    times its source's size and the rest is shared again, until none is above.
    Sorted by size over weight the stopped sources come first, so one running
    sum finds the level at which the others share.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = total.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * passes).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.select("*", F.row_number().over(order).alias("place"), (left.cast("double") / shares).alias("level"))
    found = F.min(F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct("place", "level"))).over(everything)
    settled = levels.select("*", found.alias("found"))
    target = F.when(F.col("place") < F.col("found.place"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("found.level"))
    return settled.select("source", "source_size", target.alias("target"))


def _cut(served: DataFrame, budget: int, range_rows: int = RANGE_ROWS):
    """The last place (``time``, ``name``, ``key``, ``size``) that the budget reaches; None if it reaches the first of none, True if all.

    ``served`` has these columns and ``words``.  Sorted by ranges over the
    cluster; what comes to the driver is a row for each range.
    """
    order = ("time", "name", "key", "size")
    n = int(served.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near, before, last = served, 0, None
    while True:
        ranged = checkpointed(near.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
        ranges = ranged.groupBy("range").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.max(F.struct(*order)).alias("last")).orderBy("range").collect()
        held = sum(r.n for r in ranges)
        for r in ranges:
            if before + r.words > budget:
                break
            before, last = before + r.words, r["last"]
        else:
            return True if near is served else last
        near = ranged.where(F.col("range") == r.range).drop("range")
        if r.n <= range_rows or r.n == held:
            break  # few, or all in one place
    run = F.sum("words").over(Window.orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    inside = near.select(F.struct(*order).alias("o"), run.alias("run")).where(F.col("run") <= budget).agg(F.max("o")).first()[0]
    return last if inside is None else inside


def mix(docs: DataFrame, seed: str = "mix", bucket_rows: int = BUCKET_ROWS, keep_source: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row's ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``docs`` has ``doc_id``, ``source`` and ``text``; other columns go.  Size is
    the number of words of the whole text; null and empty texts have none.
    ``copies`` is how often the mix holds the document, ``taken`` the words of
    these copies, ``first_time`` the virtual finish time of its first.  Whole
    documents are taken; the first that would pass the budget ends the mix.
    Rows that agree in id, source and size are counted first and taken alike,
    all or none; equal times go by source, then by the hash of the id.  Null
    ids count as one id.  No words at all give a mix of nothing, an empty
    table an empty one.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"))
    rows = checkpointed(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("key", key))
    wanted = checkpointed(targets(rows.select("source", (F.col("size") * F.col("n")).alias("size"))))
    summed = rows.agg(F.count("*"), F.sum(F.col("size") * F.col("n")), F.max("n")).first()
    distinct, budget, most = summed[0], summed[1] or 0, summed[2] or 0
    buckets = min(BUCKETS, max(1, -(-distinct // bucket_rows)))

    # words before each bucket of each source
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("name")
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).alias("bucket")
    dealt = rows.select("doc_id", "size", "n", "key", (F.col("size") * F.col("n")).alias("words"), name, bucket)
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("name", "bucket").agg(F.sum("words").alias("words")).select("name", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = starts.join(wanted.select(name, "source_size", "target"), "name")
    inside = Window.partitionBy("name", "bucket").orderBy("key", "size").rangeBetween(Window.unboundedPreceding, 0)
    queued = dealt.join(starts, ["name", "bucket"]).select("doc_id", "size", "n", "key", "words", "name", "source_size", "target", (F.col("start") + F.sum("words").over(inside)).alias("end"))
    queued = checkpointed(queued)

    time = lambda i: F.when(F.col("target") > 0, (F.col("end") + F.col("source_size") * F.lit(i)).cast("double") / F.col("target")).otherwise(F.lit(0.0))
    served = queued.where("size > 0").select("words", "size", "name", "key", F.explode(F.array(*[time(i) for i in range(PASSES)])).alias("time"))
    cut = _cut(served, budget, range_rows)
    if cut is True or cut is None:
        inside_mix = lambda i: F.lit(cut is True)
    else:
        bound = F.struct(*[F.lit(cut[c]).alias(c) for c in ("time", "name", "key", "size")])
        inside_mix = lambda i: F.struct(time(i).alias("time"), "name", "key", "size") <= bound
    copies = sum((F.when((F.col("size") > 0) & inside_mix(i), F.lit(1)).otherwise(F.lit(0)) for i in range(PASSES)), F.lit(0))
    out = queued.select("doc_id", "size", "source_size", "target", copies.alias("copies"), time(0).alias("first_time"), "name", "n")
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    if most > 1:
        # a row for each that was counted, in chunks, so that no task holds them all
        out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_ROWS))))
        if most > CHUNK_ROWS:
            out = out.repartition("doc_id", "name", "size", "chunk")
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("chunk") * CHUNK_ROWS, F.lit(CHUNK_ROWS))))).drop("chunk", "row")
    out = out.drop("n")
    return out if keep_source else out.drop("name")


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as rows of ``docs``: a row as often as the mix holds it.

    Decisions are keyed by id, source and size, which is all they depend on,
    so rows that repeat these are taken alike.
    """
    i, s, n, copies = own_name(docs, "id__", "source__", "size__", "copies__")
    taken = mix(docs.select("doc_id", "source", "text"), seed, keep_source=True).where("copies > 0")
    text_of = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    taken = taken.select(text_of("doc_id").alias(i), F.col("name").alias(s), F.col("size").alias(n), F.col("copies").alias(copies)).distinct()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.withColumns({i: text_of("doc_id"), s: text_of("source"), n: size})
    return keyed.join(taken, [i, s, n]).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
