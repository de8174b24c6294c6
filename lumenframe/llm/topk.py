"""Exact top-k search by inner product with KD-trees, one per shard.

Space is cut into cells by median splits over a bounded sample; every vector
is in one cell, and a cell with more than ``shard_rows`` vectors is dealt to
several shards.  Each cell has the tight box of all its vectors, and no
vector in a box scores more against a query than the box's best corner.  A
query first searches one shard of the cell whose corner promises most; the
k-th score found there travels with it, and it is sent only to the cells whose
bound reaches that score.  Inside a shard the same is done with a KD-tree:
median splits along the widest side, tight boxes, leaves best bound first.

The sample moves the cells' borders, never a result: boxes are taken over all
vectors, and a query is kept from a cell by its box alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import checkpointed

K = 20
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
LEAF = 128
#: The splits are fitted on at most so many vectors, those with the smallest hashes of their ids.
SAMPLE = 16_384
#: At most so many cells, and so many numbers in all their boxes: what is broadcast is bounded.
CELLS, BOX_NUMBERS = 1024, 1 << 20
MIN_CELLS = 16
#: Whole numbers up to here are exact as doubles.
_EXACT = 2.0**53
_LONG = (1 << 63) - 1

_HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
_FLOOR = T.StructType([T.StructField("id", T.LongType()), T.StructField("least", T.LongType())])
_BOX = T.StructType([
    T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
])
_NONE = -_LONG - 1


class KDTree:
    """Median splits over rows of whole numbers, with tight boxes per level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        depth = max(0, math.ceil(math.log2(max(1, len(ids)) / leaf)))
        order, self.cuts = np.arange(len(ids)), [np.array([0, len(ids)])]
        for _ in range(depth):
            cuts = self.cuts[-1]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = rows[order[a:b]]
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                order[a:b] = order[a:b][np.argsort(part[:, side], kind="stable")]
            self.cuts.append(np.sort(np.concatenate([cuts, (cuts[:-1] + cuts[1:]) // 2])))
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = [], []
        for cuts in self.cuts:
            self.low.append(np.stack([self.rows[a:b].min(axis=0) for a, b in zip(cuts[:-1], cuts[1:])]))
            self.high.append(np.stack([self.rows[a:b].max(axis=0) for a, b in zip(cuts[:-1], cuts[1:])]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of each query's best ``k`` here.

        Only scores of at least ``least`` come back; a row with the query's
        own id is left out; ties go to the smaller id.
        """
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        alive = np.ones((len(queries), 1), dtype=bool)
        for low, high in zip(self.low, self.high):
            bound = up @ high.T + down @ low.T
            if bound.shape[1] != alive.shape[1]:
                alive = np.repeat(alive, 2, axis=1)
            alive &= bound >= least[:, None]
        best = np.full((len(queries), k), _NONE, dtype=np.int64)
        best_id = np.full((len(queries), k), _LONG, dtype=np.int64)
        floor = least.astype(np.float64)
        order = np.argsort(np.where(alive, -bound, np.inf), axis=1, kind="stable")
        cuts = self.cuts[-1]
        for turn in range(bound.shape[1]):
            leaf = order[:, turn]
            here = np.arange(len(queries))
            go = here[alive[here, leaf] & (bound[here, leaf] >= floor)]
            if not len(go):
                break
            go = go[np.argsort(leaf[go], kind="stable")]
            for part in np.split(go, np.flatnonzero(np.diff(leaf[go])) + 1):
                a, b = cuts[leaf[part[0]]], cuts[leaf[part[0]] + 1]
                score = queries[part] @ self.rows[a:b].T
                score[query_ids[part][:, None] == self.ids[a:b][None, :]] = -np.inf
                some = (score >= floor[part][:, None]).any(axis=1)
                if not some.any():
                    continue
                part, score = part[some], score[some]
                whole = np.where(np.isfinite(score), score, 0).astype(np.int64)
                whole[~((score >= floor[part][:, None]) & (score > -np.inf))] = _NONE
                s = np.concatenate([best[part], whole], axis=1)
                i = np.concatenate([best_id[part], np.broadcast_to(self.ids[a:b], whole.shape)], axis=1)
                i[s == _NONE] = _LONG
                top = np.lexsort((i, -s.astype(np.float64)), axis=1)[:, :k]
                best[part], best_id[part] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                kth = best[part, k - 1]
                floor[part] = np.where(kth == _NONE, floor[part], np.maximum(floor[part], kth))
        q, at = np.nonzero(best != _NONE)
        return q, best_id[q, at], best[q, at]


class Cells:
    """Median splits of space: in which cell a vector lies.  Each dimension has cells of its own."""

    def __init__(self, sample: dict[int, np.ndarray], cells: int):
        self.trees, self.n = {}, 0
        rows = sum(map(len, sample.values()))
        for d, vectors in sorted(sample.items()):
            own = max(1, min(cells * len(vectors) // max(1, rows), BOX_NUMBERS // max(1, 2 * d)))
            depth = int(math.log2(own)) if d else 0
            side, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
            parts = [vectors]
            for node in range((1 << depth) - 1):
                part = parts[node]
                if len(part):
                    side[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                    cut[node] = np.median(part[:, side[node]])
                below = part[:, side[node]] < cut[node] if len(part) else np.zeros(0, dtype=bool)
                parts += [part[below], part[~below]]
            self.trees[d] = (depth, side, cut, self.n)
            self.n += 1 << depth
        self.rest = self.n  # of dimensions that the sample lacks

    def of(self, d: int, rows: np.ndarray) -> np.ndarray:
        if d not in self.trees:
            return np.full(len(rows), self.rest, dtype=np.int32)
        depth, side, cut, first = self.trees[d]
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), side[node]] >= cut[node])
        return (node - ((1 << depth) - 1) + first).astype(np.int32)


def _matrix(lists: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: places and vectors."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    ends = np.asarray(lists.offsets)
    values = np.asarray(lists.values, dtype=np.float64)
    sizes = np.diff(ends)
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out[int(d)] = (rows, values[ends[rows][:, None] + np.arange(d)])
    return out


def _exhaustive(ids, rows, query_ids, queries, k, least):
    """For numbers too large for doubles: the same with Python's integers."""
    big = [[int(x) for x in r] for r in rows]
    for at, q in enumerate(queries):
        own = [int(x) for x in q]
        hits = sorted((-max(-_LONG, min(_LONG, sum(map(int.__mul__, own, r)))), int(i)) for i, r in zip(ids, big) if i != query_ids[at])
        for s, i in hits[:k]:
            if -s >= least[at]:
                yield at, i, -s


def search_shard(queries: pa.Table, vectors: pa.Table, k: int, least: np.ndarray) -> tuple[list, list, list]:
    """Ids of queries, ids of vectors and scores; dimensions are compared with their like only."""
    out: tuple[list, list, list] = ([], [], [])
    query_ids, vector_ids = np.asarray(queries.column("id")), np.asarray(vectors.column("id"))
    by = _matrix(vectors.column("v"))
    for d, (places, q) in _matrix(queries.column("v")).items():
        if d not in by:
            continue
        held, v = by[d]
        ids, asked = vector_ids[held], query_ids[places]
        if d == 0 or len(q) == 0 or np.abs(q).max() * np.abs(v).max() * d < _EXACT:
            at, found, score = KDTree(ids, v).search(asked, q, k, least[places])
        else:
            rows = list(_exhaustive(ids, v, asked, q, k, least[places]))
            at, found, score = (np.array([r[j] for r in rows], dtype=np.int64) for j in range(3))
        out[0].extend(asked[at].tolist())
        out[1].extend(found.tolist())
        out[2].extend(score.tolist())
    return out


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of each component.

    Rows without an id or vector, or with a null or non-finite component,
    are left out; empty vectors stay.  Repeated rows stay as often as they
    come, long vectors whole.  Other columns, whatever their names, go.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return df.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled.alias("v"))


def fit_cells(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> Cells:
    """Splits from at most ``sample`` vectors and ``4 * BOX_NUMBERS`` numbers of them."""
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    most = max(1, min(sample, 4 * BOX_NUMBERS // max(1, size)))
    chosen = vectors.orderBy(F.xxhash64("id", F.lit("sample")), "id", "v").limit(most).select("v").collect()
    by: dict[int, list] = {}
    for r in chosen:
        by.setdefault(len(r.v), []).append(r.v)
    return Cells({d: np.array(v, dtype=float).reshape(len(v), d) for d, v in by.items()}, cells)


def boxes(placed: DataFrame) -> DataFrame:
    """Rows and tight box of each cell, over all vectors of ``placed`` (``cell``, ``v``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            cells = np.asarray(b.column("cell"))
            for d, (rows, v) in _matrix(b.column("v")).items():
                order = np.argsort(cells[rows], kind="stable")
                own = cells[rows][order]
                for part in np.split(order, np.flatnonzero(np.diff(own)) + 1) if len(own) else ():
                    low, high = v[part].min(axis=0), v[part].max(axis=0)
                    old = held.setdefault((int(cells[rows[part[0]]]), d), [0, low, high])
                    old[0] += len(part)
                    old[1], old[2] = np.minimum(old[1], low), np.maximum(old[2], high)
        yield pa.RecordBatch.from_pydict(
            {"cell": [c for c, _ in held], "n": [x[0] for x in held.values()], "low": [x[1].tolist() for x in held.values()], "high": [x[2].tolist() for x in held.values()]},
            schema=pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]),
        )

    parts = placed.select("cell", "v").mapInArrow(run, _BOX).select("cell", F.size("low").alias("d"), "n", F.posexplode_outer(F.arrays_zip("low", "high")).alias("i", "x"))
    sides = parts.groupBy("cell", "d", "i").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    whole = sides.groupBy("cell", "d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("s"))
    return whole.select("cell", "n", F.col("s.low").alias("low"), F.col("s.high").alias("high"))


class Router:
    """The cells' boxes: which cells can hold a score for a query.

    A cell of dimensions that the sample lacks has no box and is never left out.
    """

    def __init__(self, cells: Cells, rows: list):
        self.cells, self.own = cells, {}
        for r in rows:
            if r.cell != cells.rest:
                low, high = ([x for x in side if x is not None] for side in (r.low, r.high))
                self.own.setdefault(len(low), []).append((r.cell, low, high))
        self.own = {d: (np.array([c for c, *_ in x]), *(np.array([y[j] for y in x], dtype=float).reshape(len(x), d) for j in (1, 2))) for d, x in self.own.items()}

    def bounds(self, d: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and for each query the most that each can score, rounding errors included."""
        if d not in self.own:
            return np.array([self.cells.rest]), np.full((len(queries), 1), np.inf)
        cells, low, high = self.own[d]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        most = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
        return cells, up @ high.T + down @ low.T + 1e-12 * (d + 1) * most

    def best(self, d: int, queries: np.ndarray) -> np.ndarray:
        cells, bound = self.bounds(d, queries)
        return cells[bound.argmax(axis=1)].astype(np.int32)

    def reached(self, d: int, queries: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        cells, bound = self.bounds(d, queries)
        return [cells[b >= x].astype(np.int32) for b, x in zip(bound, least)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, sent: dict | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's best ``k``.

    Both sides have ``id`` and ``v`` as ``whole_vectors`` makes them.  Every
    row of ``vectors`` is a candidate, repeated ones each for itself; of rows
    of ``queries`` that share an id the one with the smallest vector asks.
    Ties go to the smaller id.  No queries, or no vectors, give no rows; long
    vectors are compared whole.  Shards and blocks of queries have a bounded
    size, so memory doesn't grow with either table, and a cell that a third of
    all vectors share is dealt to many shards.  Scores beyond a long are held
    at its ends.  ``sent``, if given, gets how many pairs of query and shard
    there were and how many were searched.
    """
    spark = vectors.sparkSession
    n_vectors = vectors.count()
    wished = min(CELLS, max(MIN_CELLS, -(-n_vectors // shard_rows)))
    cells = fit_cells(vectors, wished)
    shipped = spark.sparkContext.broadcast(cells)

    @F.arrow_udf(T.IntegerType())
    def cell_of(v: pa.Array) -> pa.Array:
        out = np.zeros(len(v), dtype=np.int32)
        for d, (rows, x) in _matrix(v).items():
            out[rows] = shipped.value.of(d, x)
        return pa.array(out)

    placed = checkpointed(vectors.select("id", "v", cell_of("v").alias("cell")))
    found_boxes = boxes(placed).collect()  # at most CELLS rows and BOX_NUMBERS numbers a dimension of the sample
    routes = spark.sparkContext.broadcast(Router(cells, found_boxes))

    @F.arrow_udf(T.IntegerType())
    def home_of(v: pa.Array) -> pa.Array:
        out = np.zeros(len(v), dtype=np.int32)
        for d, (rows, x) in _matrix(v).items():
            out[rows] = routes.value.best(d, x)
        return pa.array(out)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def reached(v: pa.Array, least: pa.Array) -> pa.Array:
        floor = np.array([-np.inf if x is None else float(x) for x in least.to_pylist()])
        out: list = [None] * len(v)
        for d, (rows, x) in _matrix(v).items():
            for row, own in zip(rows, routes.value.reached(d, x, floor[rows])):
                out[row] = own
        return pa.array(out, type=pa.list_(pa.int32()))

    counts: dict[int, int] = {}
    for r in found_boxes:
        counts[r.cell] = counts.get(r.cell, 0) + r.n
    several = {c: -(-n // shard_rows) for c, n in counts.items()}
    shards_of = F.create_map(*[F.lit(x) for c, n in several.items() for x in (c, n)]) if several else F.create_map(F.lit(-1), F.lit(1))
    shards = lambda c: F.coalesce(shards_of[c], F.lit(1)).cast("long")
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), shards(F.col("cell"))).cast("int")
    dealt = placed.select("id", "v", "cell", shard.alias("shard"))

    # names of its own: both tables may come from one
    asking = checkpointed(queries.groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("id"), F.col("v").alias("v")))
    n_queries = asking.count()
    blocks = max(1, -(-n_queries // query_block))
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[int]] = {}
        if left.num_rows and right.num_rows:
            for q, _, s in zip(*search_shard(left, right, k, np.full(left.num_rows, -np.inf))):
                found.setdefault(q, []).append(s)
        ids = [q for q, s in found.items() if len(s) >= k]
        return pa.table({"id": pa.array(ids, pa.int64()), "least": pa.array([min(found[q]) for q in ids], pa.int64())})

    def hits(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            least = np.array([-np.inf if x is None else float(x) for x in left.column("least").to_pylist()])
            out = search_shard(left, right, k, least)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    def apart(df: DataFrame) -> DataFrame:
        """The same columns, not taken for those of a table that ``df`` was joined with."""
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    # a query's home is one shard of its best cell; a hot home has as many blocks of queries as it needs
    homes = asking.select("id", "v", home_of("v").alias("cell"))
    homes = checkpointed(homes.select("id", "v", "cell", F.pmod(F.xxhash64("id", F.lit("home")), shards(F.col("cell"))).cast("int").alias("shard")))
    crowd = checkpointed(homes.groupBy("cell", "shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks")))
    with_block = homes.join(crowd, ["cell", "shard"]).select("id", "v", "cell", "shard", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int").alias("block"))
    near = dealt.join(crowd, ["cell", "shard"]).select("id", "v", "cell", "shard", spread(F.col("blocks")).alias("block"))
    key = ("cell", "shard", "block")
    known = apart(with_block).groupBy(*key).cogroup(near.groupBy(*key)).applyInArrow(floors, _FLOOR)

    floored = asking.join(known, "id", "left").select("id", "v", "least")
    asked = checkpointed(floored.select("id", "v", "least", block.alias("block"), F.explode(reached("v", "least")).alias("cell")))
    if sent is not None:
        sent |= {"all": n_queries * len(several), "searched": asked.count()}
    wanted = apart(asked.select("cell", "block").distinct())
    asked = asked.select("*", spread(shards(F.col("cell"))).alias("shard"))
    seen = dealt.join(wanted, "cell").select("id", "v", *key)
    found = apart(asked).groupBy(*key).cogroup(seen.groupBy(*key)).applyInArrow(hits, _HIT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
