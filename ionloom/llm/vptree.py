"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Every vector is dealt to a shard by a hash of its id and values and indexed there: a tree splits its
vectors at the median distance from a vantage point until at most ``leaf`` remain.  A shard is one
task: its tree is built once, and all queries are streamed past it in blocks.  A block
descends the tree together: a subtree is entered only by those queries for which the triangle
inequality, relaxed by ``slack``, can't rule out a vector nearer than the tenth found so far.  With
``slack`` 1 the search is exact; above 1, subtrees are passed over sooner.

The shards' results for a query, ``k`` rows each, are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, each sum taken in the order of the components."""
    total = np.zeros(np.broadcast_shapes(points.shape[:-1], query.shape[:-1]))
    for j in range(points.shape[-1]):
        d = points[..., j] - query[..., j]
        total += d * d
    return np.sqrt(total)


class VantageTree:
    """Nodes hold the vantage point's row, the least and greatest distances of each half, and the halves."""

    def __init__(self, points: np.ndarray, leaf: int = 512, seed: int = 5):
        self.points, self.leaf = points, leaf
        self.random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points))) if len(points) else -1

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) <= self.leaf:
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        tries = self.random.choice(rows, size=min(8, len(rows)), replace=False)
        some = self.points[self.random.choice(rows, size=min(64, len(rows)), replace=False)]
        vantage = max(tries.tolist(), key=lambda r: float(np.var(distances(some, self.points[r]))))
        away = distances(self.points[rows], self.points[vantage])
        half = len(rows) // 2
        order = np.argpartition(away, half)
        near, far = order[:half], order[half:]
        ranges = (away[near].min(), away[near].max(), away[far].min(), away[far].max())
        at = len(self.nodes)
        self.nodes.append(())
        left, right = self._build(rows[near]), self._build(rows[far])
        self.nodes[at] = (vantage, ranges, left, right)
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, names: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``k`` nearest rows (by distance, then name), itself left out; -1 pads."""
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.queries, self.own, self.names, self.k, self.slack = queries, own, names, k, slack
        if self.root >= 0:
            self._visit(self.root, np.arange(len(queries)))
        return self.best, self.found

    def _visit(self, node: int, who: np.ndarray) -> None:
        held = self.nodes[node]
        if len(held) == 1:
            self._scan(held[0], who)
            return
        vantage, (a, b, c, d), left, right = held
        away = distances(self.queries[who], self.points[vantage])
        low = np.maximum(np.maximum(a - away, away - b), 0.0)  # no vector of the half is nearer than this
        high = np.maximum(np.maximum(c - away, away - d), 0.0)
        near_first = low <= high
        sides = ((left, low), (right, high))
        for order, mask in (((0, 1), near_first), ((1, 0), ~near_first)):
            if mask.any():
                for s in order:
                    child, bound = sides[s]
                    # rounding leaves a hair, so that ties of the last found are still seen
                    go = mask & (self.slack * bound[:] <= self.best[who, -1] * (1 + 1e-9))
                    if go.any():
                        self._visit(child, who[go])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        # a matrix product says which can be among the nearest; these get their distance exactly
        near, asked = self.points[rows], self.queries[who]
        squares, lengths = (near * near).sum(axis=1), (asked * asked).sum(axis=1)
        rough = lengths[:, None] + squares[None, :] - 2 * asked @ near.T
        hair = (1e-12 + 1e-15 * near.shape[1]) * (lengths[:, None] + squares[None, :])
        # what overflows isn't ruled out
        row, col = np.nonzero(~(rough > self.best[who, -1][:, None] ** 2 * (1 + 1e-12) + hair))
        keep = self.own[who[row]] != self.names[rows[col]]
        row, col = row[keep], col[keep]
        if not len(row):
            return
        met, row = np.unique(row, return_inverse=True)
        who = who[met]
        exact = distances(near[col], asked[met[row]])
        # of each query, its finds side by side
        count = np.bincount(row, minlength=len(who))
        place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        away, found = np.full((len(who), count.max()), np.inf), np.full((len(who), count.max()), -1, np.int64)
        away[row, place], found[row, place] = exact, rows[col]
        every = np.concatenate([self.best[who], away], axis=1)
        which = np.concatenate([self.found[who], found], axis=1)
        order = np.lexsort((np.where(which < 0, np.iinfo(np.int64).max, self.names[which]), every), axis=1)[:, : self.k]
        self.best[who] = np.take_along_axis(every, order, 1)
        self.found[who] = np.where(np.isinf(self.best[who]), -1, np.take_along_axis(which, order, 1))


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _collapse(k: int):
    """Of rows alike in id and vector, ``k`` in a batch: more of them can't be among the ``k`` nearest, and a row that is repeated without end meets no single task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
            keep = np.ones(len(names), bool)
            seen: dict[tuple, int] = {}
            for i in np.flatnonzero(counts[inverse] > k).tolist():
                row = (int(names[i]), batch.column(1)[i].values.to_numpy().tobytes())
                seen[row] = seen.get(row, 0) + 1
                keep[i] = seen[row] <= k
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return run


def _plant(held: list[pa.RecordBatch], leaf: int) -> dict[int, tuple[np.ndarray, VantageTree]]:
    """For each length of vectors, their names and their tree."""
    if not held:
        return {}
    shard = pa.Table.from_batches(held).combine_chunks()
    sizes = pc.list_value_length(shard.column("v")).to_numpy()
    out = {}
    for n in np.unique(sizes).tolist():
        own = shard.filter(pa.array(sizes == n))
        out[n] = (own.column("vec_id").to_numpy(), VantageTree(_matrix(own.column("v")), leaf))
    return out


def _search_shards(k: int, leaf: int, slack: float, block: int):
    """Rows come sorted by shard, its vectors before the queries: (shard, asks, vec_id, v)."""

    def answer(trees: dict, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(queries.column("v")).to_numpy(zero_copy_only=False)
        for n, (names, tree) in trees.items():
            fits = queries.filter(pa.array(sizes == n))
            for lo in range(0, fits.num_rows, block):
                part = fits.slice(lo, block)
                own = part.column("vec_id").to_numpy()
                best, found = tree.search(_matrix(part.column("v")), own, names, k, slack)
                at, col = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(names[found[at, col]]), pa.array(best[at, col])], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], None
        for batch in batches:
            place = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(place)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if place[lo] >> 1 != shard:
                    shard, held, trees = place[lo] >> 1, [], None
                if place[lo] % 2 == 0:
                    held.append(part)
                    continue
                if trees is None:
                    trees, held = _plant(held, leaf), []
                yield from answer(trees, part)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and the vector as doubles ``v``: vectors that are null, zero or hold a null or non-finite component are left out."""
    v = vectors[vector_col].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    shard_rows: int = 1 << 15,
    leaf: int = 512,
    slack: float = 1.0,
    block: int = 256,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance): the ``k`` nearest of each query.

    A candidate with the query's own id is left out; ties go to the smaller id; with fewer
    candidates all are given.  Rows with a null id, and vectors that are null, empty, zero or hold
    null or non-finite components, take no part, neither as queries nor as candidates.  Vectors of
    another length than the query's are no candidates of it.  Repeated candidate rows each count;
    repeated query rows ask once.  Vectors of any length are compared whole.  Other columns are not
    read.  An empty table gives no rows.  The number of shards comes from a count, which runs at once;
    ``shard_rows`` bounds what a task holds, and all queries go to each shard.
    """
    points = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    n = points.count()
    # a small table still makes a shard for each shuffle partition, as long as shards are worth a tree
    wide = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard_rows), min(wide, n // (8 * leaf)))
    points = points.mapInArrow(_collapse(k), "vec_id long, v array<double>")
    dealt = points.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "vec_id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "v")
    met = dealt.unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(_search_shards(k, leaf, slack, block), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
