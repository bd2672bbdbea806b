"""Hard negatives by inverted lists of k-means clusters with centroid radii.

Every row goes to the list of its nearest centroid; a centroid keeps the greatest distance of its rows.
By the Cauchy-Schwarz inequality no row of a list scores above ``q.c + |q| r`` with the query ``q``, and
none below ``q.c - |q| r``.  A query visits lists by falling upper bound: first the few highest, then in
growing strides those whose bound isn't strictly below the score of its k-th find so far; lists that lie
wholly outside its window are skipped.  So the search is exact whatever the centroids are, and they are
fitted on a bounded sample.

A query is sent to the lists it visits only.  A list is cut into parts of bounded size by a hash, which a
hot vector can't fill; a part is held by one task, past which the queries are streamed in blocks.  Finds
are merged by rank and written between strides.  The search runs twice: for the positives (the same label,
no window), then for the negatives (other labels, a window for each positive).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, finite, main_length, matrix_of, settle

LEAST, MOST = -(1 << 62), 1 << 62
_WINDOW = "struct<name:int,lo:bigint,hi:bigint>"


class Lists:
    """The index: rows ``place, vec_id, label, y`` (``place`` numbers the parts of lists), the table they are held in, and of each list centroid, radius, first part and number of parts."""

    def __init__(self, rows: DataFrame, held: DataFrame, centroids: np.ndarray, radii: np.ndarray, first: np.ndarray, parts: np.ndarray):
        self.rows, self.held, self.centroids, self.radii, self.first, self.parts = rows, held, centroids, radii, first, parts


def _assign(centroids):
    """Adds to each row its nearest centroid and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = matrix_of(batch.column("y"), c.shape[1]).astype(np.float64)
                near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)  # rounding may miss the nearest, which does no harm
                away = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "list", "away"])

    return run


def build(rows: DataFrame, lists: int | None = None, fit_rows: int = 20_000, part_rows: int = 8192, most_lists: int = 4096, seed: int = 7) -> Lists | None:
    """The lists of ``rows(vec_id, label, y)``, written to the shared folder; None without rows.

    The root of the number of rows is the number of lists, up to ``most_lists``; their centroids are fitted
    on at most ``fit_rows`` rows, those of the smallest hashes.  Lists and their sizes come to the driver,
    bounded by ``most_lists``.
    """
    spark = rows.sparkSession
    sample = settle(rows.orderBy(F.xxhash64("vec_id", "y"), "vec_id").limit(fit_rows).select("y"))
    n = rows.count()
    if not n:
        return None
    k = min(lists or int(n**0.5), most_lists, n)
    data = sample.select(array_to_vector(F.col("y").cast("array<double>")).alias("v"))
    centroids = np.array(KMeans(k=k, seed=seed, maxIter=5, initSteps=1, featuresCol="v").fit(data).clusterCenters()) if k > 1 else np.zeros((1, len(sample.first()["y"])))
    discard(spark, sample)
    shared = spark.sparkContext.broadcast(centroids)
    dealt = settle(rows.mapInArrow(_assign(shared), "vec_id long, label long, y array<bigint>, list int, away double").withColumn("turn", F.monotonically_increasing_id()))
    sizes = {r["list"]: r for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    used = sorted(sizes)
    parts = np.array([-(-sizes[i]["n"] // part_rows) for i in used], np.int64)
    first = np.cumsum(parts) - parts
    places = spark.createDataFrame([(i, int(a), int(p)) for i, a, p in zip(used, first, parts)], "list int, first long, parts long")
    # rows of a list, alike or not, go to its parts in turn
    placed = dealt.join(F.broadcast(places), "list").select((F.col("first") + F.pmod("turn", "parts")).alias("place"), "vec_id", "label", "y")
    return Lists(placed, dealt, centroids[used], np.array([sizes[i]["r"] for i in used]), first, parts)


def _send(held, seen: int, stop: int):
    """Queries with the parts they visit: of the lists by falling upper bound, those from ``seen`` to ``stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radii, first, parts = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                windows = batch.column("windows").to_pylist()
                q = matrix_of(batch.column("y"), c.shape[1]).astype(np.float64)
                length = np.sqrt((q * q).sum(axis=1))[:, None]
                middle, reach = q @ c.T, length * radii[None, :]
                hair = 1e-9 * length * (np.sqrt((c * c).sum(axis=1)) + radii)[None, :] + 1e-6
                high, low = middle + reach + hair, middle - reach - hair
                least = np.array([min((w["lo"] for w in ws), default=MOST) for ws in windows], np.float64)
                most = np.array([max((w["hi"] for w in ws), default=LEAST) for ws in windows], np.float64)
                order = np.argsort(-high, axis=1, kind="stable")[:, seen:stop]
                go = (np.take_along_axis(high, order, 1) >= least[:, None]) & (np.take_along_axis(low, order, 1) <= most[:, None])
                who, col = np.nonzero(go)
                to = order[who, col]
                times = parts[to]
                who = np.repeat(who, times)
                place = np.repeat(first[to], times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                for lo in range(0, len(who), 4096):
                    sent = batch.take(pa.array(who[lo : lo + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(place[lo : lo + 4096]), *sent.columns], names=["place", *sent.schema.names])

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held within LEAST and MOST."""
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, LEAST, MOST).astype(np.int64)


def _best(score: np.ndarray, fits: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of its ``k`` highest fitting scores, ties by name."""
    if score.shape[1] > k:
        held = np.where(fits, score, LEAST - 1)
        limit = np.partition(held, -k, axis=1)[:, -k]
        fits = fits & (score >= limit[:, None])
    row, col = np.nonzero(fits)
    order = np.lexsort((names[col], -score[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], col[keep]


_FOUND = pa.schema([("query_id", pa.int64()), ("name", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _visit(same: bool, k: int, width: int, block: int):
    """Rows come sorted by part, its own before the queries: (place, asks, vec_id, label, y, windows)."""

    def answer(names: np.ndarray, labels: np.ndarray, x: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, label = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        score = _products(matrix_of(part.column("y"), width), x)
        fits = (own[:, None] != names[None, :]) & ((label[:, None] == labels[None, :]) == same)
        windows = part.column("windows").to_pylist()
        for i in range(max(map(len, windows), default=0)):
            name, lo, hi = (np.array([ws[i][f] if i < len(ws) else other for ws in windows], np.int64) for f, other in (("name", 0), ("lo", MOST), ("hi", LEAST)))
            row, col = _best(score, fits & (score >= lo[:, None]) & (score <= hi[:, None]), names, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(name[row].astype(np.int32)), pa.array(names[col]), pa.array(score[row, col])], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tables = None, [], None
        for batch in batches:
            spot = batch.column("place").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(spot)) + 1, len(spot)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if spot[lo] >> 1 != place:
                    place, held, tables = spot[lo] >> 1, [], None
                if spot[lo] % 2 == 0:
                    held.append(part)
                    continue
                if tables is None and held:
                    tables = [np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("vec_id", "label")] + [np.concatenate([matrix_of(h.column("y"), width) for h in held])]
                    held = []
                for at in range(0, part.num_rows if tables else 0, block):
                    yield from answer(*tables, part.slice(at, block))

    return run


def search(index: Lists, queries: DataFrame, k: int, same: bool, first: int = 8, block: int = 128) -> DataFrame:
    """``query_id, name, vec_id, score``: for each window of each query its ``k`` highest scores among the rows of the same label (or of others), ties by id.

    ``queries`` has ``vec_id, label, y`` and ``windows``, of ``name, lo, hi`` each (closed).  A window's
    lower end rises to its k-th find after each stride, of which each is eight times as long as the one before.
    """
    spark = queries.sparkSession
    width, lists = index.centroids.shape[1], len(index.radii)
    places = int(index.parts.sum())
    tasks = min(places, max(int(spark.conf.get("spark.sql.shuffle.partitions")), places // 8))
    held = spark.sparkContext.broadcast((index.centroids, index.radii, index.first, index.parts))
    kinds = f"vec_id long, label long, y array<bigint>, windows array<{_WINDOW}>"
    found, seen, stride = None, 0, first
    while seen < lists:
        asks = queries
        if found is not None:
            full = found.groupBy("query_id", "name").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            rise = full.groupBy(F.col("query_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("name", "kth"))).alias("rise"))
            raised = F.transform("windows", lambda w: F.struct(w["name"].alias("name"), F.greatest(w["lo"], F.coalesce(F.try_element_at("rise", w["name"]), w["lo"])).alias("lo"), w["hi"].alias("hi")))
            asks = queries.join(rise, "vec_id", "left").withColumn("windows", raised).drop("rise")
        sent = asks.select("vec_id", "label", "y", "windows").mapInArrow(_send(held, seen, seen + stride), f"place long, {kinds}")
        if found is None or not sent.isEmpty():
            met = index.rows.select("place", F.lit(0).alias("asks"), "vec_id", "label", "y", F.lit(None).cast(f"array<{_WINDOW}>").alias("windows"))
            met = met.unionByName(sent.withColumn("asks", F.lit(1))).repartition(tasks, "place").sortWithinPartitions("place", "asks")
            new = met.mapInArrow(_visit(same, k, width, block), "query_id long, name int, vec_id long, score long")
            every = new if found is None else found.unionByName(new)
            order = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
            before, found = found, settle(every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth"))
            if before is not None:
                discard(spark, before)
        seen, stride = seen + stride, stride * 8
    return found


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    lists: int | None = None,
    part_rows: int = 8192,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that meet the condition.  Components become ``floor(scale * x)``, scores are whole
    inner products.  An anchor's positives are its ``positives`` best rows of its label; for each positive
    come the ``negatives`` best rows of other labels that score 50 to 95 percent of it (so none where its
    score is negative), ties by the smaller id.

    Rows with a null id or label, and vectors that are null, empty or hold a null or non-finite component,
    take no part, nor do those of another length than the most common one.  A row with the anchor's own id is
    never its positive or negative; of anchors with one id the least label and vector ask; repeated candidate
    rows each count and can be found twice.  Fewer candidates give fewer rows; without a negative a positive
    has none.  Components and scores beyond 2^62 are held there.  Vectors of any length are used whole.
    Other columns are not read.  An empty table gives no rows.  The search runs when this is called, stride
    by stride.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    v = vectors[vector_col].cast("array<double>")
    kept = vectors.where(finite(v) & vectors[id_col].isNotNull() & vectors[label_col].isNotNull())
    own = kept.select(kept[id_col].cast("long").alias("vec_id"), kept[label_col].cast("long").alias("label"), v.alias("v"), anchors.alias("asks"))
    width = main_length(own, "v")
    whole = F.transform("v", lambda x: F.floor(F.least(F.lit(float(MOST)), F.greatest(F.lit(float(LEAST)), x * F.lit(float(scale))))).cast("long"))
    rows = own.where(F.size("v") == width).select("vec_id", "label", whole.alias("y"), "asks")
    index = build(rows.drop("asks"), lists, part_rows=part_rows) if width else None
    if index is None:
        return spark.createDataFrame([], out)
    asked = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "y")).alias("s")).select("vec_id", "s.label", "s.y")
    all_scores = F.array(F.struct(F.lit(0).alias("name"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    asked = settle(asked.withColumn("windows", all_scores))
    near = search(index, asked, positives, True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = settle(near.select("query_id", F.row_number().over(order).alias("name"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    lo = F.expr("(positive_score + pmod(positive_score, 2)) div 2")
    hi = F.expr("(positive_score - pmod(positive_score, 20)) div 20 * 19 + 19 * pmod(positive_score, 20) div 20")
    windows = pairs.select(F.col("query_id").alias("vec_id"), "name", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").groupBy("vec_id").agg(F.collect_list(F.struct("name", "lo", "hi")).alias("windows"))
    second = settle(asked.drop("windows").join(windows, "vec_id"))
    hard = search(index, second, negatives, False)
    discard(spark, near, asked, second, index.held)
    by_rank = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    ranked = hard.withColumn("rank", F.row_number().over(by_rank)).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return ranked.join(pairs, ["query_id", "name"]).select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
