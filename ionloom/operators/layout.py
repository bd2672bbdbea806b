"""Layouts of a neighbour graph in a plane: UMAP by partitioned negative sampling, t-SNE by a grid.

Both keep positions as a table that is written between rounds.

*UMAP* (McInnes, Healy and Melville 2018): each round deals the points anew to parts of bounded size by a
hash, so the points of a part are a random sample of all and serve each other as negative samples; the
edges bring the positions of their other ends along.  A part then takes some epochs by itself.  A point
with very many edges is dealt out in copies, each with a share of them, and moves by their mean.

*t-SNE* (van der Maaten and Hinton 2008): what pulls is summed over the edges; what pushes is found as in
FIt-SNE (Linderman et al. 2019): the points' charges are interpolated to a regular grid of bounded size, summed
there by Spark, convolved with the kernels by FFT on the driver, and interpolated back at the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import _padded
from .storage import Step


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def curve(min_dist: float = 0.5, spread: float = 1.0) -> tuple[float, float]:
    """``a, b`` for which ``1 / (1 + a x^(2b))`` comes nearest to 1 up to ``min_dist`` and an exponential fall from there."""
    x = np.linspace(0, 3 * spread, 301)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, hold = np.array([1.0, 1.0]), 1e-2

    def off(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + p[0] * x ** (2 * p[1])) - want

    for _ in range(200):  # Levenberg-Marquardt
        z = x ** (2 * p[1])
        slope = np.stack([-z, -p[0] * z * 2 * np.log(x)], axis=1) / ((1 + p[0] * z) ** 2)[:, None]
        step = np.linalg.solve(slope.T @ slope + hold * np.eye(2), -slope.T @ off(p))
        better = (off(np.maximum(p + step, 1e-3)) ** 2).sum() < (off(p) ** 2).sum()
        p, hold = (np.maximum(p + step, 1e-3), hold / 3) if better else (p, hold * 3)
    return float(p[0]), float(p[1])


def _epochs(dims: int, a: float, b: float, epochs: int, start: int, total: int, rate: float, negatives: int, minis: int, seed: int):
    """Rows come sorted by part, its points before the edges: (part, side, id, y, p)."""

    def move(part: int, ids: np.ndarray, y: np.ndarray, heads: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
        rnd = np.random.default_rng([seed, start, part & 0x7FFFFFFF])
        at, y, n = np.searchsorted(ids, heads), y.copy(), len(ids)
        for epoch in range(start, start + epochs):
            step = rate * (1 - epoch / total)
            for _ in range(minis):
                e = np.flatnonzero(rnd.random(len(p)) < p / minis)
                i = at[e]
                away = y[i] - ends[e]
                d = (away * away).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    pull = np.where(d > 0, -2 * a * b * d ** (b - 1) / (1 + a * d**b), 0.0)
                # an edge pulls at both ends and is drawn from either, so it pulls twice
                change = 2 * np.clip(pull[:, None] * away, -4, 4)
                if n > 1:
                    other = rnd.integers(0, n, size=(len(e), negatives))
                    away = y[i][:, None, :] - y[other]
                    d = (away * away).sum(axis=2)
                    push = np.where(other == i[:, None], 0.0, 2 * b / ((0.001 + d) * (1 + a * d**b)))
                    change = change + np.clip(push[:, :, None] * away, -4, 4).sum(axis=1)
                for j in range(dims):
                    y[:, j] += step * np.bincount(i, change[:, j], minlength=n)
        return y

    def finish(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = np.concatenate([h.column("side").to_numpy() for h in held])
        ids = np.concatenate([h.column("id").to_numpy() for h in held])
        y = np.concatenate([_points(h.column("y")) for h in held])
        p = np.concatenate([h.column("p").to_numpy(zero_copy_only=False) for h in held])
        own = side == 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), _lists(move(part, ids[own], y[own], ids[~own], y[~own], p[~own]))], names=["id", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            spot = batch.column("part").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(spot)) + 1, len(spot)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                if spot[lo] != part:
                    if held:
                        yield from finish(part, held)
                    part, held = int(spot[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from finish(part, held)

    return run


def umap_layout(
    edges: DataFrame,
    start: DataFrame,
    *,
    min_dist: float = 0.5,
    spread: float = 1.0,
    rounds: int = 20,
    epochs: int = 10,
    rate: float = 1.0,
    negatives: int = 5,
    part_rows: int = 2048,
    most_edges: int = 4096,
    seed: int = 3,
) -> DataFrame:
    """``id, y``: positions of all points of ``start(id, y)``.

    ``edges``: ``a, b, weight``, each pair once, as :func:`.graphs.fuzzy_graph` gives them; ``y`` is a list of as many
    numbers as the layout has dimensions, scaled to a width of 20 at first.  An edge is drawn in an epoch with
    its weight over the greatest one.  A point without edges stays.  The same input gives the same layout
    however often a task runs.  The other ends' positions are those of the round's beginning.
    """
    spark = start.sparkSession
    a, b = curve(min_dist, spread)
    first = start.first()
    if first is None:
        return start.select("id", "y")
    dims = len(first["y"])
    edges = Step(edges.select("a", "b", "weight"))
    most = edges.df.agg(F.max("weight")).first()[0] or 1.0
    both = edges.df.select("a", "b", (F.col("weight") / most).alias("p"))
    both = Step(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")))
    edges.drop()
    degrees = both.df.groupBy(F.col("a").alias("id")).agg(F.ceil(F.count("*") / most_edges).cast("int").alias("copies"))
    heads = Step(start.select("id").join(degrees, "id", "left").select("id", F.coalesce("copies", F.lit(1)).alias("copies")))
    links = Step(both.df.join(heads.df.withColumnRenamed("id", "a"), "a").select("b", F.col("a").alias("id"), F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"), "p"))
    both.drop()
    box = start.agg(*(f(F.col("y")[j]).alias(f"{f.__name__}{j}") for j in range(dims) for f in (F.min, F.max))).first()
    low = [box[f"min{j}"] for j in range(dims)]
    scale = 20 / max(max(box[f"max{j}"] - low[j] for j in range(dims)), 1e-12)
    now = Step(start.select(F.col("id").cast("long").alias("id"), F.array(*((F.col("y")[j] - low[j]) * scale - 10 for j in range(dims))).alias("y")))
    parts = max(1, -(-now.df.count() // part_rows))
    tasks = min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4))
    for turn in range(rounds):
        part = F.pmod(F.xxhash64("id", "copy", F.lit(turn)), F.lit(parts)).alias("part")
        own = now.df.join(heads.df, "id").select("id", "y", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        own = own.select(part, F.lit(0).alias("side"), "id", "y", F.lit(0.0).alias("p"))
        sent = links.df.join(now.df.select(F.col("id").alias("b"), "y"), "b").select(part, F.lit(1).alias("side"), "id", "y", "p")
        dealt = own.unionByName(sent).repartition(tasks, "part").sortWithinPartitions("part", "side", "id", "p", "y")
        moved = dealt.mapInArrow(_epochs(dims, a, b, epochs, turn * epochs, rounds * epochs, rate, negatives, 8, seed), "id long, y array<double>")
        new = Step(moved.groupBy("id").agg(F.array(*(F.avg(F.col("y")[j]) for j in range(dims))).alias("y")))
        now.drop()
        now = new
    return now.df


def affinities(neighbours: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """``a, b, p`` in both directions: the symmetric joint probabilities of t-SNE over the neighbours given; they sum to one.

    Each row's width is the one at which its entropy is that of ``perplexity`` equal neighbours (or of all it
    has, if fewer).
    """
    lists = neighbours.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("n")).select("src", F.col("n.dst").alias("dst"), F.col("n.distance").alias("distance"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _padded(batch.column("distance"))
            there = ~np.isnan(d)
            sizes = there.sum(axis=1)
            d2 = np.where(there, d * d, np.inf)
            d2 -= d2.min(axis=1)[:, None]
            want = np.log(np.minimum(perplexity, sizes))
            low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
            for _ in range(100):
                w = np.exp(-np.where(there, d2, np.inf) * beta[:, None])
                total = w.sum(axis=1)
                entropy = np.log(total) + beta * (np.where(there, d2, 0.0) * w).sum(axis=1) / total
                flat = entropy > want
                low, high = np.where(flat, beta, low), np.where(flat, high, beta)
                beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
                beta = np.minimum(beta, 1e300)
            p = w / total[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("src").to_numpy(), sizes)), batch.column("dst").flatten(), pa.array(p[there])], names=["src", "dst", "p"])

    one = lists.mapInArrow(run, "src long, dst long, p double")
    ways = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    pairs = Step(one.select(ways.alias("e"), "p").groupBy("e.a", "e.b").agg(F.sum("p").alias("p")))  # in one pass: the neighbours are found once
    total = pairs.df.agg(F.sum("p")).first()[0] or 1.0
    return pairs.df.select("a", "b", (F.col("p") / total).alias("p"))


class Grid:
    """A square of ``side`` by ``side`` nodes over the points' box; values go to and come from it by cubic interpolation in each direction."""

    def __init__(self, low: np.ndarray, high: np.ndarray, step: float = 0.2, most: int = 1024):
        wide = float(max((high - low).max(), 1e-9))
        self.step = max(step * min(1.0, max(wide, 1e-9)), wide / (most - 4))  # a small layout gets as fine a grid for its size
        self.side = int(np.ceil(wide / self.step)) + 4
        self.low = np.asarray(low) - 1.5 * self.step

    def weights(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 16 nodes about each point and their weights."""
        t = (y - self.low) / self.step
        base = np.clip(np.floor(t).astype(np.int64) - 1, 0, self.side - 4)
        u = t - base  # nodes stand at 0, 1, 2, 3
        w = np.stack([-(u - 1) * (u - 2) * (u - 3) / 6, u * (u - 2) * (u - 3) / 2, -u * (u - 1) * (u - 3) / 2, u * (u - 1) * (u - 2) / 6], axis=-1)
        cells = (base[:, 0, None] + np.arange(4))[:, :, None] * self.side + (base[:, 1, None] + np.arange(4))[:, None, :]
        return cells.reshape(len(y), 16), (w[:, 0, :, None] * w[:, 1, None, :]).reshape(len(y), 16)

    def spread(self, y: np.ndarray) -> np.ndarray:
        """Charges 1, y0 and y1 of points (measured from the box's corner) at the nodes."""
        cells, w = self.weights(y)
        away = y - self.low
        return np.stack([np.bincount(cells.ravel(), (w * q[:, None]).ravel(), minlength=self.side**2) for q in (np.ones(len(y)), away[:, 0], away[:, 1])])

    def potentials(self, charges: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums of the squared kernel over the three charges at the nodes, and the sum of the plain kernel over all pairs."""
        n = self.side
        far = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)) * self.step
        plain = 1 / (1 + far[:, None] ** 2 + far[None, :] ** 2)
        q = np.zeros((3, 2 * n, 2 * n))
        q[:, :n, :n] = charges.reshape(3, n, n)
        hat = np.fft.rfft2(q)
        squared = np.fft.irfft2(hat * np.fft.rfft2(plain * plain), s=(2 * n, 2 * n))[:, :n, :n]
        single = np.fft.irfft2(hat[0] * np.fft.rfft2(plain), s=(2 * n, 2 * n))[:n, :n]
        return squared.reshape(3, n * n), float((charges[0] * single.ravel()).sum())

    def push(self, y: np.ndarray, field: np.ndarray) -> np.ndarray:
        """Sum of ``(y_i - y_j) / (1 + d^2)^2`` at each point."""
        cells, w = self.weights(y)
        one, first, second = ((w * f[cells]).sum(axis=1) for f in field)
        away = y - self.low
        return np.stack([away[:, 0] * one - first, away[:, 1] * one - second], axis=1)


def _field(now: DataFrame, step: float, most: int) -> tuple[Grid, np.ndarray, float]:
    """The grid of a layout, its potentials, and the sum of the kernel over all pairs of different points."""
    box = now.agg(*(f(F.col("y")[j]) for j in range(2) for f in (F.min, F.max)), F.count("*")).first()
    grid = Grid(np.array([box[0], box[2]]), np.array([box[1], box[3]]), step, most)

    def charges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, grid.side**2))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                total += grid.spread(_points(batch.column("y").slice(at, 1 << 14)))
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(q[used]) for q in total)], names=["cell", "q0", "q1", "q2"])

    summed = now.select("y").mapInArrow(charges, "cell long, q0 double, q1 double, q2 double").groupBy("cell").agg(*(F.sum(q).alias(q) for q in ("q0", "q1", "q2"))).toArrow()
    held = np.zeros((3, grid.side**2))
    for j in range(3):
        held[j, summed.column("cell").to_numpy()] = summed.column(f"q{j}").to_numpy()
    field, total = grid.potentials(held)
    return grid, field, total - box[4]


def _pulls(pairs: DataFrame, now: DataFrame) -> DataFrame:
    """``id, pull``: the sum of ``p (y_i - y_j) / (1 + d^2)`` over a point's edges."""
    met = pairs.join(now.select(F.col("id").alias("b"), F.col("y").alias("yb")), "b").join(now.select(F.col("id").alias("a"), "y"), "a")
    away = [F.col("y")[j] - F.col("yb")[j] for j in range(2)]
    q = F.col("p") / (1 + away[0] * away[0] + away[1] * away[1])
    return met.select(F.col("a").alias("id"), (q * away[0]).alias("g0"), (q * away[1]).alias("g1")).groupBy("id").agg(F.array(F.sum("g0"), F.sum("g1")).alias("pull"))


def tsne_gradient(pairs: DataFrame, now: DataFrame, exaggeration: float = 1.0, step: float = 0.2, most: int = 1024) -> DataFrame:
    """``id, y, gradient`` (with the other columns of ``now(id, y)``): the gradient of t-SNE's divergence at a layout.

    The error of the pushing part falls with the fourth power of ``step``, the distance of the grid's nodes;
    at a fifth it is below a hundredth of the part's norm (tested).  The grid has ``most`` nodes a side at most,
    so a layout wider than ``most * step`` gets a coarser one.
    """
    grid, field, total = _field(now, step, most)
    held = now.sparkSession.sparkContext.broadcast((grid, field))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, field = held.value
        for batch in batches:
            if batch.num_rows:
                g = 4 * (exaggeration * _points(batch.column("pull")) - grid.push(_points(batch.column("y")), field) / total)
                rest = batch.drop_columns(["pull"])
                yield pa.RecordBatch.from_arrays([*rest.columns, _lists(g)], names=[*rest.schema.names, "gradient"])

    pulled = now.join(_pulls(pairs, now), "id", "left").withColumn("pull", F.coalesce("pull", F.array(F.lit(0.0), F.lit(0.0))))
    return pulled.select(*now.columns, "pull").mapInArrow(run, f"{kinds}, gradient array<double>")


def tsne_layout(
    pairs: DataFrame, start: DataFrame, *, early: int = 100, late: int = 200, exaggeration: float = 12.0, rate: float | None = None, width: float = 1e-3, step: float = 0.2, most: int = 1024
) -> DataFrame:
    """``id, y``: positions in a plane of all points of ``start(id, y)``, by ``early`` steps with exaggerated pull and ``late`` ones.

    ``pairs`` as :func:`affinities` gives them.  Gradient descent with momentum and a gain for each
    coordinate; the rate is a 48th of the number of points, at least 50, without ``rate``.  The start is
    scaled to ``width``; a wider one with a smaller exaggeration needs fewer steps.  Each step is two jobs: the grid's charges, then the moves.
    """
    pairs = Step(pairs)
    box = start.agg(F.count("*").alias("n"), *(f(F.col("y")[j]) for j in range(2) for f in (F.min, F.max))).first()
    if not box["n"]:
        return start.select("id", "y")
    scale = width / max(box[2] - box[1], box[4] - box[3], 1e-12)
    rate = rate or max(50.0, box["n"] / 48)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    now = Step(start.select(F.col("id").cast("long").alias("id"), F.array((F.col("y")[0] - box[1]) * scale, (F.col("y")[1] - box[3]) * scale).alias("y"), zero.alias("speed"), F.array(F.lit(1.0), F.lit(1.0)).alias("gain")))

    def pair(f):
        return F.array(*(f(j) for j in range(2)))

    for turn in range(early + late):
        slope = tsne_gradient(pairs.df, now.df, exaggeration if turn < early else 1.0, step, most)
        momentum = 0.5 if turn < early else 0.8
        gain = pair(lambda j: F.greatest(F.lit(0.01), F.when(F.signum(F.col("gradient")[j]) != F.signum(F.col("speed")[j]), F.col("gain")[j] + 0.2).otherwise(F.col("gain")[j] * 0.8)))
        paced = slope.withColumn("gain", gain)
        fast = paced.withColumn("speed", pair(lambda j, m=momentum: m * F.col("speed")[j] - rate * F.col("gain")[j] * F.col("gradient")[j]))
        new = Step(fast.select("id", pair(lambda j: F.col("y")[j] + F.col("speed")[j]).alias("y"), "speed", "gain"))
        now.drop()
        now = new
    pairs.drop()
    return now.df.select("id", "y")


def preservation(before: DataFrame, after: DataFrame) -> float:
    """The share of ``before``'s neighbour pairs (``src, dst``) that ``after`` has too."""
    both = before.select("src", "dst").join(after.select("src", "dst"), ["src", "dst"]).count()
    return both / max(1, before.count())
