"""Mass peaks: extraction of channels from spectra, ppm chains, redundancy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ppm import bounds


def above(peaks: DataFrame, least: float, intensity: str = "intensity", mz: str = "mz") -> DataFrame:
    """Peaks of at least an intensity; order by mass is logical and left to whoever needs it."""
    return peaks.where(F.col(intensity) >= least)


def extract_channel(scans: DataFrame, peaks: DataFrame, target: float, ppm: float | str = 10, mode: str = "nearest", keys: Sequence[str] = ("scan",), order: Sequence[str] = (), mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """One row per scan: mass nearest to ``target`` within tolerance, with its intensity, or the sum or maximum of all in tolerance.

    ``n_peaks``: how many were within tolerance.  Scans without any have nulls and 0.  Of equally near
    peaks the first in ``order`` counts.
    """
    low, high = bounds(F.lit(float(target)), ppm)
    inside = peaks.where(F.col(mz).between(low, high))
    away = F.struct(F.abs(F.col(mz) - target), *order)
    value = {"nearest": F.min_by(intensity, away), "sum": F.sum(intensity), "max": F.max(intensity)}[mode]
    best = inside.groupBy(*keys).agg(F.min_by(mz, away).alias("mz"), value.alias("intensity"), F.count("*").alias("n_peaks"))
    return scans.join(best, list(keys), "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)).cast("long"))


def kde_argmax(values: np.ndarray, points: int = 10_000, chunk: int = 2_000) -> float:
    """Where a Gaussian kernel density is highest, on a grid from least to greatest; a constant is itself."""
    values = np.sort(values[~np.isnan(values)])
    if not len(values):
        return float("nan")
    sd = values.std(ddof=1) if len(values) > 1 else 0.0
    if sd == 0 or values[0] == values[-1]:
        return float(values[0])
    width = sd * len(values) ** -0.2
    grid = np.linspace(values[0], values[-1], max(points, len(values)))
    step = (values[-1] - values[0]) / (len(grid) - 1) / width

    def density(places: np.ndarray) -> np.ndarray:
        out, cuts = [], np.flatnonzero(np.diff(places // chunk)) + 1
        for part in np.split(places, cuts):
            lo = part[0] // chunk * chunk
            a, b = np.searchsorted(values, (grid[lo] - 40 * width, grid[min(lo + chunk, len(grid)) - 1] + 40 * width))  # further kernels are zero in double precision
            out += [np.exp(-0.5 * ((grid[few][:, None] - values[None, a:b]) / width) ** 2).sum(axis=1) for few in np.split(part, range(chunk, len(part), chunk))]
        return np.concatenate(out)

    # between two places ``d`` bandwidths apart the density bends by no more than the values within a bandwidth
    # give, each of which adds exp(-(1 + d)^2 / 2) at the least to it at either: where it can't reach the
    # greatest found, no place needs a look
    strides = [int(d / step) for d in (0.1, 0.01) if d > 2 * step] + [1]
    places = np.unique(np.r_[np.arange(0, len(grid), strides[0]), len(grid) - 1])
    found = density(places)
    best, at = found.max(), int(places[found.argmax()])
    left, right, high = places[:-1], places[1:], np.maximum(found[:-1], found[1:])
    for wide, fine in zip(strides, strides[1:]):
        d = wide * step
        live = high * (1 + d * d / 8 * math.exp((1 + d) ** 2 / 2) + 1e-9) >= best
        left, right = left[live], right[live]
        places = np.minimum(left[:, None] + np.arange(0, wide + fine, fine)[None, :], right[:, None])
        found = density(places.ravel()).reshape(places.shape)
        top = found.max()
        if top >= best:
            first = int(places.ravel()[found.argmax()])
            best, at = top, min(first, at) if top == best else first
        left, right, high = places[:, :-1].ravel(), places[:, 1:].ravel(), np.maximum(found[:, :-1], found[:, 1:]).ravel()
    return float(grid[at])


#: Moments of a bin that the density is made from, and the width of bins in bandwidths: together exact to rounding.
MOMENTS, BIN = 14, 0.25
#: Bandwidths beyond which a kernel adds nothing to the greatest density.
FAR = 9.0


def density_at(x: np.ndarray, bins: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Density (not normed) at ``x``, in bandwidths, of values given by their bins' moments about the middles.

    The Gaussian is expanded about each bin's middle in Hermite polynomials.
    """
    out = np.zeros(len(x))
    reach = FAR + BIN
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        a, b = np.searchsorted(bins, ((part.min() - reach) / BIN - 1, (part.max() + reach) / BIN + 1))
        t = part[:, None] - (bins[a:b] + 0.5)[None, :] * BIN
        before, now, total, factor = np.zeros_like(t), np.ones_like(t), np.zeros_like(t), 1.0
        for k in range(MOMENTS):
            total += moments[a:b, k] / factor * now
            before, now, factor = now, t * now - k * before, factor * (k + 1)
        out[lo : lo + 512] = (total * np.exp(-0.5 * t * t)).sum(axis=1)
    return out


def _large_centers(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, points: int, fields: str, block: int = 256) -> DataFrame:
    """Density centres of groups of any size: moments by bins of a part of the bandwidth are summed, and blocks of bins look for the greatest density among their grid points."""
    wide = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    x = (F.col(value) - F.col("_lo")) / F.col("_h")
    place = F.floor(F.col("_x") / BIN).cast("long")
    placed = df.join(stats.withColumn("_h", wide), list(keys)).select(*keys, "_n", "_lo", "_hi", "_h", F.col(weight).alias("_w"), x.alias("_x")).withColumn("_bin", place)
    away = F.col("_x") - (F.col("_bin") + 0.5) * BIN
    power, sums = F.col("_w").cast("double"), []
    for k in range(MOMENTS):
        sums.append(F.sum(power).alias(f"_m{k}"))
        power = power * away
    binned = placed.groupBy(*keys, "_n", "_lo", "_hi", "_h", "_bin").agg(*sums)
    halo = math.ceil(FAR / BIN) + 1
    spots = F.sequence(F.floor((F.col("_bin") - halo) / block), F.floor((F.col("_bin") + halo) / block))
    blocks = binned.withColumn("_block", F.explode(spots))

    def run(key, table):
        table = table.sort_by("_bin")
        bins, moments = table.column("_bin").to_numpy(), np.stack([table.column(f"_m{k}").to_numpy() for k in range(MOMENTS)], axis=1)
        n, lo, hi, h = (table.column(c)[0].as_py() for c in ("_n", "_lo", "_hi", "_h"))
        count, at = max(points, n), key[-1].as_py()
        step = (hi - lo) / (count - 1)
        first = max(0, math.ceil(at * block * BIN * h / step - 1e-6))
        stop = min(count, math.ceil((at + 1) * block * BIN * h / step + 1e-6))
        best, where = -1.0, -1
        for a in range(first, stop, 1 << 16):
            places = np.arange(a, min(stop, a + (1 << 16)))
            density = density_at(places * (step / h), bins, moments)
            k = int(density.argmax())
            if density[k] > best:
                best, where = float(density[k]), int(places[k])
        grid = lo + where * step if where < count - 1 else hi
        return pa.table({**{k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key)}, "_density": [best], "_place": pa.array([where], pa.int64()), out: [float(grid)]})

    found = blocks.groupBy(*keys, "_block").applyInArrow(run, f"{fields}, _density double, _place long, {out} double")
    least = F.struct((-F.col("_density")).alias("d"), F.col("_place").alias("p"), F.col(out).alias("c"))
    return found.where("_place >= 0").groupBy(*keys).agg(F.min(least).alias("_b")).select(*keys, F.col("_b.c").alias(out))


def density_center(df: DataFrame, keys: Sequence[str], value: str = "mz", out: str = "center", points: int = 10_000, weight: str | None = None, kernel_rows: int = 1 << 14) -> DataFrame:
    """``center`` of each group by :func:`kde_argmax`, null for a group without values; ``weight`` has how often a value counts.

    A group of up to ``kernel_rows`` values is one kernel call.  A larger one is never brought together: its
    values are summed by bins, and a task holds the bins of a block and their halo.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    own = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"))
    there = own.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0))
    base = there.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_mean"))
    big = base.where((F.col("_n") > kernel_rows) & (F.col("_lo") < F.col("_hi")))
    spread = there.join(big, list(keys)).groupBy(*keys, "_n", "_lo", "_hi").agg(F.sum(F.pow(F.col("_v") - F.col("_mean"), 2) * F.col("_w")).alias("_s"))
    stats = spread.select(*keys, "_n", "_lo", "_hi", F.sqrt(F.col("_s") / (F.col("_n") - 1)).alias("_sd"))
    large = _large_centers(there, stats, keys, "_v", "_w", out, points, fields)
    few = base.where((F.col("_n") <= kernel_rows) & (F.col("_lo") < F.col("_hi"))).select(*keys)

    # a row for each group, so that many small groups are no more calls than a few; few bytes are much work here,
    # so the number of tasks is stated
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = there.join(few, list(keys), "left_semi").repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list(F.struct("_v", "_w")).alias("_vw"))

    def run(batches):
        for batch in batches:
            held, ends = batch.column("_vw"), batch.column("_vw").offsets.to_numpy()
            v, w = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("_v", "_w"))
            found = [kde_argmax(np.repeat(v[a:b], w[a:b]), points) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64(), from_pandas=True)], names=[*batch.schema.names[:-1], out])

    small = lists.mapInArrow(run, f"{fields}, {out} double")
    flat = base.where(F.col("_lo") == F.col("_hi")).select(*keys, F.col("_lo").alias(out))
    there_too = F.when(F.col("_v").isNotNull() & ~F.isnan("_v"), F.col("_w")).otherwise(0)
    none = own.groupBy(*keys).agg(F.sum(there_too).alias("_n")).where("_n <= 0").select(*keys, F.lit(None).cast("double").alias(out))
    return small.unionByName(large).unionByName(flat).unionByName(none)


def intensity_threshold(peaks: DataFrame, intensity: str = "intensity") -> DataFrame:
    """One row with the mean and the median of all intensities, nulls passed over."""
    return peaks.agg(F.avg(intensity).alias("mean"), F.median(intensity).alias("median"))


def extract_channel_twice(scans: DataFrame, peaks: DataFrame, target: float, ppm: float = 10, first_ppm: float = 20, **options) -> tuple[DataFrame, float]:
    """A wide pass, the density centre of the masses it finds, and a pass around that centre; gives the centre too."""
    wide = extract_channel(scans, peaks, target, first_ppm, **options).where("mz is not null").select(F.lit(0).alias("g"), "mz")
    row = density_center(wide, ["g"]).first()
    center = float(row.center) if row is not None and row.center is not None else float(target)
    return extract_channel(scans, peaks, center, ppm, **options), center


def chains(df: DataFrame, keys: Sequence[str], ppm: float = 10, mz: str = "mz", tie: Sequence[str] = (), *, strict: bool = False, smaller: bool = False) -> DataFrame:
    """``island``: within each group, masses in order chain on while the gap to the one before is within ``ppm`` of it.

    ``strict``: the gap must be below; ``smaller``: measured from the smaller mass (which it is, sorted).
    """
    w = Window.partitionBy(*keys).orderBy(mz, *tie)
    before = F.lag(mz).over(w)
    gap = (F.col(mz) - before) / before * 1e6
    apart = (gap >= ppm) if strict else (gap > ppm)
    return df.withColumn("island", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w).cast("long"))


def merge_chains(df: DataFrame, keys: Sequence[str], ppm: float = 10, mz: str = "mz", intensity: str = "intensity", tie: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The most intense peak of each chain, the first in mass order of equals."""
    marked = chains(df, keys, ppm, mz, tie)
    rest = [c for c in dict.fromkeys([mz, *tie, *keep])]
    # greatest intensity, then least mass: the negated order keys make one maximum of both
    best = marked.groupBy(*keys, "island").agg(F.min(F.struct((-F.col(intensity)).alias("_i"), *rest)).alias("_b"))
    return best.select(*keys, "island", (-F.col("_b")["_i"]).alias(intensity), *(F.col("_b")[c].alias(c) for c in rest))


def global_chains(df: DataFrame, ppm: float = 10, mz: str = "mz", tie: Sequence[str] = (), *, strict: bool = False) -> DataFrame:
    """``island`` over all rows, without a window over all rows.

    Rows are cut into coarse mass buckets; each bucket chains by itself, and a bucket's first chain
    goes on from the last row of the bucket before it where the gap allows.  Only one summary row
    per bucket, whose number is bounded by the mass range, is ordered globally.
    """
    width = 64 * math.log1p(ppm * 1e-6)
    cut = df.withColumn("_bucket", F.floor(F.ln(F.col(mz)) / width))
    marked = chains(cut, ["_bucket"], ppm, mz, tie, strict=strict)
    sides = marked.groupBy("_bucket").agg(F.min(mz).alias("_lo"), F.max(mz).alias("_hi"), F.max("island").alias("_n"))
    w = Window.orderBy("_bucket")
    gap = (F.col("_lo") - F.lag("_hi").over(w)) / F.lag("_hi").over(w) * 1e6
    joins = F.coalesce((~((gap >= ppm) if strict else (gap > ppm))).cast("int"), F.lit(0))
    summed = sides.withColumn("_joins", joins).withColumn("_base", F.sum(F.col("_n") - F.col("_joins")).over(w) - F.col("_n"))
    return marked.join(summed.select("_bucket", "_base"), "_bucket").withColumn("island", (F.col("island") + F.col("_base")).cast("long")).drop("_bucket", "_base")


def strongest(df: DataFrame, keys: Sequence[str], intensity: str = "intensity", tie: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the most intense, the first in ``tie`` order of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(intensity).desc(), *tie)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def conflicts(df: DataFrame, keys: Sequence[str], ppm: float = 10, mz: str = "mz", tie: Sequence[str] = ()) -> DataFrame:
    """Rows closer than ``ppm`` to their neighbour in mass (measured from the lower one), each once."""
    w = Window.partitionBy(*keys).orderBy(mz, *tie)
    low = (F.col(mz) - F.lag(mz).over(w)) / F.lag(mz).over(w) * 1e6 < ppm
    high = (F.lead(mz).over(w) - F.col(mz)) / F.col(mz) * 1e6 < ppm
    return df.withColumn("_close", F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False))).where("_close").drop("_close")
