"""Signals: blocks, baselines, robust thresholds, peaks.

A signal is rows of ``key`` columns (run, marker), an integer ``index`` in acquisition order and a
``data`` value, null where nothing was measured; an index stands once in a series.  Windows are
partitioned by the key columns, and those of blocks and maxima by chunks of a series too; a block or
island is the unit of any Python kernel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import corrected_signal
from .quantiles import exact_quantiles


def blocks(df: DataFrame, keys: Sequence[str], size: int = 100, index: str = "index") -> DataFrame:
    """``block``: tumbling blocks of ``size`` rows; the last two always merge.

    A series of under two blocks has no second-last one to merge into: it is block 0.
    """
    sizes = df.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / size) - 2, F.lit(0)).alias("_last"))
    return same_keys(df, sizes, keys).withColumn("block", F.least(F.floor(F.col(index) / size), F.col("_last")).cast("long")).drop("_last")


def same_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``other``, which has a row for each of its keys; null keys are keys too."""
    named = other.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    return df.join(named, all_of([F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])).drop(*(f"_key_{k}" for k in keys))


def all_of(tests: Sequence) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def beside(df: DataFrame, keys: Sequence[str], value: Column, index: str = "index", chunk: int = 1 << 16) -> DataFrame:
    """``_x``, ``_before``, ``_after``: a row's value and those of the rows before and after it in its series.

    Series are cut into chunks of ``chunk`` positions, so a long one is many tasks; a chunk's outer rows
    find their neighbours through one summary row for each chunk.
    """
    cut = df.withColumn("_x", value).withColumn("_chunk", F.floor(F.col(index) / chunk))
    ends = cut.groupBy(*keys, "_chunk").agg(F.min(F.struct(F.col(index).alias("i"), "_x")).alias("_lo"), F.max(F.struct(F.col(index).alias("i"), "_x")).alias("_hi"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    sides = ends.select(*keys, "_chunk", F.col("_lo.i").alias("_first"), F.col("_hi.i").alias("_final"), F.lag("_hi").over(along)["_x"].alias("_prior"), F.lead("_lo").over(along)["_x"].alias("_next"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(index)
    inner = cut.withColumn("_before", F.lag("_x").over(w)).withColumn("_after", F.lead("_x").over(w))
    met = same_keys(inner, sides, [*keys, "_chunk"])
    before = F.when(F.col(index) == F.col("_first"), F.col("_prior")).otherwise(F.col("_before"))
    after = F.when(F.col(index) == F.col("_final"), F.col("_next")).otherwise(F.col("_after"))
    return met.withColumn("_before", before).withColumn("_after", after).drop("_chunk", "_first", "_final", "_prior", "_next")


def median_baseline(df: DataFrame, keys: Sequence[str], size: int = 100, index: str = "index", data: str = "data", most_missing: float = 0.8) -> DataFrame:
    """``baseline``: the block's median; null where a row is missing, and in blocks that are mostly missing."""
    cut = blocks(df, keys, size, index)
    w = Window.partitionBy(*keys, "block")
    usable = F.sum(F.col(data).isNull().cast("int")).over(w) < most_missing * F.count("*").over(w)
    base = F.when(usable & F.col(data).isNotNull(), F.median(data).over(w))
    return cut.withColumn("baseline", base)


def spline_baseline(y: np.ndarray, p: float = 0.5, lam: float = 1e3, knots: int = 100, degree: int = 3, order: int = 3, tol: float = 1e-3, max_iter: int = 100) -> np.ndarray:
    """A penalised B-spline through the baseline component of a two-part mixture.

    After de Rooij and Eilers (2012): residuals are a normal noise part and a uniform peak part; each
    point's weight is its probability of being noise, and the spline is fitted again until the
    weights settle.
    """
    n = len(y)
    x = np.linspace(-1, 1, n)
    inner = np.linspace(-1, 1, max(2, min(knots, n)))
    step = inner[1] - inner[0]
    t = np.r_[inner[0] - step * np.arange(degree, 0, -1), inner, inner[-1] + step * np.arange(1, degree + 1)]
    basis = np.zeros((n, len(t) - 1))
    at = np.clip(np.searchsorted(t, x, side="right") - 1, degree, len(t) - degree - 2)
    basis[np.arange(n), at] = 1.0
    for d in range(1, degree + 1):
        left = np.zeros((n, len(t) - 1 - d))
        for j in range(left.shape[1]):
            a, b = t[j + d] - t[j], t[j + d + 1] - t[j + 1]
            left[:, j] = (x - t[j]) / a * basis[:, j] + (t[j + d + 1] - x) / b * basis[:, j + 1]
        basis = left
    rough = np.diff(np.eye(basis.shape[1]), order, axis=0)
    penalty = lam * rough.T @ rough
    weight = np.where(y <= np.median(y), 1 - p, p) if p != 0.5 else np.full(n, 0.5)
    fit = np.full(n, np.median(y))
    for _ in range(max_iter):
        left = basis.T * weight
        try:
            fit = basis @ np.linalg.solve(left @ basis + penalty, left @ y)
        except np.linalg.LinAlgError:
            return np.full(n, np.median(y))
        rest = y - fit
        sd = np.sqrt(max((weight * rest**2).sum() / weight.sum(), 1e-300))
        noise = np.exp(-0.5 * (rest / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
        share = weight.mean()
        flat = 1 / max(np.ptp(rest), 1e-300)
        new = share * noise / (share * noise + (1 - share) * flat * (rest > 0) + 1e-300)
        if np.linalg.norm(new - weight) < tol * np.linalg.norm(weight):
            break
        weight = np.clip(new, 1e-10, 1)
    return fit


def mixture_baseline(df: DataFrame, keys: Sequence[str], size: int = 100, index: str = "index", data: str = "data", p: float = 0.5, most_missing: float = 0.8) -> DataFrame:
    """``baseline`` of each block by :func:`spline_baseline`; missing rows are filled with half the block's median for the fit and stay null."""
    cut = blocks(df, keys, size, index)
    schema = cut.withColumn("baseline", F.lit(None).cast("double")).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        y = table.column(data).to_numpy(zero_copy_only=False).astype(float)
        gone = np.isnan(y)
        base = np.full(len(y), np.nan)
        if gone.sum() < most_missing * len(y):
            filled = np.where(gone, np.median(y[~gone]) / 2, y)
            base = np.where(gone, np.nan, spline_baseline(filled, p))
        return table.append_column("baseline", pa.array(base, from_pandas=True))

    return cut.groupBy(*keys, "block").applyInArrow(run, schema)


def with_signal(df: DataFrame, data: str = "data") -> DataFrame:
    """``signal``: data above ``baseline``."""
    return df.withColumn("signal", corrected_signal(F.col(data), F.col("baseline")))


def trimmed_threshold(df: DataFrame, keys: Sequence[str], value: str = "signal", k: float = 5) -> DataFrame:
    """``threshold`` of each series: mean and ``k`` population deviations of what lies from the 5th to the 95th percentile."""
    ends = exact_quantiles(df, keys, value, [0.05, 0.95], "_ends")
    inside = df.join(ends, list(keys)).where((F.col(value) >= F.col("_ends")[0]) & (F.col(value) <= F.col("_ends")[1]))
    return inside.groupBy(*keys).agg((F.avg(value) + F.lit(float(k)) * F.stddev_pop(value)).alias("threshold"))


def local_maxima(df: DataFrame, keys: Sequence[str], value: str = "signal", index: str = "index", edge: str | None = "rising", min_height: str | None = None, threshold: float = 0.0, valley: bool = False) -> DataFrame:
    """Rows that are local maxima (minima, for ``valley``); first and last rows, and neighbours of nulls, never are.

    ``edge``: which end of a flat top counts (rising, falling, both, or None for neither).
    ``min_height``: a column with the least height; ``threshold``: the least drop to both neighbours.
    """
    d = beside(df, keys, -F.col(value) if valley else F.col(value), index)
    up, down = F.col("_x") - F.col("_before"), F.col("_after") - F.col("_x")
    rising, falling = (down <= 0) & (up > 0), (down < 0) & (up >= 0)
    tests = {"rising": rising, "falling": falling, "both": rising | falling, None: (down < 0) & (up > 0)}
    keep = tests[edge]
    if min_height is not None:
        keep &= F.col("_x") >= F.col(min_height)
    if threshold > 0:
        keep &= F.least(up, -down) >= threshold
    return d.where(keep).drop("_x", "_before", "_after")


def suppress(peaks: DataFrame, keys: Sequence[str], distance: int, height: str = "signal", index: str = "index", keep_equal: bool = False) -> DataFrame:
    """Greedy non-maximum suppression: the highest peak stays and takes out those within ``distance`` rows.

    Of equal heights the later one goes first.  Peaks are cut into islands wherever a gap is over
    ``distance``, which changes no result, so a long series is many small tasks.
    """
    if distance <= 1:
        return peaks
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.coalesce((F.col(index) - F.lag(index).over(w) > distance).cast("int"), F.lit(1))
    islands = peaks.withColumn("_island", F.sum(new).over(w))
    schema = islands.schema

    def run(table: pa.Table) -> pa.Table:
        at = table.column(index).to_numpy(zero_copy_only=False)
        h = table.column(height).to_numpy(zero_copy_only=False)
        gone = np.zeros(len(at), bool)
        for i in np.lexsort((-at, -h)):
            if not gone[i]:
                near = (np.abs(at - at[i]) <= distance) & ((h[i] > h) if keep_equal else True)
                gone |= near
                gone[i] = False
        return table.filter(pa.array(~gone))

    return islands.groupBy(*keys, "_island").applyInArrow(run, schema).drop("_island")


def numbered(df: DataFrame, keys: Sequence[str], index: str = "index", out: str = "position", chunk: int = 1 << 16) -> DataFrame:
    """``out``: the place of each row in its series, from 0; a long series is many tasks."""
    cut = df.withColumn("_chunk", F.floor(F.col(index) / chunk))
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    before = sizes.select(*keys, "_chunk", (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_size")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(index)) - 1
    met = same_keys(cut.withColumn("_at", inside), before, [*keys, "_chunk"])
    return met.withColumn(out, (F.col("_base") + F.col("_at")).cast("long")).drop("_chunk", "_base", "_at")


def flank_check(df: DataFrame, keys: Sequence[str], value: str = "baseline", index: str = "index", reach: int = 1000, most: float = 0.2) -> DataFrame:
    """``flank``: mean of the next ``reach`` rows (this one included) minus that of the previous; ``stable`` where it is below ``most``.

    Means are differences of running sums, which start anew in every chunk of a series, so they are as exact
    as sums of ``reach`` values, and a row costs the same whatever the reach is.
    """
    length = max(reach, 64)
    v = F.col(value)
    placed = numbered(df, keys, index, "_p").withColumn("_c", F.floor(F.col("_p") / length))
    w = Window.partitionBy(*keys, "_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    there = F.when(v.isNotNull(), 1).otherwise(0)
    summed = placed.withColumn("_s", F.coalesce(F.sum(v).over(w), F.lit(0.0))).withColumn("_n", F.coalesce(F.sum(there).over(w), F.lit(0)))
    total = placed.groupBy(*keys, "_c").agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("_S"), F.sum(there).alias("_N"))
    along = Window.partitionBy(*keys).orderBy("_c")
    sides = total.select(*keys, "_c", *(f(c).over(along).alias(f"{c}_{name}") for c in ("_S", "_N") for name, f in (("before", F.lag), ("after", F.lead))), F.col("_S").alias("_S_own"), F.col("_N").alias("_N_own"))
    lookup = summed.select(*keys, "_p", "_c", "_s", "_n")
    ahead = lookup.select(*keys, (F.col("_p") - reach).alias("_p"), F.col("_c").alias("_c_a"), F.col("_s").alias("_s_a"), F.col("_n").alias("_n_a"))
    behind = lookup.select(*keys, (F.col("_p") + reach).alias("_p"), F.col("_c").alias("_c_b"), F.col("_s").alias("_s_b"), F.col("_n").alias("_n_b"))
    met = same_keys(summed, sides, [*keys, "_c"])
    for other in (ahead, behind):
        named = other.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_p").alias("_q"), *(c for c in other.columns if c not in (*keys, "_p")))
        on = all_of([*(F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.col("_p") == F.col("_q")])
        met = met.join(named, on, "left").drop(*(f"_key_{k}" for k in keys), "_q")

    def mean(which: str) -> Column:
        """Of the rows from this one on (``a``) or before it (``b``), by the sums up to here and up to ``reach`` rows on or back."""

        def part(small: str, large: str) -> Column:
            here, far, own = F.col(small), F.col(f"{small}_{which}"), F.col(f"{large}_own")
            beside_ = F.coalesce(F.col(f"{large}_{'after' if which == 'a' else 'before'}"), F.lit(0))
            same = F.col(f"_c_{which}") == F.col("_c")
            if which == "a":  # no row so far on: all that is left
                return F.when(far.isNull(), own - here + beside_).when(same, far - here).otherwise(own - here + far)
            return F.when(far.isNull(), here + beside_).when(same, here - far).otherwise(here + beside_ - far)

        return part("_s", "_S") / F.nullif(part("_n", "_N"), F.lit(0))

    gone = [c for c in met.columns if c.startswith(("_s", "_n", "_S", "_N", "_c")) and c not in df.columns] + ["_p"]
    return met.withColumn("flank", mean("a") - mean("b")).withColumn("stable", F.abs(F.col("flank")) < most).drop(*gone)


def raw_threshold(df: DataFrame, keys: Sequence[str], data: str = "data", k: float = 5) -> DataFrame:
    """``threshold`` of each row above its baseline: that of the raw values, missing ones passed over, less the row's ``baseline`` (a missing one counts as 0)."""
    limit = trimmed_threshold(df.where(F.col(data).isNotNull()), keys, data, k)
    return df.join(limit, list(keys), "left").withColumn("threshold", F.col("threshold") - F.coalesce("baseline", F.lit(0.0)))


def optical_peaks(traces: DataFrame, keys: Sequence[str] = ("channel",), k: float = 3, interval: int = 60, *, size: int = 1000, reach: int = 1000, most: float = 0.1, method: str = "mixture_spline", index: str = "idx", data: str = "intensity", drop_zero: bool = False) -> DataFrame:
    """Peaks of optical traces with ``baseline`` and ``corrected_intensity``.

    The threshold comes from the signal above the baseline, the peaks from the raw intensity; those stay
    where the baseline's mean over ``reach`` rows before and after differs by less than ``most``.
    ``drop_zero`` leaves out peaks that don't rise above the baseline.
    """
    based = {"median": median_baseline, "mixture_spline": mixture_baseline}[method](traces, keys, size, index, data)
    corrected = with_signal(based, data)
    limit = trimmed_threshold(corrected, keys, "signal", k)
    checked = flank_check(corrected, keys, "baseline", index, reach, most)
    tops = suppress(local_maxima(checked.join(limit, list(keys)), keys, data, index, min_height="threshold"), keys, interval, data, index)
    out = tops.where("stable").withColumn("corrected_intensity", F.col("signal")).drop("block", "signal", "flank", "stable", "threshold")
    return out.where("corrected_intensity > 0") if drop_zero else out


def detect_events(df: DataFrame, keys: Sequence[str], k: float = 3, interval: int = 6, size: int = 100, method: str = "median", index: str = "index", data: str = "data") -> DataFrame:
    """Events of each series: baseline, threshold, local maxima above it, suppression within ``interval``."""
    based = {"median": median_baseline, "mixture_spline": mixture_baseline}[method](df, keys, size, index, data)
    signal = with_signal(based, data)
    limit = trimmed_threshold(signal, keys, "signal", k)
    return suppress(local_maxima(signal.join(limit, list(keys)), keys, "signal", index, min_height="threshold"), keys, interval, "signal", index)


def mask_periods(df: DataFrame, periods: Sequence[tuple[float | None, float | None]], time: str = "time", columns: Sequence[str] = ("data",)) -> DataFrame:
    """Values within any of the closed periods become null; rows stay."""
    hit = within_periods(F.col(time), periods)
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def normal_periods(periods) -> list[tuple[float | None, float | None]]:
    """A pair or a list of pairs as a list of pairs; None is unbounded; a start after its end is an error."""
    if periods is None:
        return []
    if len(periods) == 2 and not any(hasattr(x, "__len__") for x in periods):
        periods = [tuple(periods)]
    out = []
    for start, end in periods:
        if start is not None and end is not None and start > end:
            raise ValueError(f"period starts after its end: {start} > {end}")
        out.append((start, end))
    return out


def within_periods(time, periods):
    """Whether a time lies in any of the closed periods."""
    hit = F.lit(False)
    for start, end in normal_periods(periods):
        one = F.lit(True)
        if start is not None:
            one &= time >= float(start)
        if end is not None:
            one &= time <= float(end)
        hit |= one
    return F.coalesce(hit, F.lit(False))
