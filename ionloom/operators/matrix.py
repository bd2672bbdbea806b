"""The cell by feature matrix in long form: ``cell, feature, value``, null for what was not detected.

Operators that need every combination (means over all cells, imputation, ranks) take a dense matrix:
see :func:`densify`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running
from .signal import within_periods

#: Least total that a normalisation divides by (double precision's epsilon).
EPSILON = 2.220446049250313e-16


def from_vectors(df: DataFrame, cell: str, vector: str, *more: str) -> DataFrame:
    """A vector column as a long dense matrix; features are numbered from 0; NaN becomes null."""
    long = df.select(F.col(cell).alias("cell"), *more, F.posexplode(vector).alias("feature", "value"))
    v = F.col("value").cast("double")
    return long.withColumn("value", F.when(~F.isnan(v), v))


def densify(long: DataFrame, cell: str = "cell", feature: str = "feature", value: str = "value") -> DataFrame:
    """A row for every cell with every feature; the features, bounded by the assay, go to each cell."""
    cells, features = long.select(cell).distinct(), long.select(feature).distinct()
    return cells.crossJoin(features).join(long.select(cell, feature, value), [cell, feature], "left")


# aggregation

FUNCTIONS = ("count_nonzero", "sum", "mean", "var", "median")


def aggregate(long: DataFrame, by: Sequence[str], func: str | Sequence[str], *, feature: str = "feature", value: str = "value", mask: Column | None = None, dof: int = 1) -> DataFrame:
    """A column for each function over each group and feature; ``group`` joins several keys by '_'.

    Nulls count as non-zero and are passed over by sums.  ``mean`` divides the masked sum by the
    whole group's size; ``var`` is the mean square less the squared mean, 0 where it is lost in
    rounding, scaled to ``dof``; ``median`` pays no heed to the mask.
    """
    names = [func] if isinstance(func, str) else list(func)
    if unknown := set(names) - set(FUNCTIONS):
        raise ValueError(f"unknown functions: {sorted(unknown)}")
    keep = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    x = F.col(value)
    n = F.count("*")
    mean = F.coalesce(F.sum(F.when(keep, x)), F.lit(0.0)) / n
    square = F.coalesce(F.sum(F.when(keep, x * x)), F.lit(0.0)) / n
    raw = square - mean * mean
    rounded = F.when(F.lit(float(2 << 42)) * raw < mean * mean, F.lit(0.0)).otherwise(raw)
    made = {
        "count_nonzero": F.count_if(keep & (x.isNull() | (x != 0))),
        "sum": F.coalesce(F.sum(F.when(keep, x)), F.lit(0.0)),
        "mean": mean,
        "var": rounded * (n / F.nullif(n - dof, F.lit(0))) if dof else rounded,
        "median": F.median(x),
    }
    out = long.groupBy(*by, feature).agg(*(made[f].alias(f) for f in names))
    return out.withColumn("group", F.concat_ws("_", *(F.col(c).cast("string") for c in by)))


# quality control


def cell_metrics(long: DataFrame, by: Sequence[str] = ("cell",), value: str = "value") -> DataFrame:
    """Features above zero and total intensity of each cell."""
    return long.groupBy(*by).agg(F.count_if(F.col(value) > 0).alias("n_metabolites"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total_intensity"))


def feature_metrics(long: DataFrame, only_detected: bool = False, by: str = "feature", value: str = "value") -> DataFrame:
    """Cells above zero, their share in percent of the cells with a value, and mean intensity (of those above zero, 0 without any, if ``only_detected``)."""
    x = F.col(value)
    mean = F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)) if only_detected else F.avg(x)
    hits = F.count_if(x > 0)
    return long.groupBy(by).agg(hits.alias("hits"), (hits / F.nullif(F.count(x), F.lit(0)) * 100).alias("hit_rate"), mean.alias("mean_intensity"))


def _bounds(column: str, low, high) -> list[Column]:
    return ([F.col(column) >= low] if low is not None else []) + ([F.col(column) <= high] if high is not None else [])


def filter_cells(long: DataFrame, obs: DataFrame | None = None, *, min_metabolites=None, max_metabolites=None, min_total_intensity=None, max_total_intensity=None, time_windows=None, time_key: str = "scan_start_time", excluded_time_windows: bool = False) -> DataFrame:
    """Cells within all stated closed bounds, with their metrics.  With a bound on the total, a cell with a null value has no total and goes."""
    metrics = long.groupBy("cell").agg(
        F.count_if(F.col("value") > 0).alias("n_metabolites"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_intensity"), F.count_if(F.col("value").isNull()).alias("_gaps")
    )
    tests = _bounds("n_metabolites", min_metabolites, max_metabolites) + _bounds("total_intensity", min_total_intensity, max_total_intensity)
    if min_total_intensity is not None or max_total_intensity is not None:
        tests.append(F.col("_gaps") == 0)
    kept = metrics.where(reduce(lambda a, b: a & b, tests, F.lit(True))).drop("_gaps")
    if time_windows is not None:
        hit = within_periods(F.col(time_key), time_windows)
        kept = kept.join(obs.where(~hit if excluded_time_windows else hit).select("cell"), "cell", "left_semi")
    return kept


def filter_features(long: DataFrame, *, min_cells=None, max_cells=None, min_intensity=None, max_intensity=None, extra: Mapping[str, tuple] | None = None) -> DataFrame:
    """Features within all stated closed bounds on cells above zero and their mean intensity, and on further metric columns."""
    x = F.col("value")
    metrics = long.groupBy("feature").agg(
        F.count_if(x > 0).alias("n_cells"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("mean_intensity"), (F.count_if(x > 0) / F.count("*") * 100).alias("hit_rate")
    )
    tests = _bounds("n_cells", min_cells, max_cells) + _bounds("mean_intensity", min_intensity, max_intensity)
    for column, (low, high) in (extra or {}).items():
        tests += _bounds(column, low, high)
    return metrics.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def _within(metrics: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    if gone := [c for c in bounds if c not in metrics.columns]:
        raise ValueError(f"no such metrics: {gone}")
    return metrics.where(reduce(lambda a, b: a & b, [t for c, (low, high) in bounds.items() for t in _bounds(c, low, high)], F.lit(True)))


def select_cells(long: DataFrame, obs: DataFrame, bounds: Mapping[str, tuple], only_detected: bool = False) -> dict[str, DataFrame]:
    """Cells whose metrics in ``obs`` lie within closed bounds (None: open), as they are: ``obs``, their ``matrix``, and ``var``, the features' metrics made anew from them.

    A null metric is within no bound; with no cells left there are no features.
    """
    kept = _within(obs, bounds)
    matrix = long.join(kept.select("cell"), "cell", "left_semi")
    return {"obs": kept, "matrix": matrix, "var": feature_metrics(matrix, only_detected)}


def select_features(long: DataFrame, var: DataFrame, bounds: Mapping[str, tuple]) -> dict[str, DataFrame]:
    """Features whose metrics in ``var`` lie within closed bounds (None: open): ``var``, their ``matrix``, and ``obs``, the cells' metrics made anew from them.

    Every cell has its metrics, 0 where no feature is left.
    """
    kept = _within(var, bounds)
    matrix = long.join(kept.select("feature"), "feature", "left_semi")
    cells = long.select("cell").distinct().join(cell_metrics(matrix), "cell", "left")
    return {"var": kept, "matrix": matrix, "obs": cells.select("cell", F.coalesce("n_metabolites", F.lit(0)).alias("n_metabolites"), F.coalesce("total_intensity", F.lit(0.0)).alias("total_intensity"))}


def sample(df: DataFrame, column: str, ids: DataFrame, exclude: bool = False) -> DataFrame:
    """Rows whose id is (not) in a list, which may be of any size."""
    return df.join(ids.select(column).distinct(), column, "left_anti" if exclude else "left_semi")


# imputation, normalisation, scaling


def fill_missing(dense: DataFrame, method: str = "zero", fraction: float = 0.5, value: str = "value", feature: str = "feature") -> DataFrame:
    """Nulls as 0, or as a fraction of the feature's least value (0 where the feature has none); ``half_min`` leaves such features null."""
    x = F.col(value)
    if method == "zero":
        return dense.withColumn(value, F.coalesce(x, F.lit(0.0)))
    least = F.min(x).over(Window.partitionBy(feature))
    if method == "half_min":
        return dense.withColumn(value, F.coalesce(x, least / 2))
    if method == "min_fraction":
        if not 0 < fraction <= 1:
            raise ValueError("fraction must be above 0 and at most 1")
        return dense.withColumn(value, F.coalesce(x, least * fraction, F.lit(0.0)))
    raise ValueError(f"unknown method {method}")


def normalise(long: DataFrame, totals: DataFrame, total: str, target: float = 1e4, log: bool = False, zscore: bool = False) -> DataFrame:
    """Values scaled so that each cell's total is ``target``; then ln(1 + x), then z-scores by feature (population deviation, 0 taken as 1)."""
    x = F.col("value") * F.lit(float(target)) / F.greatest(F.col(total), F.lit(EPSILON))
    out = long.join(totals.select("cell", total), "cell").withColumn("value", F.log1p(x) if log else x).drop(total)
    return z_score(out, ["feature"], flat=1.0) if zscore else out


def z_score(df: DataFrame, keys: Sequence[str], value: str = "value", flat: float | None = None) -> DataFrame:
    """(x - mean) / population deviation within each group; a zero deviation gives 0, or divides by ``flat``."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    gap = F.col(value) - F.avg(value).over(w)
    return df.withColumn(value, F.when(sd > 0, gap / sd).otherwise(F.lit(0.0) if flat is None else gap / F.lit(flat)))


def standard_scale(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Each group from 0 to 1; a flat group and nulls give 0."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.coalesce((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))


def regress_out_category(df: DataFrame, keys: Sequence[str], category: str, value: str = "value") -> DataFrame:
    """Residuals of a categorical regressor: values less their category's mean."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys, category)))


def regress_out(df: DataFrame, keys: Sequence[str], regressor: str, value: str = "value") -> DataFrame:
    """Residuals of a least-squares line on one numeric regressor within each group (its mean, for a constant one)."""
    w = Window.partitionBy(*keys)
    x, y = F.col(regressor), F.col(value)
    var = F.var_pop(regressor).over(w)
    slope = F.when(var > 0, F.covar_pop(value, regressor).over(w) / var).otherwise(0.0)
    return df.withColumn(value, y - F.avg(y).over(w) - slope * (x - F.avg(x).over(w)))


def regress_out_many(df: DataFrame, keys: Sequence[str], regressors: Sequence[str], value: str = "value", intercept: bool = True) -> DataFrame:
    """Residuals of least squares on several numeric regressors within each group.

    The normal equations of a group, whose size is the number of regressors squared, are sums over its
    rows; they are solved in Arrow batches of groups, by the pseudo-inverse where they are singular.
    Rows with a missing value or regressor don't count and get null.
    """
    x = [F.col(c).cast("double") for c in regressors] + ([F.lit(1.0)] if intercept else [])
    p, y = len(x), F.col(value).cast("double")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [value, *regressors]])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(x[i] * x[j]).alias(f"_g{i}_{j}") for i, j in pairs] + [F.sum(x[i] * y).alias(f"_y{i}") for i in range(p)]
    gram = df.where(whole).groupBy(*keys).agg(*sums)
    fields = [f for f in gram.schema.fields if f.name in keys]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def solve(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            g, r = np.zeros((batch.num_rows, p, p)), np.zeros((batch.num_rows, p, 1))
            for i, j in pairs:
                g[:, i, j] = g[:, j, i] = column(f"_g{i}_{j}")
            for i in range(p):
                r[:, i, 0] = column(f"_y{i}")
            beta = (np.linalg.pinv(g, hermitian=True) @ r)[:, :, 0] if len(g) else np.zeros((0, p))
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(beta), pa.list_(pa.float64()))], names=[*(f.name for f in fields), "_beta"])

    beta = gram.mapInArrow(solve, f"{names}, _beta array<double>")
    fitted = reduce(lambda a, b: a + b, [F.col("_beta")[i] * x[i] for i in range(p)])
    return df.join(beta, list(keys), "left").withColumn(value, F.when(whole, y - fitted)).drop("_beta")


# ranks, groups, centroids


def percentile_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "pct_rank") -> DataFrame:
    """Rank as a share of the group, ties at their mean rank, nulls first.

    Without keys, ranks are running totals over the distinct values, so no task has all rows.
    """
    if not keys:
        sizes = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_ties"))
        placed = running(sizes, ["_v"], "_ties", "_upto")
        whole = F.broadcast(sizes.agg(F.sum("_ties").alias("_all")))  # one row
        met = df.join(placed, F.col(value).eqNullSafe(F.col("_v"))).crossJoin(whole)
        return met.withColumn(out, (F.col("_upto") - (F.col("_ties") - 1) / 2) / F.col("_all")).drop("_v", "_ties", "_upto", "_all")
    by = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(out, (F.rank().over(by.orderBy(value)) + (ties - 1) / 2) / F.count("*").over(by))


def cut(df: DataFrame, value: str, groups: int, keys: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """Equal-width groups numbered from 0, closed on the right, the least value in the first."""
    by = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    met = df.join(by, list(keys)) if keys else df.crossJoin(by)  # one row of bounds
    spot = F.ceil((F.col(value) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / groups, F.lit(0.0))) - 1
    return met.withColumn(out, F.coalesce(F.least(F.greatest(spot, F.lit(0)), F.lit(groups - 1)), F.lit(0)).cast("long")).drop("_lo", "_hi")


def rank_ends(df: DataFrame, score: str, n: int = 30, keys: Sequence[str] = (), tie: Sequence[str] = (), both: bool = True) -> DataFrame:
    """Top and bottom of a ranking: n // 2 highest and the rest lowest; or the n + 1 highest only."""
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie))
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).asc(), *tie))
    ranked = df.withColumn("rank", down).withColumn("_up", up)
    keep = (F.col("rank") <= n // 2) | (F.col("_up") <= n - n // 2) if both else F.col("rank") <= n + 1
    return ranked.where(keep).drop("_up")


def centroid(df: DataFrame, keys: Sequence[str], coords: Sequence[str], tie: str) -> DataFrame:
    """The point of each group nearest, by summed absolute differences, to the group's medians."""
    mid = df.groupBy(*keys).agg(*(F.median(c).alias(f"_{c}") for c in coords))
    away = reduce(lambda a, b: a + b, (F.abs(F.col(c) - F.col(f"_{c}")) for c in coords))
    best = df.join(mid, list(keys)).groupBy(*keys).agg(F.min_by(F.struct(tie, *coords), F.struct(away.alias("d"), tie)).alias("_b"))
    return best.select(*keys, "_b.*")


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    """Rows of each group and, in the groups' order, where each begins and ends; the groups are few."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    stop = F.sum("n").over(Window.orderBy(by))
    return n.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n"))


def composition(df: DataFrame, by: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Counts of each kind, total, and shares of the total over all kinds, by group."""
    counts = df.groupBy(by).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds), F.count(kind).alias("n"))
    return counts.withColumns({f"share_{k}": F.col(f"n_{k}") / F.nullif(F.col("n"), F.lit(0)) for k in kinds})


def observation_frame(obs: DataFrame, long: DataFrame, features: Sequence, columns: Sequence[str] = (), cell: str = "cell") -> DataFrame:
    """Metadata columns beside the values of chosen features; an unknown or repeated name is an error."""
    names = [*columns, *map(str, features)]
    if len(set(names)) != len(names):
        raise ValueError("a key is given twice")
    if gone := set(columns) - set(obs.columns):
        raise KeyError(f"not in the metadata: {sorted(gone)}")
    wide = long.where(F.col("feature").isin(list(features))).groupBy(cell).pivot("feature", list(features)).agg(F.max("value"))
    return obs.select(cell, *columns).join(wide, cell, "left")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def ranked_results(results: DataFrame, *, groups: Sequence[str] | None = None, pval_cutoff=None, log2fc_min=None, log2fc_max=None, symbols: DataFrame | None = None) -> DataFrame:
    """Differential results below a p-value and strictly between fold changes, with symbols where given."""
    out = results if groups is None else results.where(F.col("group").isin(list(groups)))
    if pval_cutoff is not None:
        out = out.where(F.col("pvals_adj") < pval_cutoff)
    if log2fc_min is not None:
        out = out.where(F.col("logfoldchanges") > log2fc_min)
    if log2fc_max is not None:
        out = out.where(F.col("logfoldchanges") < log2fc_max)
    out = out.join(symbols, "names", "left") if symbols is not None else out
    return out.drop("group") if groups is not None and len(groups) == 1 else out


def drop_labels(df: DataFrame, column: str, labels: Sequence[str] = ("Unknown", "Mixed")) -> DataFrame:
    return df.where(~F.col(column).isin(list(labels)))


def relabel(df: DataFrame, column: str, mapping: Mapping[str, str], include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """New labels by a mapping; rows without one go; then only ``include``, without ``exclude``."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    out = df.withColumn(column, F.try_element_at(pairs, F.col(column))).where(F.col(column).isNotNull())
    out = out.where(F.col(column).isin(list(include))) if include is not None else out
    return out.where(~F.col(column).isin(list(exclude))) if exclude else out
