"""Frames of metadata and values: choosing, naming, stacking and ordering of columns and categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import cut, observation_frame

#: Categories that stand for no label (fixed values).
NO_LABEL = ("N/A", "dontknow", "no_gate", "?")


def positions(array: Column, item) -> Column:
    """Positions (from 0) at which an array holds ``item``; a null item is nowhere."""
    return F.filter(F.transform(array, lambda x, i: F.when(x == F.lit(item), i)), lambda i: i.isNotNull())


def drop_columns(df: DataFrame, names: str | Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` without ``names``, or, with None, without all but ``keep``; a name it doesn't have is an error."""
    gone = [c for c in df.columns if c not in keep] if names is None else [names] if isinstance(names, str) else list(names)
    if unknown := [c for c in gone if c not in df.columns]:
        raise KeyError(f"not among the columns: {unknown}")
    return df.drop(*gone)


def mask_column(df: DataFrame, mask: str | Column, probabilities: bool = False) -> Column:
    """A mask as a column: booleans, or, if allowed, numbers from 0 to 1; a missing value masks out.

    A name that isn't a column, or a column of another type, is an error; so is, when the rows are
    read, a probability outside its range.
    """
    if isinstance(mask, str) and mask not in df.columns:
        raise KeyError(f"no column {mask}")
    column = F.col(mask) if isinstance(mask, str) else mask
    kind = df.select(column.alias("m")).schema["m"].dataType.simpleString()
    if kind == "boolean":
        return F.coalesce(column, F.lit(False))
    if not probabilities or kind not in ("float", "double"):
        raise TypeError(f"a mask of {kind}")
    inside = column.between(0, 1) | column.isNull()
    return F.coalesce(F.when(inside, column).otherwise(F.raise_error(F.lit("a probability outside 0 to 1")).cast("double")), F.lit(0.0))


def without_labels(df: DataFrame, column: str, ignore: Sequence[str] = NO_LABEL) -> DataFrame:
    """Rows whose category says something."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(ignore)))


def cluster_names(df: DataFrame, column: str, prefix: str = "Cluster ", out: str | None = None) -> DataFrame:
    """Numeric cluster labels as names counted from 1, in the order of their numbers; the labels are few."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    number = F.row_number().over(Window.orderBy(F.col(column).cast("long"), column))
    named = labels.select(F.col(column).alias("_label"), F.concat(F.lit(prefix), number.cast("string")).alias("_name"))
    met = df.join(named, F.col(column) == F.col("_label"), "left")
    return met.withColumn(out or column, F.col("_name")).drop("_label", "_name")


def distinct_colors(df: DataFrame, name: str, color: str) -> DataFrame:
    """The colour of each name, each pair once, without missing names."""
    return df.where(F.col(name).isNotNull()).select(name, color).distinct()


def stack(df: DataFrame, keys: Sequence[str], fields: Sequence[str], groups: Sequence[str], sep: str = "|", name: str = "group") -> DataFrame:
    """Columns named ``field sep group`` as a row for each group with a column for each field.

    A column that isn't there gives nulls; names may hold the separator.
    """
    value = lambda f, g: F.col(f"`{f}{sep}{g}`") if f"{f}{sep}{g}" in df.columns else F.lit(None)
    rows = F.array(*(F.struct(F.lit(g).alias(name), *(value(f, g).alias(f) for f in fields)) for g in groups))
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def category(obs: DataFrame, by: Sequence[str], num_categories: int = 7, out: str = "category") -> DataFrame:
    """``category``: a single numeric column cut into ``num_categories`` equal ranges (by number, from 0), or the columns' values joined by '_'."""
    if len(by) == 1 and dict(obs.dtypes)[by[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return cut(obs, by[0], num_categories, out=out).withColumn(out, F.col(out).cast("string"))
    return obs.withColumn(out, F.concat_ws("_", *(F.col(c).cast("string") for c in by)))


def heatmap_frame(obs: DataFrame, long: DataFrame, features: Sequence, by: Sequence[str], *, num_categories: int = 7, log: bool = False, scale: str | None = None, cell: str = "cell") -> DataFrame:
    """``cell``, ``category`` and a column for each feature: the frame of heatmaps, dot plots and violins.

    ``log``: ln(1 + x).  ``scale``: 'var' or 'obs' brings each feature, or each cell, to 0 to 1 (0 if flat).
    """
    names = list(dict.fromkeys(map(str, features)))
    wide = observation_frame(obs, long, list(dict.fromkeys(features)), list(by), cell)
    out = category(wide, by, num_categories).select(cell, "category", *(F.col(f"`{n}`").cast("double").alias(n) for n in names))
    if log:
        out = out.withColumns({n: F.log1p(F.col(f"`{n}`")) for n in names})
    if scale == "var":
        # the bounds of all features are one row
        ends = out.agg(*(f(F.col(f"`{n}`")).alias(f"_{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))))
        met = out.crossJoin(F.broadcast(ends))
        ranged = {n: F.coalesce((F.col(f"`{n}`") - F.col(f"_lo{i}")) / F.nullif(F.col(f"_hi{i}") - F.col(f"_lo{i}"), F.lit(0.0)), F.lit(0.0)) for i, n in enumerate(names)}
        return met.withColumns(ranged).select(*out.columns)
    if scale == "obs":
        every = [F.col(f"`{n}`") for n in names]
        low, high = (F.least(*every), F.greatest(*every)) if len(every) > 1 else (every[0], every[0])
        return out.withColumns({n: F.coalesce((F.col(f"`{n}`") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)) for n in names})
    if scale is not None:
        raise ValueError("scale is 'var', 'obs' or None")
    return out


def category_means(frame: DataFrame, features: Sequence[str], by: str = "category") -> DataFrame:
    """Mean of each feature column and number of cells by category: the rows of a matrix plot."""
    return frame.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(F.col(f"`{n}`")).alias(n) for n in features))


def reorder(df: DataFrame, column: str, order: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None, out: str = "position") -> DataFrame:
    """``position`` of each row's category in ``order`` (a dendrogram's leaves), from 0; with ``groups``, the categories are those of the named feature groups.

    A category that the order doesn't hold is an error, as the order then isn't of these data.
    """
    spots = {c: i for i, c in enumerate(order)} if groups is None else {f: i for i, g in enumerate(order) for f in groups[g]}
    if not spots:
        raise ValueError("an empty order")
    table = F.create_map(*(F.lit(x) for kv in spots.items() for x in kv))
    found = F.try_element_at(table, F.col(column).cast("string"))
    unknown = F.raise_error(F.concat(F.lit("not in the order: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int")
    return df.withColumn(out, F.coalesce(found, unknown))


def export_columns(obs: DataFrame, columns: Sequence[str], more: Sequence[str] = ("UMAP1", "UMAP2", "tSNE1", "tSNE2")) -> DataFrame:
    """The stated metadata columns and those coordinates that are there, for :func:`ionloom.sources.tables.write`."""
    if gone := [c for c in columns if c not in obs.columns]:
        raise KeyError(f"not among the columns: {gone}")
    return obs.select(*columns, *(c for c in more if c in obs.columns and c not in columns))


def choose_representation(matrix: DataFrame, n_features: int, scores: DataFrame | None = None, n_pcs: int | None = None, least: int = 50) -> tuple[str, DataFrame | None]:
    """What neighbours are searched in: ('X', None) for few features or ``n_pcs`` 0, ('pcs', scores cut to ``n_pcs``) where scores are given, else ('pcs', None): to be made."""
    if n_pcs == 0 or (n_pcs is None and n_features <= least):
        return "X", matrix
    if scores is None:
        return "pcs", None
    wanted = n_pcs or least
    short = F.when(F.size("pcs") < wanted, F.raise_error(F.lit(f"fewer than {wanted} components"))).otherwise(F.slice("pcs", 1, wanted)) if n_pcs else F.slice("pcs", 1, wanted)
    return "pcs", scores.withColumn("pcs", short)
