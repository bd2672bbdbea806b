"""Trends along pseudotime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import z_score


def dot_table(long: DataFrame, significance: DataFrame, branch: str | None = None, step: float = 10, least: float = 0.0, top: int | None = None, agg: str = "mean", most_p: float = 0.05) -> DataFrame:
    """For each time bin and significant metabolite: statistic, share above ``least``, z-score over bins; every combination has a row.

    ``long``: cell, pseudotime, branch, metabolite, value.  Metabolites are numbered by the bin of
    their highest z-score; ``top`` keeps so many.
    """
    named = long.join(significance.where(F.col("pval_adj") < most_p).select("metabolite"), "metabolite", "left_semi").where("pseudotime is not null")
    named = named if branch is None else named.where(F.col("branch") == branch)
    binned = named.withColumn("bin", (F.floor(F.col("pseudotime") / step) * step).cast("long"))
    stat = (F.avg if agg == "mean" else F.median)("value")
    grouped = binned.groupBy("bin", "metabolite").agg(stat.alias("stat"), F.avg(F.coalesce((F.col("value") > least).cast("int"), F.lit(0))).alias("frac"))
    scored = z_score(grouped.withColumn("color", F.col("stat")), ["metabolite"], "color")
    peak = scored.groupBy("metabolite").agg(F.min_by("bin", F.struct((-F.col("color")).alias("c"), "bin")).alias("peak"))
    order = peak.withColumn("position", F.row_number().over(Window.orderBy("peak", "metabolite")))  # metabolites are few
    order = order if top is None else order.where(F.col("position") <= top)
    grid = grouped.select("bin").distinct().crossJoin(order)
    return grid.join(scored, ["bin", "metabolite"], "left")


def slopes(table: DataFrame, by: Sequence[str] = ("metabolite",), y: str = "stat", x: str = "bin") -> DataFrame:
    """Least-squares slope of each group; null with fewer than two points."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    n, sx, sy = F.count_if(both), F.sum(F.when(both, F.col(x).cast("double"))), F.sum(F.when(both, F.col(y)))
    sxx, sxy = F.sum(F.when(both, F.col(x).cast("double") * F.col(x))), F.sum(F.when(both, F.col(x) * F.col(y)))
    return table.groupBy(*by).agg(F.when(n >= 2, (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))).alias("slope"))


def order_by_direction(left: DataFrame, right: DataFrame, p: DataFrame) -> DataFrame:
    """Metabolites in both tables of ``slope``, split by which slope is positive and larger; left ones by rising p, then right ones by falling p."""
    met = left.withColumnRenamed("slope", "ls").join(right.withColumnRenamed("slope", "rs"), "metabolite").join(p.select("metabolite", "pval_adj"), "metabolite", "left")
    l, r = F.coalesce("ls", F.lit(0.0)), F.coalesce("rs", F.lit(0.0))
    side = F.when((r > 0) & (r >= l), "right").when(l > 0, "left")
    sided = met.withColumn("side", side).where("side is not null").withColumn("_p", F.coalesce("pval_adj", F.lit(float("inf"))))
    order = Window.orderBy("side", F.when(F.col("side") == "left", F.col("_p")).otherwise(-F.col("_p")), "metabolite")  # metabolites are few
    return sided.withColumn("position", F.row_number().over(order)).drop("_p")


def dual_branch(left: DataFrame, right: DataFrame, order: DataFrame, p: DataFrame, value: str = "stat", sizes: tuple[float, float] = (20.0, 300.0)) -> DataFrame:
    """Points of a trend over two branches: ``branch, metabolite, x, y, z, size, label``.

    ``left`` and ``right`` are tables of ``bin, metabolite, frac`` and ``value``; ``order`` has ``metabolite, position``
    and ``p`` ``metabolite, pval_adj``.  Metabolites that both branches and the order have stand at ``x`` from
    0; the left branch goes up, the right one down.  ``z`` is the z-score over both branches of a metabolite,
    nulls passed over, 0 without spread; ``size`` goes with the share over the greatest one of all points
    (a null share is none); ``label`` is the name with its p, where there is one.
    """
    fields = ["bin", "metabolite", "frac", value]
    both = left.select(F.lit("left").alias("branch"), *fields).unionByName(right.select(F.lit("right").alias("branch"), *fields))
    named = left.select("metabolite").distinct().join(right.select("metabolite").distinct(), "metabolite").join(order.select("metabolite", "position"), "metabolite")
    placed = named.withColumn("x", F.row_number().over(Window.orderBy("position", "metabolite")) - 1)  # metabolites are few
    w = Window.partitionBy("metabolite")
    v = F.col(value)
    met = both.join(placed, "metabolite").join(p.groupBy("metabolite").agg(F.min("pval_adj").alias("_p")), "metabolite", "left")
    spread = F.stddev_pop(v).over(w)
    z = F.when(F.coalesce(spread, F.lit(0.0)) > 0, (v - F.avg(v).over(w)) / spread).otherwise(F.lit(0.0))
    share = F.coalesce("frac", F.lit(0.0))
    most = met.agg(F.max(share).alias("_most"))
    scored = met.withColumn("z", z).crossJoin(F.broadcast(most))  # one row
    size = F.lit(float(sizes[0])) + F.when(F.col("_most") > 0, F.lit(float(sizes[1] - sizes[0])) * share / F.col("_most")).otherwise(F.lit(0.0))
    label = F.when(F.col("_p").isNull() | F.isnan("_p"), F.col("metabolite")).otherwise(F.format_string("%s (%.2E)", "metabolite", "_p"))
    y = F.when(F.col("branch") == "left", F.col("bin")).otherwise(-F.col("bin"))
    return scored.select("branch", "metabolite", F.col("x").cast("int").alias("x"), y.cast("long").alias("y"), "z", size.alias("size"), label.alias("label"))
