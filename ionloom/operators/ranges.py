"""Running numbers and totals over all rows in an order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: Sequence[str], amount: str | None = None, out: str = "number", parts: int = 64) -> DataFrame:
    """``out``: the sum of ``amount`` (of 1, without it) over the rows up to each, in the order of the columns (nulls first).

    Rows go to ranges of the first column, which must be a number, are summed within their range, and
    moved on by the totals of the ranges before.  The bounds of the ranges are ``parts`` approximate
    quantiles, looked up by a job of their own; the sums don't depend on how well they fit, but equal
    values of the first column share a task.
    """
    first = F.col(order[0])
    cuts = df.select(F.percentile_approx(first, [i / parts for i in range(1, parts)], 1000).alias("c")).first()["c"] or []
    spot = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < first)) if cuts else F.lit(0)
    one = F.lit(1) if amount is None else F.col(amount)
    dealt = df.withColumn("_range", F.when(first.isNull(), F.lit(-1)).otherwise(spot)).withColumn("_one", one)
    sizes = dealt.groupBy("_range").agg(F.sum("_one").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.sum("_one").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_in", inside).join(before, "_range")
    return met.withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_one", "_in", "_before")
