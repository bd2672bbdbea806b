"""Exact quantiles of groups of any size by counts of ranges.

A sketch, merged from all tasks, gives for each rank asked for two values between which it must lie.  What
lies below is counted, and only the different values in between are brought into order, each with its
count: with an accuracy of a thousand, about four rows in a thousand, and one row however often a value
is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], out: str = "quantiles", accuracy: int = 1000) -> DataFrame:
    """``out``: for each group the array of its quantiles at ``shares``, linear between ranks as ``numpy.percentile`` has them.

    Null values take no part, and a group of nothing else has null quantiles; NaN stands after all numbers; a
    null key is a group.  Without keys there is one row.
    """
    own = df.select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 2 / accuracy  # a rank of the sketch is right to one part in that many
    lows, highs = ([min(1.0, max(0.0, s + sign * margin)) for s in shares] for sign in (-1, 1))
    sketch = own.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", [*lows, *highs], accuracy).alias("_ends")
    )
    m, few = len(shares), F.col("_n") < accuracy  # of a few values, an end may be less than a rank away
    # the ranks about a quantile, from 0; at the ends of a group the least and the greatest value hold them
    spans = F.array(
        *(
            F.struct(
                F.lit(i).alias("q"),
                F.floor(F.lit(s) * (F.col("_n") - 1)).cast("long").alias("rank"),
                (F.lit(s) * (F.col("_n") - 1) - F.floor(F.lit(s) * (F.col("_n") - 1))).alias("part"),
                (F.col("_min") if lows[i] == 0 else F.when(few, F.col("_min")).otherwise(F.col("_ends")[i])).alias("lo"),
                (F.col("_max") if highs[i] == 1 else F.when(few, F.col("_max")).otherwise(F.col("_ends")[m + i])).alias("hi"),
            )
            for i, s in enumerate(shares)
        )
    )
    asked = sketch.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n", F.explode(spans).alias("_s")).select("*", "_s.*").drop("_s")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & own[k].eqNullSafe(F.col(f"_k{i}"))
    names = [f"_k{i}" for i in range(len(keys))]
    # values below are summed before they are sent; values between are one row each
    met = own.where("_v IS NOT NULL").join(F.broadcast(asked) if not keys else asked, match)
    place = F.when(F.col("_v") < F.col("lo"), F.lit(None)).otherwise(F.col("_v"))
    counted = met.where(F.col("_v") <= F.col("hi")).groupBy(*names, "_n", "q", "rank", "part", place.alias("x")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*names, "q").orderBy(F.asc_nulls_first("x"))
    upto = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("upto") > F.col("rank"), F.col("x"))).alias("a")
    second = F.min(F.when(F.col("upto") > F.least(F.col("rank") + 1, F.col("_n") - 1), F.col("x"))).alias("b")
    found = upto.groupBy(*names, "q", "part").agg(first, second)
    value_of = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    lists = found.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("q", value_of.alias("v")))).alias("_l"))
    listed = lists.select(*names, F.transform("_l", lambda s: s["v"]).alias(out))
    groups = sketch.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"_g{i}").eqNullSafe(F.col(f"_k{i}"))
    return groups.join(listed, same, "left").select(*(F.col(f"_g{i}").alias(k) for i, k in enumerate(keys)), out)
