"""Joins on event positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _offset(a: DataFrame, b: DataFrame, offset: int, keys: Sequence[str], index: str, how: str) -> DataFrame:
    shifted = b.select(*keys, F.explode(F.array_distinct(F.array(*(F.col(index) + F.lit(o) for o in (-offset, 0, offset))))).alias(index)).distinct()
    return a.select(*keys, index).distinct().join(shifted, [*keys, index], how)


def offset_semi(a: DataFrame, b: DataFrame, offset: int = 1, keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Distinct positions of ``a`` with one of ``b`` exactly ``offset`` before, at, or ``offset`` after it (none between)."""
    return _offset(a, b, offset, keys, index, "left_semi")


def offset_anti(a: DataFrame, b: DataFrame, offset: int = 1, keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Distinct positions of ``a`` without such a partner."""
    return _offset(a, b, offset, keys, index, "left_anti")


def merge_events(main: DataFrame, others: dict[str, DataFrame], offset: int = 1, keys: Sequence[str] = (), index: str = "index") -> dict[str, DataFrame]:
    """``merged``: positions of ``main`` matched in every other marker; ``only_<name>``: the other marker's unmatched positions."""
    merged, out = main.select(*keys, index).distinct(), {}
    for name, other in others.items():
        merged = offset_semi(merged, other, offset, keys, index)
        out[f"only_{name}"] = offset_anti(other, main, offset, keys, index)
    return {"merged": merged} | out


def earliest_within(events: DataFrame, apexes: DataFrame, reach: int, keys: Sequence[str] = (), index: str = "index", apex: str = "apex") -> DataFrame:
    """For each event the smallest apex from ``reach`` before to ``reach`` after it, else null.

    ``apexes`` is spread over the positions it can reach, so this is an equi-join.
    """
    spread = apexes.select(*keys, F.col(apex), F.explode(F.sequence(F.col(apex) - reach, F.col(apex) + reach)).alias(index))
    best = spread.groupBy(*keys, index).agg(F.min(apex).alias(apex))
    return events.join(best, [*keys, index], "left")


def close_elements(a: DataFrame, b: DataFrame, reach: int, keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Rows of ``a``, repeats included, with some position of ``b`` within ``reach``."""
    near = b.select(*keys, F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index)).distinct()
    return a.join(near, [*keys, index], "left_semi")


def neighbourhood(events: DataFrame, peaks: DataFrame, offset: int, keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Peaks of the rows from ``offset`` before to ``offset`` after each event, with the relative row ``pos``."""
    around = events.withColumn("pos", F.explode(F.sequence(F.lit(-offset), F.lit(offset)))).withColumn("_row", F.col(index) + F.col("pos"))
    right = peaks.withColumnRenamed(index, "_row")
    return around.join(right, [*keys, "_row"]).drop("_row")


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that takes ``columns`` from the first matching row of ``right`` in ``order``."""
    first = right.groupBy(*on).agg(F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("_first"))
    return left.join(first, list(on), "left").select(*left.columns, *(F.col("_first")[c].alias(c) for c in columns))
