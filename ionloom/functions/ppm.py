"""Mass tolerance: bounds, differences and band joins in parts per million."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two-regime tolerance: up to this mass a fixed half width, above it parts per million (fixed values).
FIXED_UP_TO, FIXED_HALF_WIDTH, RELATIVE_PPM = 400.0, 0.003, 10.0


def bounds(mz: Column, method: float | str = 10) -> tuple[Column, Column]:
    """Lower and upper mass bound: ``mz`` -/+ ``method`` ppm, or the two-regime rule for ``"TypeI"``."""
    if method == "TypeI":
        half = F.when(mz <= FIXED_UP_TO, F.lit(FIXED_HALF_WIDTH)).otherwise(mz * RELATIVE_PPM * 1e-6)
    else:
        half = mz * float(method) * 1e-6
    return mz - half, mz + half


def difference(x: Column, y: Column) -> Column:
    """Difference in ppm of the smaller mass; null where that is zero."""
    return F.abs(x - y) / F.nullif(F.least(x, y), F.lit(0.0)) * 1e6


def difference_to(x: Column, reference: Column) -> Column:
    """Difference in ppm of a stated reference mass; null where that is zero."""
    return F.abs(x - reference) / F.nullif(reference, F.lit(0.0)) * 1e6


def correct_to_reference(df: DataFrame, measured: float, target: float = 760.5851, mz_col: str = "mz") -> DataFrame:
    """Scale masses so that ``measured`` moves towards ``target``: down if it lies below, else up."""
    if mz_col not in df.columns:
        raise KeyError(mz_col)
    shift = abs(target - measured) / measured * 1e6
    scale = 1 - shift / 1e6 if measured < target else 1 + shift / 1e6
    return df.withColumn(mz_col, F.col(mz_col) * F.lit(scale))


def band_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float, *, strict: bool = False, of: str = "right", how: str = "inner") -> DataFrame:
    """Pairs within ``ppm`` of the mass on side ``of``, through an equi-join on logarithmic buckets.

    A bucket is wider than the band, so a partner lies in the same bucket or the next: ``right`` is
    sent to three buckets and ``left`` to one, and the exact condition filters what meets.  That is a
    hash or sort-merge join at any size, where a plain range condition would compare all pairs.
    Column names of the two sides must differ.  Masses that are null or not above zero match nothing.
    """
    width = 2 * (math.log1p(ppm * 1e-6) - math.log1p(-ppm * 1e-6))
    spot = lambda c: F.when(c > 0, F.floor(F.ln(c) / width))
    a = left.withColumn("_bucket", spot(F.col(left_mz)))
    b = right.withColumn("_at", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))).withColumn("_bucket2", spot(F.col(right_mz)) + F.col("_at"))
    x, y = F.col(left_mz), F.col(right_mz)
    gap = difference_to(x, y) if of == "right" else difference_to(y, x)
    near = gap < ppm if strict else gap <= ppm
    return a.join(b, (F.col("_bucket") == F.col("_bucket2")) & near, how).drop("_bucket", "_bucket2", "_at")
