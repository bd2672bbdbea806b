"""Alignment of features over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .peaks import global_chains


def kept_cells(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of cells that the batch's group file lists."""
    return matrix.join(groups.select("batch", "cell").distinct(), ["batch", "cell"], "left_semi")


def align(features: DataFrame, ppm: float = 10, mz: str = "mz", tie: tuple[str, ...] = ("batch", "feature")) -> DataFrame:
    """``island``: features of all batches chained in mass order while gaps stay below ``ppm``."""
    return global_chains(features, ppm, mz, tie, strict=True)


def merge(aligned: DataFrame, batches: list[str], totals: dict[str, int], mz: str = "mz") -> DataFrame:
    """One row for each aligned group: mean mass, names, counts and ratios by batch as joined text ('NaN' where absent), overall ratio, batches.

    Of several rows of one batch the lowest mass counts.
    """
    first = aligned.groupBy("island", "batch").agg(F.min(F.struct(mz, "feature", "n_cells")).alias("f"))
    every = aligned.groupBy("island").agg(
        F.avg(mz).alias("mz_mean"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("metabolite") != "", F.col("metabolite")))), "/").alias("metabolite"),
    )
    known = [F.max(F.when(F.col("batch") == b, F.col("f.n_cells"))).alias(f"_n{i}") for i, b in enumerate(batches)]
    by_batch = first.groupBy("island").agg(*known, F.count("*").alias("batch_count"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NaN"))
    counts = F.concat_ws("/", *(text(F.col(f"_n{i}")) for i in range(len(batches))))
    share = lambda i, b: text(F.format_string("%.4f", F.col(f"_n{i}") / totals[b]))
    ratios = F.concat_ws("/", *(F.when(F.col(f"_n{i}").isNull(), F.lit("NaN")).otherwise(share(i, b)) for i, b in enumerate(batches)))
    total = sum((F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i in range(len(batches))), F.lit(0)) / sum(totals.values()) * 100
    return every.join(by_batch, "island").select(
        "island", "mz_mean", "metabolite", counts.alias("counts"), ratios.alias("ratios"), total.alias("total_cell_ratio"), F.col("batch_count").cast("long").alias("batch_count")
    )
