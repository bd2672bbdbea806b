"""Column functions: transforms, corrected signals, cell-type bit masks, names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of cells without a type and with more than one (fixed values).
NO_TYPE_COLOR, MIXED_COLOR = "#DCDCDC", "#dc143c"


def log1p(x: Column, base: float | None = None) -> Column:
    """ln(1 + x), or to another base."""
    out = F.log1p(x)
    return out if base is None else out / F.lit(math.log(base))


def sqrt(x: Column) -> Column:
    """Square root; null for a negative value."""
    return F.when(x >= 0, F.sqrt(x))


def above_baseline(x: Column, baseline: Column) -> Column:
    """The difference to the baseline, negative where it lies below; null where either is missing."""
    return x - baseline


def corrected_signal(data: Column, baseline: Column) -> Column:
    """Data above the baseline; 0 where there is no baseline or it is as high; null data stay null."""
    return F.when(baseline.isNull() | (baseline >= data), F.lit(0.0)).otherwise(data - baseline)


def per_total(x: Column, total: Column) -> Column:
    """x / total, with a total of zero taken as 1e-10."""
    return x / F.when(total == 0, F.lit(1e-10)).otherwise(total)


def gaussian_pdf(x: Column, mean: float, sd: float) -> Column:
    z = (x - F.lit(mean)) / F.lit(sd)
    return F.exp(-z * z / 2) / F.lit(sd * math.sqrt(2 * math.pi))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


class MarkerMask:
    """Cell-type markers as bits, in the order they were added."""

    def __init__(self, markers: list[tuple[str, str]]):
        #: (name, colour)
        self.markers: list[tuple[str, str]] = []
        for name, color in markers:
            self.add(name, color)

    def add(self, name: str, color: str) -> None:
        if name not in self.available():
            self.markers.append((name, color))

    def available(self) -> dict[str, int]:
        return {name: 1 << i for i, (name, _) in enumerate(self.markers)}

    def bit(self, name: Column) -> Column:
        """The bit of a marker name; a null name has none, an unknown one raises."""
        out = F.when(name.isNull(), F.lit(None).cast("long"))
        for n, b in self.available().items():
            out = out.when(name == n, F.lit(b).cast("long"))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown marker: "), name)).cast("long"))

    def encode(self, df: DataFrame, by: list[str], name_col: str) -> DataFrame:
        """``encode``: the union of the bits of each group's markers; 0 without any."""
        return df.groupBy(*by).agg(F.coalesce(F.bit_or(self.bit(F.col(name_col))), F.lit(0).cast("long")).alias("encode"))

    def _checked(self, mask: Column) -> Column:
        most = (1 << len(self.markers)) - 1
        return F.when(mask <= most, mask).otherwise(F.raise_error(F.lit("encoding holds unknown markers")).cast("long"))

    def decode(self, mask: Column) -> Column:
        """Names of the set bits, in marker order."""
        m = self._checked(mask)
        picks = [F.when(m.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(n)) for n, b in self.available().items()]
        return F.array_compact(F.array(*picks))

    def color(self, mask: Column) -> Column:
        out = F.when(mask == 0, F.lit(NO_TYPE_COLOR))
        for i, (_, c) in enumerate(self.markers):
            out = out.when(mask == (1 << i), F.lit(c))
        return out.otherwise(F.lit(MIXED_COLOR))

    def name(self, mask: Column) -> Column:
        out = F.when(mask == 0, F.lit("Unknown"))
        for i, (n, _) in enumerate(self.markers):
            out = out.when(mask == (1 << i), F.lit(n))
        return out.otherwise(F.lit("Mixed"))

    def label(self, mask: Column, types: dict[str, str] | None = None) -> Column:
        """Comma-joined cell types of the set markers (the marker's name where it has none)."""
        types = types or {}
        picks = F.array_join(F.array(*()).cast("array<string>"), ",")
        m = self._checked(mask)
        names = [F.when(m.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(types.get(n, n))) for n, b in self.available().items()]
        return F.array_join(F.array_compact(F.array(*names)), ",") if names else picks


def cell_number(position: Column) -> Column:
    """``Cell00001`` from a position counted from 1."""
    return F.format_string("Cell%05d", position)


def batch_cell(batch: Column, cell: Column) -> Column:
    """``batch_Cell1`` from ``Cell00001``."""
    return F.concat(batch, F.lit("_Cell"), F.substring(cell, 5, 20).cast("int").cast("string"))


def is_cell_column(name: Column) -> Column:
    return name.rlike(r"^Cell\d+$")


def feature_names(features: DataFrame, *, mz_col: str = "mz_center", name_col: str = "metabolite", id_col: str = "feature", decimals: int = 3, prefix: str = "mz_", sanitize: bool = True, suffix: str = "-") -> DataFrame:
    """``name`` for each feature: its metabolite if that isn't blank, else prefix and rounded mass; repeats get a numbered suffix.

    Repeats are numbered within a name only, so the window is as wide as one name's features.
    """
    text = F.trim(F.col(name_col))
    if sanitize:
        text = F.regexp_replace(text, r"\s+", "_")
    raw = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.concat(F.lit(prefix), F.format_string(f"%.{decimals}f", F.col(mz_col))))
    order = Window.partitionBy("_raw").orderBy(id_col)
    named = features.withColumn("_raw", raw).withColumn("_nth", F.row_number().over(order))
    return named.withColumn("name", F.when(F.col("_nth") == 1, F.col("_raw")).otherwise(F.concat("_raw", F.lit(suffix), (F.col("_nth") - 1).cast("string")))).drop("_raw", "_nth")
