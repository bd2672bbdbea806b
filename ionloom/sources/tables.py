"""Batch and group files, dataset directories, sinks."""

from __future__ import annotations

import logging
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running
from .workbooks import read_workbooks, write_workbooks


def file_name() -> Column:
    """The name of the file a row was read from; the reader has it with percent escapes, in which a plus is a plus."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_batches(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """All CSV, Parquet or .xlsx files of a directory with ``batch``, the file's name without extension and ``prefix``; of which kind they are, the path's end says."""
    if re.search(r"\.xls$", path, re.I):
        raise ValueError("old binary spreadsheets need to be saved as .xlsx, CSV or Parquet first")
    if re.search(r"\.xlsx$", path, re.I):
        stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]+)?$", 1)
        return read_workbooks(spark, path).withColumn("batch", F.regexp_replace(stem, "^" + re.escape(prefix), "")).drop("file_name")
    kind = "parquet" if path.rstrip("/*").endswith("parquet") else "csv"
    reader = spark.read.option("header", "true").option("inferSchema", "true") if kind == "csv" else spark.read
    name = F.regexp_extract(file_name(), r"^(.*?)(\.[^.]+)?$", 1)
    return reader.format(kind).load(path).select("*", F.regexp_replace(name, "^" + re.escape(prefix), "").alias("batch"))


@dataclass
class Dataset:
    """Named tables of one acquisition or study, kept as a directory of Parquet tables."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, path: str, mode: str = "overwrite") -> None:
        for name, df in self.tables.items():
            df.write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: Sequence[str]) -> Dataset:
        return cls({n: spark.read.parquet(f"{path}/{n}") for n in names})

    def status(self) -> dict[str, list[str]]:
        return {n: df.columns for n, df in self.tables.items()}


def cell_feature_table(matrix: DataFrame, obs: DataFrame, var: DataFrame, var_columns: Sequence[str] = (), cells: Sequence[str] | None = None) -> DataFrame:
    """Features by cells in wide form: cells renumbered by start time, feature columns in front.

    The number of columns is that of the cells, so this is for export of one run, and
    :func:`cell_feature_rows` for any number of cells; give ``cells`` (the new names) where they are
    known, else they are looked up.
    """
    numbered = _numbered(obs)
    names = list(cells) if cells is not None else [f"Cell{i + 1:05d}" for i in range(numbered.count())]
    wide = matrix.join(numbered, "cell").groupBy("feature").pivot("name", names).agg(F.max("value"))
    return var.select("feature", *var_columns).join(wide, "feature")


def cell_feature_rows(matrix: DataFrame, obs: DataFrame, var: DataFrame, var_columns: Sequence[str] = ()) -> DataFrame:
    """``feature, name, value`` after the feature columns: a row for each feature of ``var`` and each cell, renumbered by start time; null where the matrix has none.

    Of several values of a feature and cell the greatest counts.
    """
    values = matrix.groupBy("feature", "cell").agg(F.max("value").alias("value"))
    every = _numbered(obs).crossJoin(var.select("feature", *var_columns))
    return every.join(values, ["feature", "cell"], "left").select("feature", *var_columns, "name", "value")


def _numbered(obs: DataFrame) -> DataFrame:
    """``cell, name``: cells numbered by start time."""
    return running(obs.select("scan_start_time", "cell"), ["scan_start_time", "cell"]).select("cell", F.format_string("Cell%05d", F.col("number")).alias("name"))


def read_library(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A library (of metabolites, markers or colours) from CSV, TSV, .xlsx or Parquet, its columns renamed by ``columns``; those named must be there."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "tsv", "parquet", "xlsx"):
        raise ValueError(f"can't read {kind}; use csv, tsv, xlsx or parquet")
    text = spark.read.option("header", "true").option("inferSchema", "true").option("sep", "\t" if kind == "tsv" else ",")
    df = spark.read.parquet(path) if kind == "parquet" else read_workbooks(spark, path).drop("file_name") if kind == "xlsx" else text.csv(path)
    if gone := [c for c in columns or {} if c not in df.columns]:
        raise KeyError(f"not among the columns: {gone}")
    return df.withColumnsRenamed(columns or {})


class RunLog(logging.Handler):
    """Keeps a run's log records, a bounded number of the latest, and gives them as a table."""

    def __init__(self, most: int = 10_000):
        super().__init__()
        self.records: deque[tuple[float, str, str]] = deque(maxlen=most)

    def emit(self, record: logging.LogRecord) -> None:
        self.records.append((record.created, record.levelname, record.getMessage()))

    def table(self, spark: SparkSession) -> DataFrame:
        """``created`` (seconds), ``level``, ``message`` in the order they came."""
        return spark.createDataFrame(list(self.records), "created double, level string, message string")


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by extension: .csv, .tsv, .xlsx (a folder of such files) or .parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(path)
    elif kind in ("csv", "tsv"):
        writer.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "xlsx":
        write_workbooks(df, path, mode)
    else:
        raise ValueError(f"can't write {kind}; use csv, tsv, xlsx or parquet")


def annotations(files: DataFrame, markers: DataFrame | None = None, colors: DataFrame | None = None, name: str = "filename") -> DataFrame:
    """What file names say: ``base``, and for each annotated cell type its marker, channel, mass and colour.

    ``base(@cell$marker#channel&...@).ext``.  With ``markers`` (marker_name, mz) and ``colors``
    (cell_type, color_code), an unknown name raises; without them mass or colour is null.
    """
    # the extension goes; what stands between the first '@' and one at the end is the annotation
    stem = F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1)
    halves = F.split(stem, "@", 2)
    closed = (F.size(halves) == 2) & (F.element_at(halves, 1) != "") & F.endswith(stem, F.lit("@")) & (F.char_length(F.get(halves, F.lit(1))) > 1)
    note = F.trim(F.regexp_replace(F.get(halves, F.lit(1)), "@$", ""))
    named = files.select(name, F.when(closed, F.get(halves, F.lit(0))).otherwise(stem).alias("base"), F.when(closed, note).otherwise("").alias("_ann"))
    named = named.withColumn("base", F.when(F.col("base") == "", F.raise_error(F.concat(F.lit("file name has no extension: "), F.col(name)))).otherwise(F.col("base")))
    parts = named.select(name, "base", F.explode_outer(F.when(F.col("_ann") != "", F.split("_ann", "&"))).alias("_e"))
    # cell$marker#channel, of which marker and channel may be missing
    e, blank = F.col("_e"), lambda c: F.nullif(c, F.lit(""))
    front, channel = F.split_part(e, F.lit("#"), F.lit(1)), F.when(F.contains(e, F.lit("#")), F.substring(e, F.instr(e, "#") + 1, F.char_length(e)))
    marker = F.when(F.contains(front, F.lit("$")), F.substring(front, F.instr(front, "$") + 1, F.char_length(front)))
    out = parts.select(name, "base", blank(F.split_part(front, F.lit("$"), F.lit(1))).alias("cell_type"), blank(marker).alias("marker_name"), blank(channel).alias("channel"))
    if markers is not None:
        out = out.join(markers.select("marker_name", "mz").dropDuplicates(["marker_name"]), "marker_name", "left")
        missing = F.col("marker_name").isNotNull() & F.col("mz").isNull()
        out = out.withColumn("mz", F.when(missing, F.raise_error(F.concat(F.lit("unknown marker: "), F.col("marker_name"))).cast("double")).otherwise(F.col("mz")))
    else:
        out = out.withColumn("mz", F.lit(None).cast("double"))
    if colors is not None:
        out = out.join(colors.select("cell_type", "color_code").dropDuplicates(["cell_type"]), "cell_type", "left")
        missing = F.col("cell_type").isNotNull() & F.col("color_code").isNull()
        out = out.withColumn("color_code", F.when(missing, F.raise_error(F.concat(F.lit("unknown cell type: "), F.col("cell_type"))).cast("string")).otherwise(F.col("color_code")))
    else:
        out = out.withColumn("color_code", F.lit(None).cast("string"))
    usable = F.col("marker_name").isNotNull() & F.coalesce(F.col("mz") != 0, F.lit(False)) & F.col("color_code").isNotNull()
    return out.select(name, "base", "cell_type", "marker_name", "channel", "mz", "color_code", usable.alias("is_marker"))
