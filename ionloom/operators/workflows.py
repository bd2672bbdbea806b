"""Whole analyses, composed of the operators.

Each takes and returns tables; nothing runs until a result is asked for, except where a density
centre (one number for a marker) is needed to go on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MarkerMask, above_baseline, batch_cell, cell_number, feature_names
from ..sources.config import main_marker
from . import joins, peaks, signal
from .batch import align, kept_cells, merge
from .features import annotate, hit_rate_features
from .storage import Step

KEYS = ("run_id",)


def channel(scans: DataFrame, peak_table: DataFrame, marker: str, target: float | None, ppm: float = 10, first_ppm: float = 20) -> DataFrame:
    """The signal of one marker: ``run_id, marker, index, time, data``; the total ion current where the marker has no mass."""
    base = scans.select("run_id", F.col("scan_index").alias("index"), F.col("scan_start_time").alias("time"), "tic")
    if target is None:
        return base.select("run_id", F.lit(marker).alias("marker"), "index", "time", F.col("tic").alias("data"))
    spectra = peak_table.withColumnRenamed("scan_index", "index")
    found, _ = peaks.extract_channel_twice(base, spectra, target, ppm, first_ppm, keys=("run_id", "index"), order=("pos",))
    return found.select("run_id", F.lit(marker).alias("marker"), "index", "time", F.col("intensity").alias("data"))


def extract_events(scans: DataFrame, peak_table: DataFrame, markers: Mapping[str, float | None], main: str = "", *, poor: Sequence[tuple] = (), offset: int = 1, k: float = 3, interval: int = 6, ppm: float = 10, size: int = 100, method: str = "mixture_spline", first_ppm: float = 20) -> dict[str, DataFrame]:
    """Cell events: ``signals`` (all markers), ``events`` by strategy, ``cells`` numbered in acquisition order.

    With several markers the cells are the main marker's events matched in every other one.  The markers'
    events are written when this is called.
    """
    markers = dict(markers) or {"TIC": None}
    main = main_marker(markers, main)
    masked = signal.mask_periods(scans, signal.normal_periods(poor), "scan_start_time", ["tic"]) if poor else scans
    hidden = peak_table if not poor else peak_table.join(scans.where(~signal.within_periods(F.col("scan_start_time"), poor)).select("run_id", "scan_index"), ["run_id", "scan_index"], "left_semi")
    signals, found = None, {}
    for name, target in markers.items():
        one = channel(masked, hidden, name, target, ppm, first_ppm)
        signals = one if signals is None else signals.unionByName(one)
        # each set of events is few rows and is used in several merges
        found[name] = Step(signal.detect_events(one, ["run_id", "marker"], k, interval, size, method).select("run_id", "index")).df
    events = {m: e for m, e in found.items()}
    cells = found[main]
    if len(found) > 1:
        sets = joins.merge_events(found[main], {m: e for m, e in found.items() if m != main}, offset, KEYS)
        events |= sets
        cells = sets["merged"]
    order = Window.partitionBy("run_id").orderBy("index")
    numbered = cells.withColumn("cell", cell_number(F.row_number().over(order))).withColumnRenamed("index", "scan_index")
    table = None
    for name, e in events.items():
        one = e.select("run_id", F.lit(name).alias("strategy"), F.col("index").alias("scan_index"))
        table = one if table is None else table.unionByName(one)
    return {"signals": signals, "events": table, "cells": numbered.join(scans, ["run_id", "scan_index"])}


def annotate_cells(cells: DataFrame, apexes: Mapping[str, DataFrame], mask: MarkerMask, types: Mapping[str, str] | None = None, offset: int = 1) -> DataFrame:
    """Cells with the earliest apex of each marker within ``offset`` rows, and what the markers found say: mask, label, name, colour."""
    out, bits = cells, F.lit(0).cast("long")
    for name, events in apexes.items():
        near = joins.earliest_within(cells.select("run_id", F.col("scan_index").alias("index")), events.withColumnRenamed("index", "apex"), offset, KEYS)
        out = out.join(near.select("run_id", F.col("index").alias("scan_index"), F.col("apex").alias(f"{name}_index")), ["run_id", "scan_index"], "left")
        bits = bits.bitwiseOR(F.when(F.col(f"{name}_index").isNotNull(), F.lit(mask.available()[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("cell_type_encode", bits)
    c = F.col("cell_type_encode")
    return out.withColumns({"cell_type": mask.label(c, dict(types or {})), "cell_type_name": mask.name(c), "cell_type_color": mask.color(c)})


def cell_peaks(cells: DataFrame, peak_table: DataFrame, offset: int = 1, ppm: float = 10) -> DataFrame:
    """Peaks around each cell's scan, chained within ``ppm``; the strongest of each chain with the row it is from."""
    spectra = peak_table.select("run_id", "scan_index", F.col("pos").alias("peak"), "mz", "intensity")
    around = joins.neighbourhood(cells.select("run_id", "cell", "scan_index"), spectra, offset, KEYS, "scan_index")
    return peaks.merge_chains(around, ["run_id", "cell"], ppm, tie=["pos", "peak"]).drop("island", "peak")


def match_peaks(signals: DataFrame, cells: DataFrame, keys: Sequence[str] = ("feature",), *, offset: int = 1, k: float = 3, interval: int = 6, size: int = 100, method: str = "median") -> DataFrame:
    """For each feature's signal, cells whose row has one of its peaks within ``offset``; each takes its nearest peak, the earlier of equals."""
    apex = signal.detect_events(signals, list(keys), k, interval, size, method).select(*keys, F.col("index").alias("apex"), F.col("data").alias("intensity"))
    spread = apex.withColumn("index", F.explode(F.sequence(F.col("apex") - offset, F.col("apex") + offset)))
    met = cells.select("cell", F.col("scan_index").alias("index")).join(spread, "index")
    best = F.min_by(F.struct("apex", "intensity"), F.struct(F.abs(F.col("apex") - F.col("index")).alias("d"), "apex"))
    return met.groupBy(*keys, "cell").agg(best.alias("b")).select(*keys, "cell", "b.apex", "b.intensity")


def assemble(cells: DataFrame, matrix: DataFrame, signals: DataFrame, features: DataFrame | None = None, main: str = "TIC", *, size: int = 100, method: str = "median") -> dict[str, DataFrame]:
    """The tables of an analysis: ``obs``, ``var`` and the long matrix ``x``.

    ``obs``: the cells with ``tic_baseline`` (of the main marker, at the cell's own row),
    ``tic_corrected`` and ``n_metabolites``, the number of values a cell has.  ``x``: values as numbers,
    null where they are none.  ``var``: the features with the cells that have them, named by their
    metabolite or mass where ``features`` has these.  A cell without values counts 0.
    """
    own = signals.where(F.col("marker") == main)
    based = {"median": signal.median_baseline, "mixture_spline": signal.mixture_baseline}[method](own, ["run_id", "marker"], size)
    base = based.select("run_id", F.col("index").alias("scan_index"), F.col("baseline").alias("tic_baseline"))
    x = matrix.withColumn("value", F.col("value").cast("string").try_cast("double"))
    counts = x.groupBy("cell").agg(F.count("value").alias("n_metabolites"))
    obs = cells.join(base, ["run_id", "scan_index"], "left").join(counts, "cell", "left")
    obs = obs.withColumn("tic_corrected", above_baseline(F.col("tic"), F.col("tic_baseline"))).withColumn("n_metabolites", F.coalesce("n_metabolites", F.lit(0)))
    var = x.groupBy("feature").agg(F.count("value").alias("n_cells"))
    if features is not None:
        var = features.join(var, "feature", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
        if {"metabolite", "mz_center"} <= set(features.columns):
            var = feature_names(var)
    return {"obs": obs, "var": var, "x": x}


def without_events(cells: DataFrame, removed: DataFrame, number: str = "number") -> DataFrame:
    """Cells without those whose place in acquisition order (from 1, within the run) is listed, named anew in that order."""
    order = Window.partitionBy("run_id").orderBy("scan_index")
    placed = cells.withColumn("_n", F.row_number().over(order).cast("long"))
    gone = removed.select("run_id", F.col(number).cast("long").alias("_n")).distinct()
    return placed.join(gone, ["run_id", "_n"], "left_anti").withColumn("cell", cell_number(F.row_number().over(order))).drop("_n")


def update_matrix(cells: DataFrame, removed: DataFrame, peak_table: DataFrame, library: DataFrame, *, offset: int = 1, least_intensity: float = 200, least_rate: float = 0.1, ppm: float = 10) -> dict[str, DataFrame]:
    """What is left after events are removed: ``cells``, their ``peaks``, and the ``features`` found again and annotated."""
    kept = without_events(cells, removed)
    spectra = cell_peaks(kept, peak_table, offset, ppm)
    found = hit_rate_features(spectra, least_intensity, least_rate, ppm)
    numbered = found.withColumn("feature", F.xxhash64("mz_center", "hits"))
    return {"cells": kept, "peaks": spectra, "features": annotate(numbered, library, ppm)}


def split_batches(table: DataFrame, n_metadata: int = 8, batch: str = "batch", key: str = "feature") -> dict[str, DataFrame]:
    """A wide batch table (metadata columns in front, a column for each cell after them) as ``meta`` and the long ``matrix``.

    Both carry ``batch`` and a ``feature`` id made of the batch and the metadata; cells without a value
    have no row, and rows alike in all metadata are one feature.
    """
    columns = [c for c in table.columns if c not in (batch, key)]
    meta, cells = columns[:n_metadata], columns[n_metadata:]
    marked = table.withColumn(key, F.xxhash64(batch, *(F.col(f"`{c}`").cast("string") for c in meta)))
    numeric = marked.select(batch, key, *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in cells))
    long = numeric.unpivot([batch, key], cells, "cell", "value").where("value is not null") if cells else marked.select(batch, key, F.lit("").alias("cell"), F.lit(None).cast("double").alias("value")).limit(0)
    return {"meta": marked.select(batch, key, *(F.col(f"`{c}`") for c in meta)).dropDuplicates([batch, key]), "matrix": long}


def merge_all(tables: DataFrame, groups: DataFrame, n_metadata: int = 8, mz: str = "mz_mean", ppm: float = 10) -> dict[str, DataFrame]:
    """Batch tables and group files to one study: ``features`` merged over batches, ``matrix`` on them, and ``cells`` with their group's metadata.

    Only cells that a batch's group file lists take part.  Batches go by name.
    """
    parts = split_batches(tables, n_metadata)
    listed = groups.withColumnRenamed("CellNumber", "cell")
    kept = kept_cells(parts["matrix"], listed)
    names = sorted(r["batch"] for r in tables.select("batch").distinct().collect())  # a row per batch
    name = F.coalesce(F.col("metabolite"), F.lit("")) if "metabolite" in parts["meta"].columns else F.lit("")
    features = parts["meta"].select("batch", "feature", F.col(mz).cast("double").alias("mz"), name.alias("metabolite"))
    merged = merge_batches(features, kept, listed, names, ppm)
    island = align(features, ppm).select("batch", "feature", "island")
    long = kept.join(island, ["batch", "feature"]).groupBy("island", "batch", "cell").agg(F.max("value").alias("value"))
    cells = listed.withColumn("name", batch_cell(F.col("batch"), F.col("cell")))
    return {"features": merged, "matrix": long.withColumn("cell", batch_cell(F.col("batch"), F.col("cell"))), "cells": cells}


def merge_batches(features: DataFrame, matrix: DataFrame, groups: DataFrame, batches: list[str], ppm: float = 10) -> DataFrame:
    """Features of all batches aligned and merged, over the cells that the group files list."""
    kept = kept_cells(matrix, groups)
    counts = {r["batch"]: r["n"] for r in kept.groupBy("batch").agg(F.countDistinct("cell").alias("n")).collect()}  # a row per batch
    hits = kept.where(F.col("value").isNotNull()).groupBy("batch", "feature").agg(F.countDistinct("cell").alias("n_cells"))
    met = features.join(hits, ["batch", "feature"], "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    return merge(align(met, ppm), batches, {b: counts.get(b, 0) for b in batches})
