"""Whole analyses on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import MarkerMask
from ..operators import workflows
from .catalogue import query
from .roles import fixed, table
from .roles import signal as series


def _acquisition(spark, sf):
    """Events as scans of one run in blocks of time; line items of an order as a scan's spectrum."""
    orders = table(spark, sf, "orders")
    scans = orders.select(F.lit("run").alias("run_id"), F.col("o_orderkey").alias("scan_index"), (F.col("o_orderkey") / F.lit(100.0)).alias("scan_start_time"), F.col("o_totalprice").alias("tic"))
    items = table(spark, sf, "lineitem")
    peak_table = items.select(F.lit("run").alias("run_id"), F.col("l_orderkey").alias("scan_index"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))
    return scans, peak_table


@query("extract_events")
def extract_events(spark, sf):
    """Events of the total ion current and of one mass, and what they have in common; tested on a fixture."""
    scans, peak_table = _acquisition(spark, sf)
    out = workflows.extract_events(scans, peak_table, {"TIC": None, "price": 30000.0}, "TIC", k=1, ppm=2000, first_ppm=4000, method="median")
    return out["events"].select("run_id", "strategy", "scan_index")


@query(
    "cell_peaks",
    """WITH c AS (SELECT DISTINCT o_orderkey AS cell FROM orders),
       near AS (SELECT cell, l_extendedprice AS mz, l_quantity AS intensity, l_orderkey - cell AS pos FROM c JOIN lineitem ON l_orderkey BETWEEN cell - 1 AND cell + 1),
       m AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 <= 200 THEN 0 ELSE 1 END AS new FROM near WINDOW w AS (PARTITION BY cell ORDER BY mz)),
       i AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY mz) AS island FROM m)
       SELECT printf('Cell%05d', cell) AS cell, mz, intensity, pos::BIGINT AS pos FROM i QUALIFY row_number() OVER (PARTITION BY i.cell, island ORDER BY intensity DESC, mz, pos) = 1""",
)
def cell_peaks(spark, sf):
    scans, peak_table = _acquisition(spark, sf)
    cells = scans.select("run_id", "scan_index", F.format_string("Cell%05d", F.col("scan_index")).alias("cell"))
    return workflows.cell_peaks(cells, peak_table, 1, 200).select("cell", "mz", "intensity", "pos")


@query(
    "annotate_cells",
    """SELECT a.event_id::BIGINT AS scan_index, min(b.event_id) FILTER (b.event_type = 'click')::BIGINT AS click_index, min(b.event_id) FILTER (b.event_type = 'error')::BIGINT AS error_index,
         ((count(*) FILTER (b.event_type = 'click') > 0)::INTEGER + 2 * (count(*) FILTER (b.event_type = 'error') > 0)::INTEGER)::BIGINT AS cell_type_encode,
         concat_ws(',', CASE WHEN count(*) FILTER (b.event_type = 'click') > 0 THEN 'click' END, CASE WHEN count(*) FILTER (b.event_type = 'error') > 0 THEN 'error' END) AS cell_type,
         CASE WHEN count(DISTINCT b.event_type) = 0 THEN 'Unknown' WHEN count(DISTINCT b.event_type) = 2 THEN 'Mixed' ELSE min(b.event_type) END AS cell_type_name,
         CASE WHEN count(DISTINCT b.event_type) = 0 THEN '#DCDCDC' WHEN count(DISTINCT b.event_type) = 2 THEN '#dc143c' WHEN min(b.event_type) = 'click' THEN '#1' ELSE '#2' END AS cell_type_color
       FROM events a LEFT JOIN events b ON b.event_type IN ('click', 'error') AND b.event_id BETWEEN a.event_id - 1 AND a.event_id + 1 WHERE a.event_type = 'purchase' GROUP BY a.event_id""",
)
def annotate_cells(spark, sf):
    e = table(spark, sf, "events").select(F.lit("run").alias("run_id"), F.col("event_id").alias("index"), "event_type")
    mask = MarkerMask([("click", "#1"), ("error", "#2")])
    cells = e.where("event_type = 'purchase'").select("run_id", F.col("index").alias("scan_index"))
    apexes = {m: e.where(F.col("event_type") == m).select("run_id", "index") for m in ("click", "error")}
    return workflows.annotate_cells(cells, apexes, mask).drop("run_id")


@query("peak_matching")
def peak_matching(spark, sf):
    signals = series(spark, sf).withColumnRenamed("event_type", "feature")
    cells = signals.select(F.col("index").alias("scan_index")).distinct().select(F.format_string("Cell%05d", F.col("scan_index")).alias("cell"), "scan_index")
    return workflows.match_peaks(signals, cells, k=2).select("feature", "cell", "apex", fixed(F.col("intensity")).alias("intensity"))
