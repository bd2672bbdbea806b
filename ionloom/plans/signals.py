"""Queries on signals, events and mass peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ppm, scalars
from ..operators import features, joins, peaks, signal
from .catalogue import query
from .roles import BASE_SQL, LIBRARY_SQL, PEAKS_SQL, SIGNAL_SQL, TIE, fixed, fixed_sql, library, positions, table
from .roles import peaks as peak_table
from .roles import signal as series

KEYS = ["event_type"]


@query(
    "scan_project_filter",
    "SELECT l_suppkey::BIGINT AS cell, l_extendedprice AS mz, l_quantity AS intensity FROM lineitem WHERE l_quantity >= 40",
)
def scan_project_filter(spark, sf):
    return peaks.above(peak_table(spark, sf), 40.0).select("cell", "mz", "intensity")


@query("ppm_bounds", "SELECT p_partkey, p_retailprice - p_retailprice * 10.0::DOUBLE * 1e-6::DOUBLE AS low, p_retailprice + p_retailprice * 10.0::DOUBLE * 1e-6::DOUBLE AS high FROM part")
def ppm_bounds(spark, sf):
    low, high = ppm.bounds(F.col("p_retailprice"), 10)
    return table(spark, sf, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query(
    "ppm_bounds_two_regimes",
    """SELECT p_partkey, mz - half AS low, mz + half AS high FROM (SELECT p_partkey, mz,
       CASE WHEN mz <= 400 THEN 0.003::DOUBLE ELSE mz * 10.0::DOUBLE * 1e-6::DOUBLE END AS half FROM (SELECT p_partkey, p_retailprice / 2.3::DOUBLE AS mz FROM part))""",
)
def ppm_bounds_two_regimes(spark, sf):
    parts = table(spark, sf, "part").withColumn("mz", F.col("p_retailprice") / 2.3)
    low, high = ppm.bounds(F.col("mz"), "TypeI")
    return parts.select("p_partkey", low.alias("low"), high.alias("high"))


@query(
    "ppm_differences",
    f"""SELECT p_partkey, {fixed_sql("abs(p_retailprice - 950.0::DOUBLE) / least(p_retailprice, 950.0::DOUBLE) * 1e6::DOUBLE", 3)} AS ppm_smaller,
        {fixed_sql("abs(p_retailprice - 950.0::DOUBLE) / 950.0::DOUBLE * 1e6::DOUBLE", 3)} AS ppm_reference FROM part""",
)
def ppm_differences(spark, sf):
    mz, ref = F.col("p_retailprice"), F.lit(950.0)
    return table(spark, sf, "part").select("p_partkey", fixed(ppm.difference(mz, ref), 3).alias("ppm_smaller"), fixed(ppm.difference_to(mz, ref), 3).alias("ppm_reference"))


_SCALE = 1 - (abs(760.5851 - 760.5803) / 760.5803 * 1e6) / 1e6


@query("mz_reference_correction", f"SELECT p_partkey, p_retailprice * {_SCALE!r}::DOUBLE AS mz FROM part")
def mz_reference_correction(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("mz"))
    return ppm.correct_to_reference(parts, 760.5803)


@query(
    "time_window_mask",
    f"WITH {SIGNAL_SQL} SELECT event_type, idx::BIGINT AS index, CASE WHEN NOT ((t >= 60 AND t <= 600) OR t >= 20000) THEN data END AS data FROM series",
)
def time_window_mask(spark, sf):
    return signal.mask_periods(series(spark, sf), [(60, 600), (20000, None)]).select("event_type", "index", "data")


@query(
    "signal_block_baseline",
    f"WITH {BASE_SQL} SELECT event_type, idx::BIGINT AS index, block::BIGINT AS block, {fixed_sql('baseline')} AS baseline, {fixed_sql('signal')} AS signal FROM corrected",
)
def signal_block_baseline(spark, sf):
    out = signal.with_signal(signal.median_baseline(series(spark, sf), KEYS))
    return out.select("event_type", "index", "block", fixed(F.col("baseline")).alias("baseline"), fixed(F.col("signal")).alias("signal"))


THRESHOLD_SQL = (
    BASE_SQL
    + """,
ends AS (SELECT event_type, quantile_cont(signal, 0.05::DOUBLE) AS lo, quantile_cont(signal, 0.95::DOUBLE) AS hi FROM corrected GROUP BY 1),
limits AS (SELECT event_type, avg(signal) + 3.0::DOUBLE * stddev_pop(signal) AS threshold FROM corrected JOIN ends USING (event_type) WHERE signal >= lo AND signal <= hi GROUP BY 1)"""
)


@query("trimmed_threshold", f"WITH {THRESHOLD_SQL} SELECT event_type, {fixed_sql('threshold')} AS threshold FROM limits")
def trimmed_threshold(spark, sf):
    base = signal.with_signal(signal.median_baseline(series(spark, sf), KEYS))
    return signal.trimmed_threshold(base, KEYS, k=3).withColumn("threshold", fixed(F.col("threshold")))


MAXIMA_SQL = (
    THRESHOLD_SQL
    + """,
sides AS (SELECT *, lag(signal) OVER w AS b, lead(signal) OVER w AS a FROM corrected WINDOW w AS (PARTITION BY event_type ORDER BY idx)),
maxima AS (SELECT s.* FROM sides s JOIN limits USING (event_type) WHERE a - signal <= 0 AND signal - b > 0 AND signal >= threshold)"""
)


@query("local_maxima", f"WITH {MAXIMA_SQL} SELECT event_type, idx::BIGINT AS index, {fixed_sql('signal')} AS signal FROM maxima")
def local_maxima(spark, sf):
    base = signal.with_signal(signal.median_baseline(series(spark, sf), KEYS))
    limit = signal.trimmed_threshold(base, KEYS, k=3)
    found = signal.local_maxima(base.join(limit, KEYS), KEYS, min_height="threshold")
    return found.select("event_type", "index", fixed(F.col("signal")).alias("signal"))


@query(
    "local_maxima_edges",
    f"""WITH {SIGNAL_SQL}, d AS (SELECT *, data - lag(data) OVER w AS u, lead(data) OVER w - data AS v FROM series WINDOW w AS (PARTITION BY event_type ORDER BY idx))
    SELECT event_type, 'strict' AS edge, count(*)::BIGINT AS n FROM d WHERE v < 0 AND u > 0 GROUP BY 1
    UNION ALL SELECT event_type, 'rising', count(*)::BIGINT FROM d WHERE v <= 0 AND u > 0 GROUP BY 1
    UNION ALL SELECT event_type, 'falling', count(*)::BIGINT FROM d WHERE v < 0 AND u >= 0 GROUP BY 1
    UNION ALL SELECT event_type, 'valley', count(*)::BIGINT FROM d WHERE v >= 0 AND u < 0 GROUP BY 1""",
)
def local_maxima_edges(spark, sf):
    s = series(spark, sf)
    kinds = {"strict": (None, False), "rising": ("rising", False), "falling": ("falling", False), "valley": ("rising", True)}
    parts = [signal.local_maxima(s, KEYS, "data", edge=e, valley=v).groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.lit(k).alias("edge"), "n") for k, (e, v) in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("signal_events")
def signal_events(spark, sf):
    """Detected events of each series; suppression has no SQL form."""
    return signal.detect_events(series(spark, sf), KEYS, k=3, interval=6).select("event_type", "index", fixed(F.col("signal")).alias("signal"))


@query("signal_events_spline")
def signal_events_spline(spark, sf):
    return signal.detect_events(series(spark, sf), KEYS, k=3, interval=6, method="mixture_spline").select("event_type", "index", fixed(F.col("signal")).alias("signal"))


@query(
    "flank_check",
    f"""WITH {BASE_SQL}, f AS (SELECT event_type, idx,
        avg(baseline) OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) - avg(baseline) OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS flank FROM based)
        SELECT event_type, idx::BIGINT AS index, {fixed_sql("flank", 9)} AS flank FROM f""",
)
def flank_check(spark, sf):
    out = signal.flank_check(signal.median_baseline(series(spark, sf), KEYS), KEYS, reach=100)
    return out.select("event_type", "index", fixed(F.col("flank"), 9).alias("flank"))


# events of several markers


@query("events_offset_semi", "SELECT DISTINCT a.event_id::BIGINT AS index FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.event_id IN (a.event_id - 2, a.event_id, a.event_id + 2))")
def events_offset_semi(spark, sf):
    return joins.offset_semi(positions(spark, sf, "purchase"), positions(spark, sf, "view"), 2)


@query("events_offset_anti", "SELECT DISTINCT a.event_id::BIGINT AS index FROM events a WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.event_id IN (a.event_id - 2, a.event_id, a.event_id + 2))")
def events_offset_anti(spark, sf):
    return joins.offset_anti(positions(spark, sf, "purchase"), positions(spark, sf, "view"), 2)


@query(
    "events_merge",
    """SELECT 'merged' AS strategy, a.event_id::BIGINT AS index FROM events a WHERE event_type = 'purchase'
         AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.event_id IN (a.event_id - 1, a.event_id, a.event_id + 1))
         AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND b.event_id IN (a.event_id - 1, a.event_id, a.event_id + 1))
       UNION ALL SELECT 'only_' || a.event_type, a.event_id::BIGINT FROM events a WHERE event_type IN ('view', 'click')
         AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.event_id IN (a.event_id - 1, a.event_id, a.event_id + 1))""",
)
def events_merge(spark, sf):
    sets = joins.merge_events(positions(spark, sf, "purchase"), {k: positions(spark, sf, k) for k in ("view", "click")})
    out = None
    for name, df in sets.items():
        one = df.select(F.lit(name).alias("strategy"), "index")
        out = one if out is None else out.unionByName(one)
    return out


@query("apex_earliest_interval", "SELECT a.event_id::BIGINT AS index, min(b.event_id)::BIGINT AS apex FROM events a LEFT JOIN events b ON b.event_type = 'error' AND b.event_id BETWEEN a.event_id - 3 AND a.event_id + 3 WHERE a.event_type = 'signup' GROUP BY a.event_id")
def apex_earliest_interval(spark, sf):
    return joins.earliest_within(positions(spark, sf, "signup"), positions(spark, sf, "error").withColumnRenamed("index", "apex"), 3)


@query("close_elements", "SELECT a.event_id::BIGINT AS index FROM events a WHERE a.event_type = 'signup' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.event_id BETWEEN a.event_id - 1 AND a.event_id + 1)")
def close_elements(spark, sf):
    return joins.close_elements(positions(spark, sf, "signup"), positions(spark, sf, "error"), 1)


@query(
    "event_neighbourhood",
    """SELECT e.event_id::BIGINT AS index, (n.event_id - e.event_id)::INTEGER AS pos, n.value AS intensity FROM events e JOIN events n ON n.event_id BETWEEN e.event_id - 1 AND e.event_id + 1 WHERE e.event_type = 'purchase'""",
)
def event_neighbourhood(spark, sf):
    spectra = table(spark, sf, "events").select(F.col("event_id").alias("index"), F.col("value").alias("intensity"))
    return joins.neighbourhood(positions(spark, sf, "purchase"), spectra, 1).select("index", "pos", "intensity")


MASK = scalars.MarkerMask([("click", "#ff0000"), ("error", "#00ff00"), ("purchase", "#0000ff"), ("signup", "#ffff00"), ("view", "#00ffff")])


@query(
    "celltype_bitmask",
    """WITH e AS (SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END) AS encode
         FROM events WHERE value > 150 GROUP BY user_id)
       SELECT user_id::BIGINT AS user_id, encode::BIGINT AS encode,
         concat_ws(',', CASE WHEN encode & 1 <> 0 THEN 'click' END, CASE WHEN encode & 2 <> 0 THEN 'fault' END, CASE WHEN encode & 4 <> 0 THEN 'purchase' END, CASE WHEN encode & 8 <> 0 THEN 'signup' END, CASE WHEN encode & 16 <> 0 THEN 'view' END) AS cell_type,
         CASE encode WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 4 THEN 'purchase' WHEN 8 THEN 'signup' WHEN 16 THEN 'view' ELSE 'Mixed' END AS name,
         CASE encode WHEN 1 THEN '#ff0000' WHEN 2 THEN '#00ff00' WHEN 4 THEN '#0000ff' WHEN 8 THEN '#ffff00' WHEN 16 THEN '#00ffff' ELSE '#dc143c' END AS color,
         bit_count(encode)::INTEGER AS n_types FROM e""",
)
def celltype_bitmask(spark, sf):
    coded = MASK.encode(table(spark, sf, "events").where("value > 150"), ["user_id"], "event_type")
    c = F.col("encode")
    return coded.select("user_id", "encode", MASK.label(c, {"error": "fault"}).alias("cell_type"), MASK.name(c).alias("name"), MASK.color(c).alias("color"), F.size(MASK.decode(c)).alias("n_types"))


# mass peaks


def _channel(mode):
    def run(spark, sf):
        scans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan"))
        spectra = peak_table(spark, sf).withColumnRenamed("l_orderkey", "scan")
        return peaks.extract_channel(scans, spectra, 50000.0, 200_000, mode, order=("l_linenumber", "l_partkey"))

    return run


for _mode, _value in (("nearest", "arg_min(intensity, (abs(mz - 50000.0), l_linenumber, l_partkey))"), ("sum", "sum(intensity)"), ("max", "max(intensity)")):
    query(
        f"scan_{_mode}",
        f"""WITH {PEAKS_SQL}, hit AS (SELECT l_orderkey AS scan, arg_min(mz, (abs(mz - 50000.0), l_linenumber, l_partkey)) AS mz, {_value} AS intensity, count(*) AS n
            FROM peaks WHERE mz BETWEEN 40000.0::DOUBLE AND 60000.0::DOUBLE GROUP BY 1)
            SELECT o_orderkey AS scan, mz, intensity, coalesce(n, 0)::BIGINT AS n_peaks FROM orders LEFT JOIN hit ON scan = o_orderkey""",
    )(_channel(_mode))

CHAIN_SQL = (
    PEAKS_SQL
    + """,
flagged AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 <= 200 THEN 0 ELSE 1 END AS new FROM peaks WINDOW w AS (PARTITION BY cell ORDER BY mz, l_orderkey, l_linenumber, l_partkey)),
chained AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY mz, l_orderkey, l_linenumber, l_partkey) AS island FROM flagged)"""
)


@query(
    "ppm_islands_argmax",
    f"WITH {CHAIN_SQL} SELECT cell, island::BIGINT AS island, max(intensity) AS intensity, min(mz) FILTER (intensity = top) AS mz FROM (SELECT *, max(intensity) OVER (PARTITION BY cell, island) AS top FROM chained) GROUP BY cell, island",
)
def ppm_islands_argmax(spark, sf):
    return peaks.merge_chains(peak_table(spark, sf), ["cell"], 200, tie=TIE).select("cell", "island", "intensity", "mz")


@query(
    "global_chains",
    """WITH d AS (SELECT DISTINCT l_extendedprice AS mz FROM lineitem), f AS (SELECT mz, CASE WHEN (mz - lag(mz) OVER (ORDER BY mz)) / lag(mz) OVER (ORDER BY mz) * 1e6 < 10 THEN 0 ELSE 1 END AS new FROM d)
       SELECT mz, (sum(new) OVER (ORDER BY mz))::BIGINT AS island FROM f""",
)
def global_chains(spark, sf):
    return peaks.global_chains(peak_table(spark, sf).select("mz").distinct(), 10, strict=True).select("mz", "island")


@query(
    "mz_conflicts",
    f"""WITH {PEAKS_SQL}, s AS (SELECT *, (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 AS b, (lead(mz) OVER w - mz) / mz * 1e6 AS a FROM peaks WINDOW w AS (PARTITION BY cell ORDER BY mz, l_orderkey, l_linenumber, l_partkey))
        SELECT cell, l_orderkey, l_linenumber, l_partkey, mz FROM s WHERE b < 10 OR a < 10""",
)
def mz_conflicts(spark, sf):
    return peaks.conflicts(peak_table(spark, sf), ["cell"], 10, tie=TIE).select("cell", *TIE, "mz")


@query(
    "hits_distinct_window",
    f"""WITH {PEAKS_SQL}, lo AS (SELECT *, ln(mz) AS x FROM peaks)
        SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.cell, a.mz,
          count(DISTINCT b.cell)::INTEGER AS hits, (count(DISTINCT b.cell) FILTER (b.mz <= a.mz))::INTEGER AS left_hits, (count(DISTINCT b.cell) FILTER (b.mz > a.mz))::INTEGER AS right_hits
        FROM peaks a JOIN peaks b ON b.mz BETWEEN a.mz * (1 - 33e-6::DOUBLE) AND a.mz * (1 + 33e-6::DOUBLE) GROUP BY ALL""",
)
def hits_distinct_window(spark, sf):
    return features.hits(peak_table(spark, sf).distinct(), 33).select(*TIE, "cell", "mz", "hits", "left_hits", "right_hits")


@query(
    "band_join_annotate",
    f"""WITH {LIBRARY_SQL} SELECT p.p_partkey AS feature, coalesce(string_agg(metabolite, '/' ORDER BY lib_pos, metabolite), '') AS metabolite
        FROM part p LEFT JOIN lib ON abs(p.p_retailprice * 20 - lib_mz) / lib_mz * 1e6 < 500 GROUP BY 1""",
)
def band_join_annotate(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_retailprice") * 20).alias("mz_mean"))
    return features.annotate(parts, library(spark, sf), 500).select("feature", "metabolite")


LIBRARY_FEATURES_SQL = f"""{PEAKS_SQL}, {LIBRARY_SQL},
kept AS (SELECT * FROM peaks WHERE intensity >= 10),
met AS (SELECT lib_pos AS feature, ref_mz, cell, mz, intensity FROM kept JOIN (SELECT min(lib_mz) AS ref_mz, lib_pos FROM lib GROUP BY lib_pos) ON abs(mz - ref_mz) / ref_mz * 1e6 <= 100),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature, cell ORDER BY intensity DESC, mz) AS r FROM met) WHERE r = 1)"""


def _library_features(spark, sf):
    lib = library(spark, sf).groupBy(F.col("lib_pos").alias("feature")).agg(F.min("lib_mz").alias("ref_mz"))
    return features.library_features(peak_table(spark, sf).select("cell", "mz", "intensity"), lib, 100, 10, single=True)


@query("feature_matrix_long", f"WITH {LIBRARY_FEATURES_SQL} SELECT feature, cell, mz, intensity FROM best")
def feature_matrix_long(spark, sf):
    return _library_features(spark, sf)[0].select("feature", "cell", "mz", "intensity")


@query(
    "library_features",
    f"""WITH {LIBRARY_FEATURES_SQL} SELECT feature, {fixed_sql("avg(mz)", 6)} AS mz_mean, {fixed_sql("median(mz)", 3)} AS mz_median, count(DISTINCT cell)::BIGINT AS n_cells,
        {fixed_sql("count(DISTINCT cell)::DOUBLE / (SELECT count(DISTINCT cell) FROM kept) * 100")} AS hit_rate FROM best GROUP BY 1""",
)
def library_features(spark, sf):
    s = _library_features(spark, sf)[1]
    return s.select("feature", fixed(F.col("mz_mean"), 6).alias("mz_mean"), fixed(F.col("mz_median"), 3).alias("mz_median"), "n_cells", fixed(F.col("hit_rate")).alias("hit_rate"))


@query(
    "feature_matrix_wide",
    f"""WITH w AS (SELECT l_suppkey AS cell, l_returnflag AS f, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
        SELECT cell, max(q) FILTER (f = 'A') AS "A", max(q) FILTER (f = 'N') AS "N", max(q) FILTER (f = 'R') AS "R" FROM w GROUP BY cell""",
)
def feature_matrix_wide(spark, sf):
    long = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("feature"), F.col("l_quantity").alias("value"))
    return features.feature_matrix(long, ["A", "N", "R"])


@query("heuristic_features")
def heuristic_features(spark, sf):
    return features.heuristic_features(peak_table(spark, sf), 10, 10)


@query("hrgc_features")
def hrgc_features(spark, sf):
    return features.hit_rate_features(peak_table(spark, sf), 10, 0.03, 10)


@query("kde_center")
def kde_center(spark, sf):
    return peaks.density_center(peak_table(spark, sf).select("cell", "mz"), ["cell"])


@query(
    "herfindahl",
    f"SELECT l_suppkey::BIGINT AS cell, {fixed_sql('1 - sqrt(avg((1 - l_quantity / 50.0::DOUBLE) * (1 - l_quantity / 50.0::DOUBLE)))')} AS hhi FROM lineitem GROUP BY 1",
)
def herfindahl(spark, sf):
    members = peak_table(spark, sf).select("cell", F.col("intensity").alias("hits"), F.lit(50.0).alias("hit"))
    return features.herfindahl(members, ["cell"]).select("cell", fixed(F.col("hhi")).alias("hhi"))


@query("continuity_runs", "SELECT event_type, min(event_id)::BIGINT AS first, count(*)::BIGINT AS n FROM (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) GROUP BY event_type, g HAVING count(*) >= 3")
def continuity_runs(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("event_id").alias("index"))
    return features.runs(e, ["event_type"]).groupBy("event_type", "run").agg(F.min("index").alias("first"), F.count("*").alias("n")).where("n >= 3").drop("run")
