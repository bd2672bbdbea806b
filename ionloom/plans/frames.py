"""Queries on frames, analyses' tables, thresholds and optical traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import frames, matrix, ml, peaks, ranges, signal, workflows
from .analyses import _acquisition
from .catalogue import query
from .roles import BASE_SQL, fixed, fixed_sql, table, vectors
from .roles import peaks as peak_table
from .roles import signal as series


@query("sqrt_values", "SELECT event_id, CASE WHEN value - 50 >= 0 THEN sqrt(value - 50) END AS value FROM events")
def sqrt_values(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.sqrt(F.col("value") - 50).alias("value"))


@query(
    "raw_threshold",
    "WITH "
    + BASE_SQL
    + f""",
    ends AS (SELECT event_type, quantile_cont(data, 0.05) AS lo, quantile_cont(data, 0.95) AS hi FROM based WHERE data IS NOT NULL GROUP BY 1),
    lim AS (SELECT event_type, avg(data) + 5 * stddev_pop(data) AS top FROM based JOIN ends USING (event_type) WHERE data BETWEEN lo AND hi GROUP BY 1)
    SELECT event_type, idx::BIGINT AS index, {fixed_sql("top - coalesce(baseline, 0)", 3)} AS threshold FROM based JOIN lim USING (event_type)""",
)
def raw_threshold(spark, sf):
    based = signal.median_baseline(series(spark, sf), ["event_type"])
    return signal.raw_threshold(based, ["event_type"]).select("event_type", "index", fixed(F.col("threshold"), 3).alias("threshold"))


@query("intensity_threshold", f"SELECT {fixed_sql('avg(l_quantity)')} AS mean, median(l_quantity) AS median FROM lineitem")
def intensity_threshold(spark, sf):
    return peaks.intensity_threshold(peak_table(spark, sf)).select(fixed(F.col("mean")).alias("mean"), "median")


@query("peak_nms")
def peak_nms(spark, sf):
    """Local maxima of each series, with those near a higher one taken out; tested against brute force."""
    tops = signal.local_maxima(series(spark, sf), ["event_type"], "data", edge="rising")
    return signal.suppress(tops, ["event_type"], 6, "data").select("event_type", "index", "data")


@query("optical_peaks")
def optical_peaks(spark, sf):
    """Peaks of the series as optical traces; tested against brute force."""
    traces = series(spark, sf, gaps=False).select(F.col("event_type").alias("channel"), F.col("index").alias("idx"), F.col("time").alias("times"), F.col("data").alias("intensity"))
    found = signal.optical_peaks(traces, ["channel"], 1, 6, method="median", most=5.0)
    return found.select("channel", "idx", fixed(F.col("corrected_intensity")).alias("corrected_intensity"))


@query("extract_channel_twice")
def extract_channel_twice(spark, sf):
    """The masses about one target: a wide pass, the density centre found, and a narrow pass about it; tested against brute force."""
    scans, spectra = _acquisition(spark, sf)
    base = scans.select("run_id", F.col("scan_index").alias("index"))
    found, _ = peaks.extract_channel_twice(base, spectra.withColumnRenamed("scan_index", "index"), 30000.0, 2000, 4000, keys=("run_id", "index"), order=("pos",))
    return found.select("index", "mz", "intensity")


@query(
    "analysis_obs",
    """WITH cells AS (SELECT o_orderkey AS idx, o_totalprice AS tic FROM orders),
       numbered AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos FROM cells),
       blocked AS (SELECT *, least(floor(pos / 100)::BIGINT, greatest(ceil(count(*) OVER () / 100.0)::BIGINT - 2, 0)) AS block FROM numbered),
       based AS (SELECT idx, tic, median(tic) OVER (PARTITION BY block) AS baseline FROM blocked),
       counts AS (SELECT l_orderkey AS idx, count(l_quantity) AS n FROM lineitem GROUP BY 1)
       SELECT idx::BIGINT AS cell, baseline AS tic_baseline, floor((tic - baseline) * 100 + 0.5)::BIGINT AS cents, coalesce(n, 0)::BIGINT AS n_metabolites
       FROM based LEFT JOIN counts USING (idx)""",
)
def analysis_obs(spark, sf):
    scans, spectra = _acquisition(spark, sf)
    placed = ranges.running(scans, ["scan_index"]).withColumn("scan_index", F.col("number") - 1).withColumn("cell", F.round(F.col("scan_start_time") * 100).cast("long")).drop("number")
    signals = placed.select("run_id", F.lit("TIC").alias("marker"), F.col("scan_index").alias("index"), F.col("scan_start_time").alias("time"), F.col("tic").alias("data"))
    long = spectra.select(F.col("scan_index").alias("cell"), F.col("pos").alias("feature"), F.col("intensity").alias("value"))
    obs = workflows.assemble(placed, long, signals)["obs"]
    cents = F.floor(F.col("tic_corrected") * 100 + 0.5).cast("long")
    return obs.select("cell", "tic_baseline", cents.alias("cents"), "n_metabolites")


@query(
    "remove_events",
    """WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
       k AS (SELECT event_type, event_id FROM p WHERE n % 3 <> 0)
       SELECT event_type AS run_id, event_id::BIGINT AS scan_index, 'Cell' || lpad((row_number() OVER (PARTITION BY event_type ORDER BY event_id))::VARCHAR, 5, '0') AS cell FROM k""",
)
def remove_events(spark, sf):
    e = table(spark, sf, "events")
    cells = e.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("scan_index"))
    listed = cells.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    return workflows.without_events(cells, listed.where("number % 3 = 0"))


@query(
    "regress_out_many",
    f"""WITH s AS (SELECT o_orderstatus AS k, avg(o_custkey) AS mx, avg(o_orderkey) AS mz, avg(o_totalprice) AS my, var_pop(o_custkey) AS vx, var_pop(o_orderkey) AS vz,
           covar_pop(o_custkey, o_orderkey) AS c, covar_pop(o_totalprice, o_custkey) AS cx, covar_pop(o_totalprice, o_orderkey) AS cz FROM orders GROUP BY 1)
        SELECT o_orderkey, {fixed_sql("o_totalprice - my - (cx * vz - cz * c) / (vx * vz - c * c) * (o_custkey - mx) - (cz * vx - cx * c) / (vx * vz - c * c) * (o_orderkey - mz)", 1)} AS value
        FROM orders JOIN s ON k = o_orderstatus""",
)
def regress_out_many(spark, sf):
    orders = table(spark, sf, "orders")
    out = matrix.regress_out_many(orders, ["o_orderstatus"], ["o_custkey", "o_orderkey"], "o_totalprice")
    return out.select("o_orderkey", fixed(F.col("o_totalprice"), 1).alias("value"))


@query(
    "heatmap_frame",
    f"""WITH v AS (SELECT vec_id AS cell, label::VARCHAR AS category, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
        e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM v)
        SELECT cell, category, {fixed_sql("(a - la) / (ha - la)", 6)} AS f0, {fixed_sql("(b - lb) / (hb - lb)", 6)} AS f1 FROM v, e""",
)
def heatmap_frame(spark, sf):
    long = vectors(spark, sf)
    obs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").cast("string").alias("label"))
    out = frames.heatmap_frame(obs, long, [0, 1], ["label"], scale="var")
    return out.select("cell", "category", *(fixed(F.col(f"`{i}`"), 6).alias(f"f{i}") for i in (0, 1)))


@query(
    "category_means",
    f"""SELECT label::VARCHAR AS category, count(*)::BIGINT AS n, {fixed_sql("avg(embedding[1]::DOUBLE)", 6)} AS f0 FROM embeddings GROUP BY 1""",
)
def category_means(spark, sf):
    obs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").cast("string").alias("label"))
    frame = frames.heatmap_frame(obs, vectors(spark, sf), [0], ["label"])
    return frames.category_means(frame, ["0"]).select("category", "n", fixed(F.col("`0`"), 6).alias("f0"))


@query(
    "reorder_categories",
    "SELECT c_custkey, c_mktsegment, (CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END)::INTEGER AS position FROM customer",
)
def reorder_categories(spark, sf):
    order = ["MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"]
    return frames.reorder(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", order)


@query("cluster_names", "SELECT vec_id, 'Cluster ' || dense_rank() OVER (ORDER BY label) AS label FROM embeddings")
def cluster_names(spark, sf):
    return frames.cluster_names(table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label")), "label")


@query("without_labels", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('N/A', 'dontknow', 'no_gate', '?', 'BUILDING')")
def without_labels(spark, sf):
    return frames.without_labels(table(spark, sf, "customer"), "c_mktsegment", (*frames.NO_LABEL, "BUILDING")).select("c_custkey")


@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(spark, sf):
    return frames.drop_columns(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"])


@query("distinct_colors", "SELECT DISTINCT p_brand AS name, p_type AS color FROM part WHERE p_brand IS NOT NULL")
def distinct_colors(spark, sf):
    return frames.distinct_colors(table(spark, sf, "part"), "p_brand", "p_type").select(F.col("p_brand").alias("name"), F.col("p_type").alias("color"))


@query("array_positions", "SELECT doc_id, list_filter(generate_series(0, len(w) - 1), lambda i: w[i + 1] = 'the')::INTEGER[] AS at FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)")
def array_positions(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", frames.positions(F.split("text", " "), "the").alias("at"))


@query(
    "stack_columns",
    """SELECT s_suppkey, 'a' AS "group", s_acctbal AS scores, s_nationkey AS pvals FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal * 2, NULL FROM supplier""",
)
def stack_columns(spark, sf):
    s = table(spark, sf, "supplier")
    wide = s.select("s_suppkey", F.col("s_acctbal").alias("scores|a"), F.col("s_nationkey").alias("pvals|a"), (F.col("s_acctbal") * 2).alias("scores|b"))
    return frames.stack(wide, ["s_suppkey"], ["scores", "pvals"], ["a", "b"])


@query(
    "split_batches",
    """WITH w AS (SELECT l_returnflag AS batch, l_linenumber AS line, max(l_quantity) FILTER (l_linestatus = 'O') AS c1, max(l_extendedprice) FILTER (l_linestatus = 'F') AS c2 FROM lineitem GROUP BY ALL)
       SELECT batch, line, 'Cell00001' AS cell, c1 AS value FROM w WHERE c1 IS NOT NULL UNION ALL SELECT batch, line, 'Cell00002', c2 FROM w WHERE c2 IS NOT NULL""",
)
def split_batches(spark, sf):
    li = table(spark, sf, "lineitem")
    status = F.col("l_linestatus")
    wide = li.groupBy(F.col("l_returnflag").alias("batch"), F.col("l_linenumber").alias("line")).agg(
        F.max(F.when(status == "O", F.col("l_quantity"))).alias("Cell00001"), F.max(F.when(status == "F", F.col("l_extendedprice"))).alias("Cell00002")
    )
    parts = workflows.split_batches(wide, 1)
    return parts["matrix"].join(parts["meta"], ["batch", "feature"]).select("batch", "line", "cell", "value")


@query("clustermap_order")
def clustermap_order(spark, sf):
    """Leaf orders of the groups and the features of the groups' means; tested against brute force."""
    v = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    found = ml.clustermap(v, "label")
    rows = [("group", i, int(c)) for i, c in enumerate(found["rows"])] + [("feature", i, int(c)) for i, c in enumerate(found["columns"])]
    return spark.createDataFrame(rows, "axis string, position int, item int")


@query("percentile_rank_all", "SELECT event_id, ((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE) / count(*) OVER ())::DOUBLE AS pct_rank FROM events")
def percentile_rank_all(spark, sf):
    return matrix.percentile_rank(table(spark, sf, "events"), "value").select("event_id", F.col("pct_rank").cast("double").alias("pct_rank"))
