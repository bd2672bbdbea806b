"""Queries on the cell by feature matrix, batches, pseudotime and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import batch, matrix, ml, pseudotime
from .catalogue import query
from .roles import GAPPED_SQL, VECTORS_SQL, fixed, fixed_sql, gapped, table, vectors


# aggregation

_G = f"WITH {GAPPED_SQL}"
#: Whole values, so sums are exact in any order.
_AGGS = {
    "count_nonzero": "(count(*) FILTER (value IS NULL OR value <> 0))::BIGINT",
    "sum": "coalesce(sum(value), 0.0::DOUBLE)",
    "mean": "coalesce(sum(value), 0.0::DOUBLE) / count(*)",
    "median": "median(value)",
}
for _name, _sql in _AGGS.items():

    def _run(spark, sf, name=_name):
        return matrix.aggregate(gapped(spark, sf), ["label"], name).select("label", "feature", name)

    query(f"aggregate_{_name}", f"{_G} SELECT label, feature, {_sql} AS {_name} FROM g GROUP BY label, feature")(_run)


@query(
    "aggregate_var",
    f"""{_G}, s AS (SELECT label, feature, count(*) AS n, coalesce(sum(value), 0) / count(*) AS a, coalesce(sum(value * value), 0) / count(*) AS b FROM g GROUP BY ALL)
        SELECT label, feature, {fixed_sql("(b - a * a) * n / (n - 1)", 3)} AS var FROM s""",
)
def aggregate_var(spark, sf):
    return matrix.aggregate(gapped(spark, sf), ["label"], "var").select("label", "feature", fixed(F.col("var"), 3).alias("var"))


@query("aggregate_masked_mean", f"{_G} SELECT label, feature, coalesce(sum(value) FILTER (cell % 3 = 0), 0.0::DOUBLE) / count(*) AS mean FROM g GROUP BY ALL")
def aggregate_masked_mean(spark, sf):
    return matrix.aggregate(gapped(spark, sf), ["label"], "mean", mask=F.col("cell") % 3 == 0).select("label", "feature", "mean")


@query("aggregate_two_keys", f"{_G} SELECT concat_ws('_', label, cell % 2) AS \"group\", feature, coalesce(sum(value), 0.0::DOUBLE) AS sum FROM g GROUP BY ALL")
def aggregate_two_keys(spark, sf):
    return matrix.aggregate(gapped(spark, sf).withColumn("half", F.col("cell") % 2), ["label", "half"], ["sum"]).select("group", "feature", "sum")


# quality control


@query("qc_cell_metrics", f"{_G} SELECT cell, (count(*) FILTER (value > 0))::BIGINT AS n_metabolites, coalesce(sum(value), 0.0::DOUBLE) AS total_intensity FROM g GROUP BY cell")
def qc_cell_metrics(spark, sf):
    return matrix.cell_metrics(gapped(spark, sf))


@query(
    "qc_feature_metrics",
    f"""{_G} SELECT feature, (count(*) FILTER (value > 0))::BIGINT AS hits, {fixed_sql("(count(*) FILTER (value > 0))::DOUBLE / count(value) * 100")} AS hit_rate,
        {fixed_sql("coalesce(avg(value) FILTER (value > 0), 0)")} AS mean_intensity FROM g GROUP BY feature""",
)
def qc_feature_metrics(spark, sf):
    m = matrix.feature_metrics(gapped(spark, sf), only_detected=True)
    return m.select("feature", "hits", fixed(F.col("hit_rate")).alias("hit_rate"), fixed(F.col("mean_intensity")).alias("mean_intensity"))


@query("filter_cells", f"{_G} SELECT cell, (count(*) FILTER (value > 0))::BIGINT AS n_metabolites, coalesce(sum(value), 0.0::DOUBLE) AS total_intensity FROM g GROUP BY cell HAVING count(*) FILTER (value > 0) BETWEEN 25 AND 40 AND sum(value) >= 0 AND count(*) = count(value)")
def filter_cells(spark, sf):
    return matrix.filter_cells(gapped(spark, sf), min_metabolites=25, max_metabolites=40, min_total_intensity=0)


@query("filter_cells_time", f"{_G} SELECT cell, (count(*) FILTER (value > 0))::BIGINT AS n_metabolites, coalesce(sum(value), 0.0::DOUBLE) AS total_intensity FROM g WHERE NOT (cell BETWEEN 10 AND 20 OR cell >= 300) GROUP BY cell")
def filter_cells_time(spark, sf):
    obs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.col("vec_id").cast("double").alias("scan_start_time"))
    return matrix.filter_cells(gapped(spark, sf), obs, time_windows=[(10, 20), (300, None)], excluded_time_windows=True)


@query(
    "filter_features",
    f"""{_G}, s AS (SELECT feature, count(*) FILTER (value > 0) AS n, coalesce(avg(value) FILTER (value > 0), 0) AS a, count(*) AS c FROM g GROUP BY feature)
        SELECT feature, n::BIGINT AS n_cells, {fixed_sql("a")} AS mean_intensity, {fixed_sql("n::DOUBLE / c * 100")} AS hit_rate FROM s WHERE n >= 50 AND a >= 60 AND n::DOUBLE / c * 100 BETWEEN 20 AND 60""",
)
def filter_features(spark, sf):
    out = matrix.filter_features(gapped(spark, sf), min_cells=50, min_intensity=60, extra={"hit_rate": (20, 60)})
    return out.select("feature", "n_cells", fixed(F.col("mean_intensity")).alias("mean_intensity"), fixed(F.col("hit_rate")).alias("hit_rate"))


@query("sample_rows", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def sample_rows(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return matrix.sample(table(spark, sf, "customer"), "c_custkey", ids, exclude=True).select("c_custkey", "c_nationkey")


# imputation, normalisation, scaling

for _method, _sql in (("zero", "coalesce(value, 0.0::DOUBLE)"), ("half_min", "coalesce(value, min(value) OVER (PARTITION BY feature) / 2)"), ("min_fraction", "coalesce(value, min(value) OVER (PARTITION BY feature) * 0.25::DOUBLE, 0.0::DOUBLE)")):

    def _fill(spark, sf, method=_method):
        return matrix.fill_missing(gapped(spark, sf), method, 0.25).select("cell", "feature", "value")

    query(f"impute_{_method}", f"{_G} SELECT cell, feature, {_sql} AS value FROM g")(_fill)


@query(
    "densify",
    f"{_G}, d AS (SELECT * FROM g WHERE value > 150) SELECT c.cell, f.feature, d.value FROM (SELECT DISTINCT cell FROM d) c CROSS JOIN (SELECT DISTINCT feature FROM d) f LEFT JOIN d ON d.cell = c.cell AND d.feature = f.feature",
)
def densify(spark, sf):
    return matrix.densify(gapped(spark, sf).where("value > 150")).select("cell", "feature", "value")


@query(
    "normalize_total",
    f"{_G}, t AS (SELECT cell, coalesce(sum(value), 0.0::DOUBLE) AS total FROM g GROUP BY cell) SELECT cell, feature, {fixed_sql('value * 10000.0::DOUBLE / greatest(total, 2.220446049250313e-16::DOUBLE)', 3)} AS value FROM g JOIN t USING (cell) WHERE total > 1",
)
def normalize_total(spark, sf):
    long = gapped(spark, sf)
    out = matrix.normalise(long, matrix.cell_metrics(long).where("total_intensity > 1"), "total_intensity")
    return out.select("cell", "feature", fixed(F.col("value"), 3).alias("value"))


@query("log1p_base", f"{_G} SELECT cell, feature, {fixed_sql('ln(1 + abs(value)) / ln(2.0::DOUBLE)', 6)} AS value FROM g")
def log1p_base(spark, sf):
    return gapped(spark, sf).select("cell", "feature", fixed(scalars.log1p(F.abs("value"), 2), 6).alias("value"))


@query(
    "zscore_feature",
    f"{_G} SELECT cell, feature, {fixed_sql('coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), CASE WHEN value IS NULL THEN NULL ELSE 0 END)', 6)} AS value FROM g WINDOW w AS (PARTITION BY feature)",
)
def zscore_feature(spark, sf):
    return matrix.z_score(gapped(spark, sf), ["feature"]).select("cell", "feature", fixed(F.col("value"), 6).alias("value"))


for _by in ("cell", "feature"):

    def _scale(spark, sf, by=_by):
        return matrix.standard_scale(gapped(spark, sf), by).select("cell", "feature", "value")

    query(f"standard_scale_{_by}", f"{_G} SELECT cell, feature, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.0::DOUBLE) AS value FROM g WINDOW w AS (PARTITION BY {_by})")(_scale)


@query("regress_out_categorical", f"{_G} SELECT cell, feature, {fixed_sql('value - avg(value) OVER (PARTITION BY feature, label)', 6)} AS value FROM g")
def regress_out_categorical(spark, sf):
    return matrix.regress_out_category(gapped(spark, sf), ["feature"], "label").select("cell", "feature", fixed(F.col("value"), 6).alias("value"))


@query(
    "regress_out_numeric",
    f"""SELECT o_orderkey, {fixed_sql("o_totalprice - avg(o_totalprice) OVER w - covar_pop(o_totalprice, o_custkey) OVER w / var_pop(o_custkey) OVER w * (o_custkey - avg(o_custkey) OVER w)", 3)} AS value FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""",
)
def regress_out_numeric(spark, sf):
    out = matrix.regress_out(table(spark, sf, "orders"), ["o_orderstatus"], "o_custkey", "o_totalprice")
    return out.select("o_orderkey", fixed(F.col("o_totalprice"), 3).alias("value"))


@query("tic_division", "SELECT event_id, value / CASE WHEN floor(value / 10) = 0 THEN 1e-10::DOUBLE ELSE floor(value / 10) END AS value FROM events")
def tic_division(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.per_total(F.col("value"), F.floor(F.col("value") / 10).cast("double")).alias("value"))


# ranks, groups


@query("percentile_rank", "SELECT event_id, ((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY event_type))::DOUBLE AS pct_rank FROM events")
def percentile_rank(spark, sf):
    return matrix.percentile_rank(table(spark, sf, "events"), "value", ["event_type"]).select("event_id", F.col("pct_rank").cast("double").alias("pct_rank"))


@query(
    "numeric_cut_groups",
    """WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
       SELECT p_partkey, least(greatest(ceil((p_retailprice - lo) / ((hi - lo) / 7))::BIGINT - 1, 0), 6)::BIGINT AS bin FROM part, b""",
)
def numeric_cut_groups(spark, sf):
    return matrix.cut(table(spark, sf, "part"), "p_retailprice", 7).select("p_partkey", "bin")


@query(
    "histogram_bins",
    """WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
       SELECT event_type, least(greatest(ceil((value - lo) / ((hi - lo) / 50))::BIGINT - 1, 0), 49)::BIGINT AS bin, count(*)::BIGINT AS n FROM events JOIN b USING (event_type) GROUP BY ALL""",
)
def histogram_bins(spark, sf):
    return matrix.cut(table(spark, sf, "events"), "value", 50, ["event_type"]).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query(
    "rank_top_bottom",
    """SELECT p_partkey, p_size, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r, row_number() OVER (ORDER BY p_size, p_partkey) AS u FROM part) WHERE r <= 15 OR u <= 16""",
)
def rank_top_bottom(spark, sf):
    return matrix.rank_ends(table(spark, sf, "part"), "p_size", 31, tie=["p_partkey"]).select("p_partkey", "p_size", "rank")


@query("topn_intensity", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 800")
def topn_intensity(spark, sf):
    return table(spark, sf, "events").orderBy(F.col("value").desc(), "event_id").limit(800).select("event_id", "value")


@query(
    "centroid_l1",
    f"""WITH {VECTORS_SQL}, p AS (SELECT cell, label, max(value) FILTER (feature = 0) AS x, max(value) FILTER (feature = 1) AS y FROM m GROUP BY ALL), mid AS (SELECT label, median(x) AS mx, median(y) AS my FROM p GROUP BY label)
        SELECT label, cell, x, y FROM (SELECT p.*, row_number() OVER (PARTITION BY label ORDER BY abs(x - mx) + abs(y - my), cell) AS r FROM p JOIN mid USING (label)) WHERE r = 1""",
)
def centroid_l1(spark, sf):
    e = table(spark, sf, "embeddings")
    points = e.select(F.col("vec_id").alias("cell"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return matrix.centroid(points, ["label"], ["x", "y"], "cell")


@query("group_sizes", "SELECT label, count(*)::BIGINT AS n, (sum(count(*)) OVER (ORDER BY label))::BIGINT AS stop, (sum(count(*)) OVER (ORDER BY label) - count(*))::BIGINT AS start FROM embeddings GROUP BY label")
def group_sizes(spark, sf):
    return matrix.group_sizes(table(spark, sf, "embeddings"), "label")


@query("composition_share", "SELECT user_id, (count(*) FILTER (event_type = 'click'))::BIGINT AS n_click, (count(*) FILTER (event_type = 'view'))::BIGINT AS n_view, count(*)::BIGINT AS n, (count(*) FILTER (event_type = 'click'))::DOUBLE / count(*) AS share_click, (count(*) FILTER (event_type = 'view'))::DOUBLE / count(*) AS share_view FROM events GROUP BY user_id")
def composition_share(spark, sf):
    return matrix.composition(table(spark, sf, "events"), "user_id", "event_type", ["click", "view"])


@query("composition_pivot", 'SELECT user_id, (count(*) FILTER (event_type = \'click\'))::BIGINT AS click, (count(*) FILTER (event_type = \'error\'))::BIGINT AS error FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN (\'click\', \'error\')) > 0 OR TRUE')
def composition_pivot(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error"]).count().na.fill(0)


# set operations and shapes

_N = ("SELECT c_nationkey::INTEGER AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey::INTEGER AS k FROM supplier WHERE s_acctbal > 5000")


def _nations(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@query("set_union_all", f"{_N[0]} UNION ALL {_N[1]}")
def set_union_all(spark, sf):
    a, b = _nations(spark, sf)
    return a.unionByName(b)


@query("set_union", f"{_N[0]} UNION {_N[1]}")
def set_union(spark, sf):
    a, b = _nations(spark, sf)
    return a.union(b).distinct()


@query("set_intersect", f"{_N[0]} INTERSECT {_N[1]}")
def set_intersect(spark, sf):
    a, b = _nations(spark, sf)
    return a.intersect(b)


@query("set_except", f"{_N[0]} EXCEPT {_N[1]}")
def set_except(spark, sf):
    a, b = _nations(spark, sf)
    return a.subtract(b)


@query("melt", "SELECT p_partkey, unnest(['p_size', 'price_cents']) AS feature, unnest([p_size::BIGINT, round(p_retailprice * 100)::BIGINT]) AS value FROM part")
def melt(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"))
    return matrix.melt(parts, ["p_partkey"], ["p_size", "price_cents"])


@query("obs_df", f'{_G} SELECT cell, label, max(value) FILTER (feature = 3) AS "3", max(value) FILTER (feature = 7) AS "7" FROM g GROUP BY cell, label')
def obs_df(spark, sf):
    obs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), "label")
    return matrix.observation_frame(obs, gapped(spark, sf), [3, 7], ["label"])


@query("var_df", f'{_G} SELECT feature, max(value) FILTER (cell = 0) AS "0", max(value) FILTER (cell = 1) AS "1" FROM g GROUP BY feature')
def var_df(spark, sf):
    return gapped(spark, sf).where("cell in (0, 1)").groupBy("feature").pivot("cell", [0, 1]).agg(F.max("value"))


@query("de_table_filter", "SELECT o_orderkey AS names, o_orderstatus AS \"group\", o_totalprice AS logfoldchanges, (o_custkey % 100) / 100.0::DOUBLE AS pvals_adj, c_mktsegment AS symbol FROM orders LEFT JOIN customer ON c_custkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND (o_custkey % 100) / 100.0::DOUBLE < 0.05 AND o_totalprice > 100000 AND o_totalprice < 200000")
def de_table_filter(spark, sf):
    results = table(spark, sf, "orders").select(F.col("o_orderkey").alias("names"), F.col("o_orderstatus").alias("group"), F.col("o_totalprice").alias("logfoldchanges"), ((F.col("o_custkey") % 100) / F.lit(100.0)).alias("pvals_adj"))
    symbols = table(spark, sf, "customer").select(F.col("c_custkey").alias("names"), F.col("c_mktsegment").alias("symbol"))
    return matrix.ranked_results(results, groups=["F", "O"], pval_cutoff=0.05, log2fc_min=100000, log2fc_max=200000, symbols=symbols)


@query("drop_labels", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')")
def drop_labels(spark, sf):
    return matrix.drop_labels(table(spark, sf, "events"), "event_type", ("error", "signup")).select("event_id", "event_type")


@query("relabel", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Cluster 1' WHEN 'view' THEN 'Cluster 2' END AS event_type FROM events WHERE event_type IN ('click', 'view')")
def relabel(spark, sf):
    return matrix.relabel(table(spark, sf, "events"), "event_type", {"click": "Cluster 1", "view": "Cluster 2", "error": "Cluster 3"}, exclude=["Cluster 3"]).select("event_id", "event_type")


@query(
    "feature_names",
    """WITH r AS (SELECT p_partkey AS feature, CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(trim(p_name), '\\s+', '_', 'g') ELSE 'mz_' || printf('%.3f', p_retailprice) END AS raw FROM part),
       n AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY feature) AS k FROM r)
       SELECT feature, CASE WHEN k = 1 THEN raw ELSE raw || '-' || (k - 1)::VARCHAR END AS name FROM n""",
)
def feature_names(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("mz_center"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  ").alias("metabolite"))
    return scalars.feature_names(parts).select("feature", "name")


@query("cell_numbers", "SELECT o_orderkey, printf('Cell%05d', row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)) AS cell, o_orderstatus || '_Cell' || (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey))::VARCHAR AS batch_cell FROM orders")
def cell_numbers(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey"))
    cells = table(spark, sf, "orders").withColumn("cell", scalars.cell_number(n))
    return cells.select("o_orderkey", "cell", scalars.batch_cell(F.col("o_orderstatus"), F.col("cell")).alias("batch_cell"))


# batches

_BATCH_SQL = """f AS (SELECT l_returnflag AS batch, l_partkey AS feature, min(l_extendedprice) AS mz, count(DISTINCT l_suppkey)::BIGINT AS n_cells, CASE WHEN l_partkey % 2 = 0 THEN 'P' || (l_partkey % 50)::VARCHAR ELSE '' END AS metabolite FROM lineitem GROUP BY ALL),
    fl AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 < 10 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (ORDER BY mz, batch, feature)),
    al AS (SELECT *, (sum(new) OVER (ORDER BY mz, batch, feature))::BIGINT AS island FROM fl)"""


def _aligned(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.groupBy(F.col("l_returnflag").alias("batch"), F.col("l_partkey").alias("feature")).agg(F.min("l_extendedprice").alias("mz"), F.countDistinct("l_suppkey").alias("n_cells"))
    return batch.align(f.withColumn("metabolite", F.when(F.col("feature") % 2 == 0, F.concat(F.lit("P"), (F.col("feature") % 50).cast("string"))).otherwise("")))


@query("batch_feature_align", f"WITH {_BATCH_SQL} SELECT batch, feature, mz, island FROM al")
def batch_feature_align(spark, sf):
    return _aligned(spark, sf).select("batch", "feature", "mz", "island")


@query(
    "batch_merge",
    f"""WITH {_BATCH_SQL}, fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY island, batch ORDER BY mz, feature) AS r FROM al) WHERE r = 1),
        b AS (SELECT island, max(n_cells) FILTER (batch = 'A') AS a, max(n_cells) FILTER (batch = 'N') AS n, max(n_cells) FILTER (batch = 'R') AS r, count(*)::BIGINT AS c FROM fi GROUP BY island),
        e AS (SELECT island, avg(mz) AS mz_mean, coalesce(string_agg(DISTINCT metabolite, '/' ORDER BY metabolite) FILTER (metabolite <> ''), '') AS metabolite FROM al GROUP BY island)
        SELECT island, {fixed_sql("mz_mean", 6)} AS mz_mean, metabolite, concat_ws('/', coalesce(a::VARCHAR, 'NaN'), coalesce(n::VARCHAR, 'NaN'), coalesce(r::VARCHAR, 'NaN')) AS counts,
          {fixed_sql("(coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0))::DOUBLE / 300 * 100")} AS total_cell_ratio, c AS batch_count FROM e JOIN b USING (island)""",
)
def batch_merge(spark, sf):
    out = batch.merge(_aligned(spark, sf), ["A", "N", "R"], {"A": 100, "N": 100, "R": 100})
    return out.select("island", fixed(F.col("mz_mean"), 6).alias("mz_mean"), "metabolite", "counts", fixed(F.col("total_cell_ratio")).alias("total_cell_ratio"), "batch_count")


@query("batch_filter_cells", "SELECT l_returnflag AS batch, l_suppkey AS cell, l_extendedprice AS mz FROM lineitem WHERE (l_returnflag, l_suppkey) IN (SELECT 'A', s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def batch_filter_cells(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("batch"), F.col("l_suppkey").alias("cell"), F.col("l_extendedprice").alias("mz"))
    groups = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.lit("A").alias("batch"), F.col("s_suppkey").alias("cell"))
    return batch.kept_cells(li, groups)


@query("metadata_first_match", "SELECT c_custkey, m.d AS o_orderdate, m.p AS o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, min((o_orderdate, o_orderkey, o_orderpriority)) AS t, t[1] AS d, t[3] AS p FROM orders GROUP BY 1) m ON o_custkey = c_custkey")
def metadata_first_match(spark, sf):
    from ..operators.joins import first_match

    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return first_match(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderpriority"])


# selection by metrics there are, and the other side's metrics made again


@query(
    "select_cells",
    f"""{_G}, o AS (SELECT cell FROM g GROUP BY cell HAVING count(*) FILTER (value > 0) >= 30 AND coalesce(sum(value), 0) <= 2500)
       SELECT feature, (count(*) FILTER (value > 0))::BIGINT AS hits, {fixed_sql("(count(*) FILTER (value > 0))::DOUBLE / nullif(count(value), 0) * 100")} AS hit_rate, {fixed_sql("avg(value)")} AS mean_intensity FROM g WHERE cell IN (SELECT cell FROM o) GROUP BY feature""",
)
def select_cells(spark, sf):
    g = gapped(spark, sf)
    var = matrix.select_cells(g, matrix.cell_metrics(g), {"n_metabolites": (30, None), "total_intensity": (None, 2500)})["var"]
    return var.select("feature", "hits", fixed(F.col("hit_rate")).alias("hit_rate"), fixed(F.col("mean_intensity")).alias("mean_intensity"))


@query(
    "select_features",
    f"""{_G}, v AS (SELECT feature FROM g GROUP BY feature HAVING (count(*) FILTER (value > 0))::DOUBLE / nullif(count(value), 0) * 100 BETWEEN 55 AND 75)
       SELECT cell, (count(*) FILTER (value > 0 AND feature IN (SELECT feature FROM v)))::BIGINT AS n_metabolites, coalesce(sum(value) FILTER (feature IN (SELECT feature FROM v)), 0.0::DOUBLE) AS total_intensity FROM g GROUP BY cell""",
)
def select_features(spark, sf):
    g = gapped(spark, sf)
    return matrix.select_features(g, matrix.feature_metrics(g), {"hit_rate": (55, 75)})["obs"]


# pseudotime

_PSEUDO = """long AS (SELECT user_id AS cell, event_id / 40.0::DOUBLE AS pseudotime, event_type AS metabolite, round(value * 100)::BIGINT::DOUBLE AS value FROM events),
    binned AS (SELECT (floor(pseudotime / 50) * 50)::BIGINT AS bin, metabolite, avg(value) AS stat, avg(CASE WHEN value > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac FROM long WHERE metabolite <> 'signup' GROUP BY ALL)"""


def _pseudo(spark, sf):
    long = table(spark, sf, "events").select(F.col("user_id").alias("cell"), (F.col("event_id") / F.lit(40.0)).alias("pseudotime"), F.lit("b").alias("branch"), F.col("event_type").alias("metabolite"), F.round(F.col("value") * 100).alias("value"))
    sig = long.select("metabolite").distinct().withColumn("pval_adj", F.when(F.col("metabolite") == "signup", 0.2).otherwise(0.01))
    return pseudotime.dot_table(long, sig, "b", 50, 5000)


@query("pseudotime_dot_agg", f"WITH {_PSEUDO} SELECT bin, metabolite, {fixed_sql('stat')} AS stat, {fixed_sql('frac', 6)} AS frac, {fixed_sql('coalesce((stat - avg(stat) OVER w) / nullif(stddev_pop(stat) OVER w, 0), 0)', 6)} AS color FROM binned WINDOW w AS (PARTITION BY metabolite)")
def pseudotime_dot_agg(spark, sf):
    return _pseudo(spark, sf).select("bin", "metabolite", fixed(F.col("stat")).alias("stat"), fixed(F.col("frac"), 6).alias("frac"), fixed(F.col("color"), 6).alias("color"))


@query("slope_per_feature", f"WITH {_PSEUDO} SELECT metabolite, {fixed_sql('CASE WHEN count(*) >= 2 THEN regr_slope(stat, bin) END')} AS slope FROM binned GROUP BY metabolite")
def slope_per_feature(spark, sf):
    return pseudotime.slopes(_pseudo(spark, sf)).select("metabolite", fixed(F.col("slope")).alias("slope"))


@query(
    "order_by_direction",
    """WITH l AS (SELECT p_brand AS metabolite, (avg(p_size) - 25) AS ls, (avg(p_size % 7) - 3) AS rs, min(p_partkey) AS pval_adj FROM part GROUP BY 1),
       s AS (SELECT *, CASE WHEN rs > 0 AND rs >= ls THEN 'right' WHEN ls > 0 THEN 'left' END AS side FROM l)
       SELECT metabolite, side, (row_number() OVER (ORDER BY side, CASE WHEN side = 'left' THEN pval_adj ELSE -pval_adj END, metabolite))::INTEGER AS position FROM s WHERE side IS NOT NULL""",
)
def order_by_direction(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("metabolite")).agg((F.avg("p_size") - 25).alias("ls"), (F.avg(F.col("p_size") % 7) - 3).alias("rs"), F.min("p_partkey").cast("double").alias("pval_adj"))
    out = pseudotime.order_by_direction(g.select("metabolite", F.col("ls").alias("slope")), g.select("metabolite", F.col("rs").alias("slope")), g)
    return out.select("metabolite", "side", "position")


@query(
    "dual_branch_trend",
    f"""WITH long AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS branch, event_id / 40.0::DOUBLE AS pseudotime, event_type AS metabolite, round(value * 100)::BIGINT::DOUBLE AS value FROM events),
        binned AS (SELECT branch, (floor(pseudotime / 50) * 50)::BIGINT AS bin, metabolite, avg(value) AS stat, avg(CASE WHEN value > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac FROM long WHERE metabolite <> 'signup' GROUP BY ALL),
        grid AS (SELECT * FROM (SELECT DISTINCT branch, bin FROM binned) CROSS JOIN (SELECT metabolite, (row_number() OVER (ORDER BY metabolite DESC) - 1)::INTEGER AS x FROM (SELECT DISTINCT metabolite FROM binned))),
        t AS (SELECT * FROM grid LEFT JOIN binned USING (branch, bin, metabolite))
        SELECT branch, metabolite, x, CASE WHEN branch = 'left' THEN bin ELSE -bin END AS y, {fixed_sql('coalesce((stat - avg(stat) OVER w) / nullif(stddev_pop(stat) OVER w, 0), 0)', 6)} AS z,
               {fixed_sql('20 + 280 * coalesce(frac, 0) / max(frac) OVER ()', 6)} AS size, metabolite || ' (1.00E-02)' AS label FROM t WINDOW w AS (PARTITION BY metabolite)""",
)
def dual_branch_trend(spark, sf):
    long = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("branch"), F.col("user_id").alias("cell"), (F.col("event_id") / F.lit(40.0)).alias("pseudotime"), F.col("event_type").alias("metabolite"), F.round(F.col("value") * 100).alias("value")
    )
    sig = long.select("metabolite").distinct().withColumn("pval_adj", F.when(F.col("metabolite") == "signup", 0.2).otherwise(0.01))
    sides = [pseudotime.dot_table(long, sig, b, 50, 5000) for b in ("left", "right")]
    order = sig.select("metabolite", (-F.ascii(F.substring("metabolite", 1, 1)) * 256 - F.ascii(F.substring("metabolite", 2, 1))).alias("position"))
    out = pseudotime.dual_branch(*sides, order, sig)
    return out.withColumn("z", fixed(F.coalesce("z", F.lit(0.0)), 6)).withColumn("size", fixed(F.col("size"), 6))


# models


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), "label", F.col("embedding").cast("array<double>").alias("v"))


@query("pca_scores")
def pca_scores(spark, sf):
    return ml.pca(_vectors(spark, sf), 5)["scores"]


@query("pca_blocks")
def pca_blocks(spark, sf):
    return ml.pca_by_blocks(_vectors(spark, sf), 5)["scores"]


@query("pca_variance")
def pca_variance(spark, sf):
    out = ml.pca(_vectors(spark, sf), 5)
    return spark.createDataFrame([(i, float(v), float(r)) for i, (v, r) in enumerate(zip(out["variance"], out["variance_ratio"]))], "component int, variance double, ratio double")


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    return ml.kmeans_labels(ml.pca(_vectors(spark, sf), 5)["scores"]).select("cell", "cluster")


@query("gmm_score")
def gmm_score(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("intensity"))
    return ml.mixture_scores(e).select("id", "intensity", "p_high", "score")


@query("corr_groups", f"""WITH {VECTORS_SQL}, a AS (SELECT label, feature, avg(value) AS v FROM m GROUP BY ALL)
    SELECT x.label AS a, y.label AS b, {fixed_sql("corr(x.v, y.v)", 6)} AS r FROM a x JOIN a y USING (feature) GROUP BY ALL""")
def corr_groups(spark, sf):
    out = ml.dendrogram(_vectors(spark, sf), "label")
    c = out["categories"]
    rows = [(a, b, float(out["correlation"][i, j])) for i, a in enumerate(c) for j, b in enumerate(c)]
    return spark.createDataFrame(rows, "a int, b int, r double").withColumn("r", fixed(F.col("r"), 6))


@query("dendrogram_order")
def dendrogram_order(spark, sf):
    out = ml.dendrogram(_vectors(spark, sf), "label")
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(out["order"])], "position int, label int")


@query("dendrogram_optimal")
def dendrogram_optimal(spark, sf):
    out = ml.dendrogram(_vectors(spark, sf), "label", optimal=True)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(out["order"])], "position int, label int")


@query("neighbour_graph", f"""WITH {VECTORS_SQL}, d AS (SELECT a.cell AS src, b.cell AS dst, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS distance FROM m a JOIN m b ON a.feature = b.feature AND a.cell <> b.cell GROUP BY ALL)
    SELECT src, dst, {fixed_sql("distance", 6)} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM d) WHERE r <= 5""")
def neighbour_graph(spark, sf):
    return ml.neighbours(_vectors(spark, sf), 5, vector="v").select("src", "dst", fixed(F.col("distance"), 6).alias("distance"))
