"""The driver's tables in the roles of signal data, in Spark and in SQL.

Sums of decimals are taken on whole hundredths, and derived figures are rounded, so that both
engines give the same bits whatever order they add in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(c: Column, digits: int = 4) -> Column:
    """Rounded half up on a grid, the same way in both engines; a negative zero becomes zero."""
    return F.floor(c * float(10**digits) + 0.5).cast("double") / float(10**digits)


def fixed_sql(e: str, digits: int = 4) -> str:
    return f"((floor(({e}) * {10**digits}::DOUBLE + 0.5) + 0.0)::BIGINT::DOUBLE / {10**digits}::DOUBLE)"


def signal(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """``event_type, index, time, data``: one series per event type; every seventh event is a gap."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")) if gaps else F.col("value")
    first = F.min("ts").over(Window.partitionBy("event_type"))
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 60e6
    return e.select("event_type", (F.row_number().over(order) - 1).cast("long").alias("index"), minutes.alias("time"), value.alias("data"))


SIGNAL_SQL = """series AS (
    SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
           (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type)))::DOUBLE / 60e6::DOUBLE AS t,
           CASE WHEN event_id % 7 <> 0 THEN value END AS data
    FROM events)"""
BASE_SQL = (
    SIGNAL_SQL
    + """,
blocked AS (
    SELECT *, least(floor(idx / 100)::BIGINT, greatest(ceil(count(*) OVER (PARTITION BY event_type) / 100.0)::BIGINT - 2, 0)) AS block FROM series),
based AS (
    SELECT *, CASE WHEN data IS NOT NULL AND count(*) FILTER (data IS NULL) OVER w < 0.8 * count(*) OVER w THEN median(data) OVER w END AS baseline
    FROM blocked WINDOW w AS (PARTITION BY event_type, block)),
corrected AS (
    SELECT *, CASE WHEN baseline IS NULL OR baseline >= data THEN 0.0::DOUBLE ELSE data - baseline END AS signal FROM based)"""
)

#: Events of each type as scan positions: an event's number within all, by time.
POSITIONS_SQL = """pos AS (SELECT event_type, event_id AS idx FROM events)"""


def positions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == kind).select(F.col("event_id").alias("index"))


TIE = ("l_orderkey", "l_linenumber", "l_partkey")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mass peaks: cell = supplier, mass = extended price, intensity = quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("cell"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), *TIE)


PEAKS_SQL = "peaks AS (SELECT l_suppkey AS cell, l_extendedprice AS mz, l_quantity AS intensity, l_orderkey, l_linenumber, l_partkey FROM lineitem)"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price library: all distinct prices."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_extendedprice").alias("lib_mz")).agg(F.min("l_partkey").alias("lib_pos")).select("lib_mz", "lib_pos", F.concat(F.lit("P"), F.col("lib_pos").cast("string")).alias("metabolite"))


LIBRARY_SQL = "lib AS (SELECT l_extendedprice AS lib_mz, min(l_partkey) AS lib_pos, 'P' || min(l_partkey)::VARCHAR AS metabolite FROM lineitem GROUP BY 1)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense long matrix: cell, label, feature, value (negative values are not detected in every fifth cell)."""
    from ..operators.matrix import from_vectors

    return from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


VECTORS_SQL = """m AS (
    SELECT vec_id AS cell, label, (unnest(generate_series(1, len(embedding))) - 1)::INTEGER AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole thousandths as values, and nulls where a value is below -100."""
    whole = F.floor(F.col("value") * 1000)
    return vectors(spark, sf_dir).withColumn("value", F.when(whole >= -100, whole.cast("double")))


GAPPED_SQL = VECTORS_SQL + """,
g AS (SELECT cell, label, feature, CASE WHEN floor(value * 1000) >= -100 THEN floor(value * 1000)::BIGINT::DOUBLE END AS value FROM m)"""
