"""Series derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNELS = ("click", "error", "purchase", "signup", "view")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value by event type from the first hour with an event to the last (ts, channel, x, label, pos); x is NULL where nothing happened.

    The label is 1 for three hours from an hour on whose largest value lies in the top two per cent of its channel.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cell = events.groupBy(F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("channel")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / (F.count("value") * F.lit(100.0))).alias("x"), F.max("value").alias("mx")
    )
    bounds = cell.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = F.sequence(F.col("a"), F.col("b"), F.expr("interval 1 hour"))
    grid = cell.select("channel").distinct().join(F.broadcast(bounds)).select("channel", F.posexplode(hours).alias("pos", "ts"))
    top = cell.groupBy("channel").agg(F.percentile("mx", F.lit(0.98)).alias("q"))
    recent = W.partitionBy("channel").orderBy("ts").rowsBetween(-2, 0)
    full = grid.join(cell, ["ts", "channel"], "left").withColumn("recent", F.max("mx").over(recent)).join(F.broadcast(top), "channel")
    return full.select("ts", "channel", "x", F.when(F.col("recent") > F.col("q"), 1).otherwise(0).alias("label"), "pos")


def hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series as a wide table: ts and one column for each event type."""
    return hourly_events(spark, sf_dir).groupBy("ts").pivot("channel", list(CHANNELS)).agg(F.first("x"))


#: Rows of a panel that one task takes: chains of windows sort them many times over, and what Spark's own joining of small partitions goes by is their compressed size.
TASK_ROWS = 200_000


def supplier_weeks(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Weekly revenue of each supplier in units of 100,000 (item_id, ts, pos, x); x is NULL in weeks without a line.

    Suppliers are dealt over as many partitions as keep each near ``task_rows`` rows, so a task's memory doesn't grow with the tables.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    week = F.date_trunc("WEEK", F.col("l_shipdate").cast("timestamp"))
    cell = lines.groupBy(F.col("l_suppkey").alias("item_id"), week.alias("ts")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(1e7)).alias("x"))
    ends = lines.agg(F.min(week).alias("a"), F.max(week).alias("b"), F.approx_count_distinct("l_suppkey").alias("items"))
    found = ends.select("items", F.size(F.sequence("a", "b", F.expr("interval 7 days"))).alias("weeks")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-found.items * max(found.weeks or 0, 1) // task_rows))
    bounds = ends.select("a", "b")
    weeks = F.sequence(F.col("a"), F.col("b"), F.expr("interval 7 days"))
    grid = cell.select("item_id").distinct().join(F.broadcast(bounds)).select("item_id", F.posexplode(weeks).alias("pos", "ts"))
    return grid.join(cell, ["item_id", "ts"], "left").select("item_id", "ts", "pos", "x").repartition(parts, "item_id")


#: The same series in DuckDB SQL, as common table expressions.
HOURLY_SQL = """
cell AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type AS channel,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(value) * CAST(100 AS DOUBLE)) AS x, max(value) AS mx FROM events GROUP BY 1, 2),
hb AS (SELECT min(ts) AS a, max(ts) AS b FROM cell),
hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM hb),
grid AS (SELECT ts, channel FROM hours CROSS JOIN (SELECT DISTINCT channel FROM cell)),
thr AS (SELECT channel, quantile_cont(mx, 0.98) AS q FROM cell GROUP BY 1),
hf AS (SELECT g.ts, g.channel, c.x, c.mx, CAST(date_diff('hour', (SELECT a FROM hb), g.ts) AS INTEGER) AS pos FROM grid g LEFT JOIN cell c ON g.ts = c.ts AND g.channel = c.channel),
h AS (SELECT ts, f.channel, x, pos, CASE WHEN max(mx) OVER (PARTITION BY f.channel ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > q THEN 1 ELSE 0 END AS label FROM hf f JOIN thr t ON f.channel = t.channel)"""
WEEKLY_SQL = """
wcell AS (SELECT l_suppkey AS item_id, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e7 AS x FROM lineitem GROUP BY 1, 2),
wb AS (SELECT min(ts) AS a, max(ts) AS b FROM wcell),
wgrid AS (SELECT item_id, ts FROM (SELECT DISTINCT item_id FROM wcell) CROSS JOIN (SELECT unnest(generate_series(a, b, INTERVAL 7 DAY)) AS ts FROM wb)),
w AS (SELECT g.item_id, g.ts, CAST(date_diff('day', (SELECT a FROM wb), g.ts) // 7 AS INTEGER) AS pos, c.x FROM wgrid g LEFT JOIN wcell c ON g.item_id = c.item_id AND g.ts = c.ts)"""
