"""Stand-ins for motion logs, made from the test tables in the same way in Spark and in SQL.

They exercise the mechanics of the operators; they say nothing about the accuracy of navigation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A track for each user: time, position and a signal.
TRACK = """track AS (
  SELECT event_id, user_id AS drive, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, ts, event_type AS sensor, value, props,
    51.5 + value / 1e4 AS lat, -0.12 + (event_id % 1000) / 1e5 AS lon
  FROM events)"""

#: Windows of a twelve-channel recorder: ``label`` is the drive, ``vec_id`` the time in tenths of a second.
RECORDER = """recorder AS (
  SELECT label AS drive, vec_id, vec_id / 1e1 AS t, list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"""

#: A road graph of even density: parts are nodes on a strip of sixteen columns, 40 m apart and a little off the lattice;
#: each order is a way that runs down a column or along a row from the part of its first line.
NODES = """nodes AS (
  SELECT p_partkey AS node, CAST(p_partkey % 16 * 40 + p_partkey * 7919 % 17 AS DOUBLE) AS e, CAST(p_partkey // 16 * 40 + p_partkey * 104729 % 13 AS DOUBLE) AS n FROM part)"""
WAYS = """ways AS (
  SELECT way, CASE WHEN first > 96 THEN first - (pos - 1) * step ELSE first + (pos - 1) * step END AS node, pos FROM (
    SELECT l_orderkey AS way, row_number() OVER w AS pos, first_value(l_partkey) OVER w AS first, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 16 END AS step
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("drive"), us.alias("us"), (us / 1e6).alias("t"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("sensor"), "value", "props", (51.5 + F.col("value") / 1e4).alias("lat"), (-0.12 + (F.col("event_id") % 1000) / 1e5).alias("lon"),
    )


def recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 12), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("drive"), "vec_id", (F.col("vec_id") / 1e1).alias("t"), x.alias("x"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    e, n = key % 16 * 40 + key * 7919 % 17, F.floor(key / 16) * 40 + key * 104729 % 13
    return table(spark, sf_dir, "part").select(key.alias("node"), e.cast("double").alias("e"), n.cast("double").alias("n"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.row_number().over(w).alias("pos"), F.first("l_partkey").over(w).alias("first"))
    along = (F.col("pos") - 1) * F.when(F.col("way") % 2 == 0, 1).otherwise(16)
    return lines.select("way", F.when(F.col("first") > 96, F.col("first") - along).otherwise(F.col("first") + along).alias("node"), "pos")
