"""Clouds derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dimensions of the embeddings, with their label."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")], "label")


def cloud_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: hours since the first one, user, value."""
    ev = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    first = ev.agg(F.min("t")).first()[0]
    return ev.select(F.col("event_id").alias("id"), ((F.col("t") - F.lit(first)).cast("double") / 3.6e9).alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"), "user_id")


def cloud_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points without ids: quantity, price, discount."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") * 0.000503).alias("y"), (F.col("l_discount") * 500.0).alias("z"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree over the embeddings: the parent of n is (n - 1) div 2."""
    p = pts(spark, sf_dir)
    return p.select(F.col("id").alias("node"), F.when(F.col("id") == 0, F.col("id")).otherwise(F.floor((F.col("id") - 1) / 2).cast("long")).alias("parent"), "x", "y", "z")


#: The same in SQL.
PTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"
CLOUD_E = "ce AS (SELECT event_id AS id, CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, value AS z, user_id FROM events)"
CLOUD_L = "cl AS (SELECT l_quantity AS x, l_extendedprice * CAST('0.000503' AS DOUBLE) AS y, l_discount * CAST(500 AS DOUBLE) AS z FROM lineitem)"
TREE = PTS + ", tree AS (SELECT id AS node, CASE WHEN id = 0 THEN id ELSE CAST(floor((id - 1) / 2) AS BIGINT) END AS parent, x, y, z FROM pts)"
EDGES_SIGMA = PTS + ", e AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz FROM pts a JOIN pts b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.15*0.15)"
