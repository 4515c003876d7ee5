"""Catalogues derived from the order and event tables by integer and exact floating-point arithmetic, in Spark and in SQL.

`*_SQL` are common table expressions, to be joined after WITH."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calendar span that covers all order dates with whole months and whole six-year blocks.
SPAN = (-2191.0, 731.0)  # 1994-01-01 to 2002-01-01


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_idx, day, lat_deg, lon_deg, depth_km, magnitude of each order."""
    o = load(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice") / 500000.0
    return o.select(
        key.alias("event_idx"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date")).cast("double") + (key * 7919 % 86400).cast("double") / 86400.0).alias("day"),
        ((cust * 3701 % 1400).cast("double") / 10.0 - 70.0).alias("lat_deg"),
        ((cust * 7477 % 3600).cast("double") / 10.0 - 180.0).alias("lon_deg"),
        ((key * 131 % 7000).cast("double") / 10.0).alias("depth_km"),
        (4.0 + 3.5 * price * price * price).alias("magnitude"),
    )


QUAKE_SQL = """quake AS (
  SELECT o_orderkey AS event_idx,
    CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + CAST(o_orderkey * 7919 % 86400 AS DOUBLE) / 86400.0::DOUBLE AS day,
    CAST(o_custkey * 3701 % 1400 AS DOUBLE) / 10.0::DOUBLE - 70.0::DOUBLE AS lat_deg,
    CAST(o_custkey * 7477 % 3600 AS DOUBLE) / 10.0::DOUBLE - 180.0::DOUBLE AS lon_deg,
    CAST(o_orderkey * 131 % 7000 AS DOUBLE) / 10.0::DOUBLE AS depth_km,
    4.0::DOUBLE + 3.5::DOUBLE * (o_totalprice / 500000.0::DOUBLE) * (o_totalprice / 500000.0::DOUBLE) * (o_totalprice / 500000.0::DOUBLE) AS magnitude
  FROM orders)"""


def cmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quake with two nodal planes of whole degrees: planes[0], planes[1]."""
    k = F.col("event_idx")
    plane = lambda a, b, c: F.struct((k * a % 360).cast("double").alias("strike"), (k * b % 91).cast("double").alias("dip"), (k * c % 360 - 180).cast("double").alias("rake"))
    return quake(spark, sf_dir).withColumn("planes", F.array(plane(53, 37, 101), plane(59, 41, 103)))


CMT_SQL = (
    QUAKE_SQL
    + """, cmt AS (
  SELECT *, CAST(event_idx * 53 % 360 AS DOUBLE) AS strike1, CAST(event_idx * 37 % 91 AS DOUBLE) AS dip1, CAST(event_idx * 101 % 360 - 180 AS DOUBLE) AS rake1,
    CAST(event_idx * 59 % 360 AS DOUBLE) AS strike2, CAST(event_idx * 41 % 91 AS DOUBLE) AS dip2, CAST(event_idx * 103 % 360 - 180 AS DOUBLE) AS rake2
  FROM quake)"""
)


def tremor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_idx, day, family, magnitude (strength, null if not above 0), lat_deg, lon_deg of each event row."""
    e = load(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("event_idx"),
        ((micros - 946684800000000) / F.lit(86400e6)).alias("day"),
        F.concat(F.lit("F"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("family"),
        F.when(F.col("value") > 0, F.col("value").cast("double")).alias("magnitude"),
        ((F.col("user_id") * 37 % 900).cast("double") / 100.0 + 40.0).alias("lat_deg"),
        ((F.col("user_id") * 53 % 300).cast("double") / 100.0 - 124.0).alias("lon_deg"),
    )


TREMOR_SQL = """tremor AS (
  SELECT event_id AS event_idx, (epoch_us(ts) - 946684800000000)::DOUBLE / 86400e6::DOUBLE AS day,
    'F' || lpad((user_id % 12)::VARCHAR, 2, '0') AS family,
    CASE WHEN value > 0 THEN value::DOUBLE END AS magnitude,
    CAST(user_id * 37 % 900 AS DOUBLE) / 100.0::DOUBLE + 40.0::DOUBLE AS lat_deg,
    CAST(user_id * 53 % 300 AS DOUBLE) / 100.0::DOUBLE - 124.0::DOUBLE AS lon_deg
  FROM events)"""
