"""The bundled tables in the roles that the operators expect, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Legs from here on are not known when rates are fitted.
CUTOFF = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of vehicles from events: tail, carrier, service_date, dep_ts, origin, dest, elapsed_min, distance; order dep_ts, event_id."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 53 != 0, F.col("user_id")).alias("tail"),
        F.col("event_type").alias("carrier"),
        F.col("ts").cast("date").alias("service_date"),
        F.col("ts").alias("dep_ts"),
        (F.col("event_id") % 3).alias("origin"),
        F.expr("(event_id div 3) % 3").alias("dest"),
        F.when(F.col("event_id") % 97 != 0, 30 + (F.col("event_id") % 8) * 30).alias("elapsed_min"),
        (100 + F.col("event_id") % 900).alias("distance"),
    )


LEGS_EVENTS = """legs AS (
  SELECT event_id, CASE WHEN event_id % 53 <> 0 THEN user_id END AS tail, event_type AS carrier,
         CAST(ts AS DATE) AS service_date, ts AS dep_ts, event_id % 3 AS origin, (event_id // 3) % 3 AS dest,
         CASE WHEN event_id % 97 <> 0 THEN 30 + (event_id % 8) * 30 END AS elapsed_min, 100 + event_id % 900 AS distance
  FROM events)"""


def legs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flown legs from lineitem with outcomes, and a made-up probability p of being late."""
    base = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("flight_number"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("date").alias("service_date"),
        (F.col("l_suppkey") % 7).alias("carrier"),
        (F.col("l_partkey") % 25).alias("origin"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 25).alias("dest"),
        F.expr("((l_partkey * 7 + l_linenumber * 131) % 1440) div 60").alias("dep_hour"),
        F.round(F.col("l_discount") * 1000 - 40, 6).alias("delay"),
        F.round(F.col("l_tax") * 1000 - 30, 6).alias("dep"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 4)).alias("cancelled"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7)).alias("diverted"),
        F.expr("((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1000) / 1000.0D").alias("p"),
    )
    flown = ~F.col("cancelled") & ~F.col("diverted")
    return base.select(
        "flight_number", "line", "service_date", "carrier", "origin", "dest", "dep_hour", "cancelled", "diverted", "p",
        F.when(flown, F.col("delay")).alias("arr_delay"),
        F.when(~F.col("cancelled"), F.col("dep")).alias("dep_delay"),
        F.when(flown, F.col("delay") >= 15).alias("del15"),
    )


LEGS_LINEITEM = """base AS (
  SELECT l_orderkey AS flight_number, l_linenumber AS line, CAST(l_shipdate AS DATE) AS service_date,
         l_suppkey % 7 AS carrier, l_partkey % 25 AS origin, (l_partkey + l_linenumber) % 25 AS dest,
         ((l_partkey * 7 + l_linenumber * 131) % 1440) // 60 AS dep_hour,
         round(l_discount * 1000 - 40, 6) AS delay, round(l_tax * 1000 - 30, 6) AS dep,
         l_returnflag = 'R' AND l_linenumber = 4 AS cancelled, l_returnflag = 'A' AND l_linenumber = 7 AS diverted,
         ((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1000) / 1000.0::DOUBLE AS p
  FROM lineitem),
flown AS (
  SELECT flight_number, line, service_date, carrier, origin, dest, dep_hour, cancelled, diverted, p,
         CASE WHEN NOT cancelled AND NOT diverted THEN delay END AS arr_delay,
         CASE WHEN NOT cancelled THEN dep END AS dep_delay,
         CASE WHEN NOT cancelled AND NOT diverted THEN delay >= 15 END AS del15
  FROM base)"""
