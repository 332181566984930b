"""Rotation chains over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import chain
from lathe.plans.adapters import LEGS_EVENTS, legs_events
from lathe.plans.base import query

CHAIN_SQL = f"""{LEGS_EVENTS},
dense AS (SELECT *, count(*) OVER (PARTITION BY origin, service_date, hour(dep_ts)) AS density FROM legs),
linked AS (
  SELECT *, lag(dep_ts + elapsed_min * INTERVAL 1 MINUTE) OVER w AS arr, lag(dest) OVER w AS pdest, lag(distance) OVER w AS pdist, lag(elapsed_min) OVER w AS pel,
         row_number() OVER (PARTITION BY tail, service_date ORDER BY dep_ts, event_id) AS pos, count(*) OVER (PARTITION BY tail, service_date) AS n
  FROM dense WHERE tail IS NOT NULL WINDOW w AS (PARTITION BY tail ORDER BY dep_ts, event_id)),
gaps AS (SELECT *, date_sub('minute', arr, dep_ts) AS gap FROM linked),
tainted AS (SELECT *, coalesce(lag(gap < 0) OVER (PARTITION BY tail ORDER BY dep_ts, event_id), false) AS taint FROM gaps),
classed AS (
  SELECT *, CASE WHEN pdest IS NULL THEN 'b' WHEN pdest = origin AND NOT taint AND gap BETWEEN 0 AND 840 THEN 'a'
                 WHEN pdest = origin AND NOT taint AND gap > 840 THEN 'b' ELSE 'c' END AS link_class FROM tainted),
chain AS (
  SELECT event_id, tail, carrier, service_date, dep_ts, origin, dest, elapsed_min, distance, density, link_class,
    CASE WHEN link_class <> 'c' THEN pos END AS rotation_position, CASE WHEN link_class <> 'c' THEN n END AS legs_today,
    CASE WHEN link_class <> 'c' THEN link_class = 'a' END AS has_inbound_leg, CASE WHEN link_class = 'a' THEN gap END AS turnaround_min,
    CASE WHEN link_class = 'a' THEN gap - 35 END AS slack_min, CASE WHEN link_class <> 'c' THEN link_class = 'a' AND gap < 35 END AS is_tight,
    CASE WHEN link_class = 'a' THEN pdist END AS inbound_distance, CASE WHEN link_class = 'a' THEN pel END AS inbound_elapsed_min,
    CASE WHEN link_class = 'c' THEN NULL WHEN link_class = 'b' THEN 'no_inbound' WHEN gap < 35 THEN 'lt_35' WHEN gap < 60 THEN '35_60' WHEN gap < 120 THEN '60_120' ELSE 'ge_120' END AS band,
    CASE WHEN link_class <> 'c' THEN CAST(least(pos, 6) AS VARCHAR) END AS position_key
  FROM classed
  UNION ALL BY NAME
  SELECT event_id, tail, carrier, service_date, dep_ts, origin, dest, elapsed_min, distance, density, 'c' AS link_class FROM dense WHERE tail IS NULL)"""


@query(f"WITH {CHAIN_SQL} SELECT * FROM chain")
def chain_links(spark, d):
    return chain.link(legs_events(spark, d))


@query(f"WITH {CHAIN_SQL} SELECT link_class, coalesce(band, 'none') AS band, count(*) AS legs, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM chain GROUP BY link_class, band")
def chain_class_shares(spark, d):
    from lathe.operators.measures import share_of_total

    bands = chain.link(legs_events(spark, d)).groupBy("link_class", F.coalesce("band", F.lit("none")).alias("band")).agg(F.count("*").alias("legs"))
    return share_of_total(bands, "legs")


@query(f"""WITH {CHAIN_SQL}, w AS (SELECT *, CASE band WHEN 'lt_35' THEN 4 WHEN '35_60' THEN 3 WHEN '60_120' THEN 2 WHEN 'ge_120' THEN 1 WHEN 'no_inbound' THEN 0 END AS weight FROM chain)
SELECT event_id, tail, CASE WHEN tail IS NULL THEN 0 ELSE count(*) OVER l END AS later_legs, CASE WHEN tail IS NULL THEN 0 ELSE CAST(coalesce(sum(weight) OVER l, 0) AS BIGINT) END AS later_weight,
  CASE WHEN tail IS NULL THEN 0 ELSE CAST(coalesce(sum(CAST(weight IS NULL AS INT)) OVER l, 0) AS BIGINT) END AS later_unknown
FROM w WINDOW l AS (PARTITION BY tail, service_date ORDER BY dep_ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def cascade_exposure(spark, d):
    band = F.col("band")
    weight = F.when(band == "lt_35", 4).when(band == "35_60", 3).when(band == "60_120", 2).when(band == "ge_120", 1).when(band == "no_inbound", 0)
    return chain.exposure(chain.link(legs_events(spark, d)), weight).select("event_id", "tail", "later_legs", "later_weight", "later_unknown")


@query(f"""WITH {CHAIN_SQL}, e AS (SELECT *, CASE WHEN link_class = 'c' THEN 0 ELSE greatest(legs_today - rotation_position, 0) END AS rest FROM chain)
SELECT origin, CAST(hour(dep_ts) AS INTEGER) AS hour, count(*) AS n_flights, count(*) FILTER (is_tight) AS n_tight, round(count(*) FILTER (is_tight)::DOUBLE / count(*), 9) AS tight_share,
  CAST(sum(rest) AS BIGINT) AS downstream_legs, count(*) FILTER (is_tight)::DOUBLE / count(*) >= 0.25 AS fragile FROM e GROUP BY ALL""")
def fragile_banks(spark, d):
    rest = F.when(F.col("link_class") == "c", 0).otherwise(F.greatest(F.col("legs_today") - F.col("rotation_position"), F.lit(0)))
    tight, n = F.count_if("is_tight"), F.count("*")
    banks = chain.link(legs_events(spark, d)).withColumn("rest", rest).groupBy("origin", F.hour(F.col("dep_ts").cast("timestamp")).alias("hour"))
    return banks.agg(n.alias("n_flights"), tight.alias("n_tight"), F.round(tight / n, 9).alias("tight_share"), F.sum("rest").alias("downstream_legs"), (tight / n >= 0.25).alias("fragile"))


@query(f"WITH {LEGS_EVENTS}, s AS (SELECT *, lag(dep_ts) OVER (PARTITION BY tail ORDER BY event_id * 7919 % 10007) AS before FROM legs WHERE tail IS NOT NULL) SELECT event_id, tail, dep_ts FROM s WHERE dep_ts <= before")
def chain_seams(spark, d):
    return chain.seams(legs_events(spark, d).withColumn("arrival", F.col("event_id") * 7919 % 10007), "arrival").select("event_id", "tail", "dep_ts")


@query(f"WITH {LEGS_EVENTS} SELECT tail, service_date, count(*) AS legs FROM legs WHERE tail IS NOT NULL GROUP BY ALL")
def legs_per_tail_day(spark, d):
    return legs_events(spark, d).where("tail IS NOT NULL").groupBy("tail", "service_date").agg(F.count("*").alias("legs"))


_RESET = CHAIN_SQL.replace("dense AS (", "tagged AS (SELECT *, CASE WHEN lag(carrier) OVER (PARTITION BY tail ORDER BY dep_ts, event_id) <> carrier THEN 1 ELSE 0 END AS st FROM legs), runs AS (SELECT *, sum(st) OVER (PARTITION BY tail ORDER BY dep_ts, event_id) AS run FROM tagged), dense AS (").replace("AS density FROM legs)", "AS density FROM runs)").replace("w AS (PARTITION BY tail ORDER", "w AS (PARTITION BY tail, run ORDER").replace("(PARTITION BY tail ORDER BY dep_ts, event_id), false) AS taint", "(PARTITION BY tail, run ORDER BY dep_ts, event_id), false) AS taint")


@query(f"WITH {_RESET} SELECT event_id, link_class, turnaround_min FROM chain")
def chain_links_by_carrier(spark, d):
    return chain.link(legs_events(spark, d), carrier_resets=True).select("event_id", "link_class", "turnaround_min")
