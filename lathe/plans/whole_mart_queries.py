"""The feature mart in full over the events table, and its guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import chain, features, quality, rates, requests
from lathe.plans.adapters import legs_events, table
from lathe.plans.base import query
from lathe.plans.chain_queries import CHAIN_SQL
from lathe.session import materialise

CUT = "2024-01-16"


def outcome_legs(spark, d):
    i = F.col("event_id")
    return legs_events(spark, d).withColumns({"cancelled": i % 13 == 0, "del15": F.when(i % 8 > 0, i % 5 < 2), "arr_delay": (i % 120 - 40).cast("double")})


def whole_mart(spark, d):
    i = F.col("event_id")
    legs = outcome_legs(spark, d)
    seen = table(spark, d, "events").where("event_type IN ('view', 'click')")
    readings = [F.round(F.col("value") + 20, 6).alias("temp_f"), F.round(F.col("value") / 4, 6).alias("wind_kn"), F.when(i % 3 == 0, F.round(F.col("value") / 2, 6)).alias("gust_kn"), (i % 3 == 0).alias("gust_reported"), F.round(F.col("value") / 3, 6).alias("visibility_mi"), F.round(F.col("value") / 100, 6).alias("precip_in"), (i % 4 == 0).alias("had_fog"), (i % 6 == 0).alias("had_rain")]
    observations = seen.select((10 + i % 2).alias("station"), "ts", *readings)
    stations = materialise(legs.select(F.col("origin").alias("airport")).distinct().where("airport < 2").withColumn("station", F.col("airport") + 10), "stations")
    days = materialise(legs.select(F.col("service_date").alias("day")).distinct(), "days")
    holidays = materialise(features.holidays_padded(days, "day", F.dayofmonth("day").isin(1, 15, 16)), "holidays")
    return features.assemble(legs, observations, stations, holidays, CUT)


_LEVELS = {"route": "origin || '-' || dest", "carrier": "carrier", "airport": "CAST(origin AS VARCHAR)", "band": "band", "position": "position_key"}
_RATE = "SELECT '{0}' AS level, {1} AS key, count(*) AS n, round(count(*) FILTER (del15)::DOUBLE / count(*), 9) AS rate, round(avg(arr_delay), 9) AS delay FROM done WHERE service_date < DATE '{2}' AND {1} IS NOT NULL GROUP BY 2"
_KEYS = {"route": ("route", "f.route"), "carrier": ("carrier", "f.carrier"), "origin": ("airport", "CAST(f.origin AS VARCHAR)"), "dest": ("airport", "CAST(f.dest AS VARCHAR)"), "band": ("band", "f.band"), "position": ("position", "f.position_key")}
_SMOOTH = "h_{0}.n AS hist_{0}_n, round((h_{0}.n * h_{0}.rate + 50 * g_rate) / (h_{0}.n + 50), 9) AS hist_{0}_rate, round((h_{0}.n * h_{0}.delay + 50 * g_delay) / (h_{0}.n + 50), 9) AS hist_{0}_delay"
WHOLE_SQL = f"""{CHAIN_SQL},
done AS (SELECT *, origin || '-' || dest AS route, event_id % 5 < 2 AS del15, (event_id % 120 - 40)::DOUBLE AS arr_delay FROM chain WHERE event_id % 13 > 0 AND event_id % 8 > 0),
rates AS ({" UNION ALL ".join(_RATE.format(n, k, CUT) for n, k in _LEVELS.items())}),
prior AS (SELECT sum(n * rate) / sum(n) AS g_rate, sum(n * delay) / sum(n) AS g_delay FROM rates WHERE level = 'carrier'),
obs AS (SELECT event_id AS obs_id, 10 + event_id % 2 AS station, ts AS observed_ts, round(value + 20, 6) AS temp_f, round(value / 4, 6) AS wind_kn, CASE WHEN event_id % 3 = 0 THEN round(value / 2, 6) END AS gust, event_id % 3 = 0 AS gust_reported, round(value / 3, 6) AS vis,
  round(value / 100, 6) AS precip_in, event_id % 4 = 0 AS had_fog, event_id % 6 = 0 AS had_rain FROM events WHERE event_type IN ('view', 'click')),
met AS (SELECT l.event_id, o.*, row_number() OVER (PARTITION BY l.event_id ORDER BY observed_ts DESC) AS k FROM done l JOIN obs o ON l.origin < 2 AND o.station = l.origin + 10 AND observed_ts <= dep_ts AND observed_ts > dep_ts - INTERVAL 3 HOUR),
hol AS (SELECT DISTINCT service_date AS h FROM legs WHERE day(service_date) IN (1, 15, 16)),
f AS (SELECT done.*, service_date IN (FROM hol) AS is_holiday, service_date + 1 IN (SELECT h FROM hol) AS is_day_before, service_date - 1 IN (SELECT h FROM hol) AS is_day_after FROM done),
mart AS (SELECT f.*, CAST(hour(dep_ts) AS INTEGER) AS dep_hour, CAST(isodow(service_date) AS INTEGER) AS weekday, CAST(month(service_date) AS INTEGER) AS month, service_date < DATE '{CUT}' AS is_training_row, {", ".join(_SMOOTH.format(n) for n in _KEYS)},
  observed_ts, temp_f, wind_kn, CASE WHEN obs_id IS NOT NULL THEN coalesce(gust, 0) END AS gust_kn, gust_reported, CASE WHEN vis > 10 THEN 10 ELSE vis END AS visibility_mi, precip_in, had_fog, had_rain, obs_id IS NOT NULL AS has_origin_weather
  FROM f CROSS JOIN prior LEFT JOIN (SELECT * RENAME (event_id AS leg_id) FROM met WHERE k = 1) m ON m.leg_id = f.event_id {" ".join(f"LEFT JOIN rates h_{n} ON h_{n}.level = '{level}' AND h_{n}.key = {key}" for n, (level, key) in _KEYS.items())})"""


@query(f"WITH {WHOLE_SQL} SELECT * FROM mart")
def feature_mart_whole(spark, d):
    return whole_mart(spark, d)


@query(f"""WITH {WHOLE_SQL} SELECT violation, count(*) AS rows FROM (
  SELECT 'observed_before_departure' AS violation FROM mart WHERE has_origin_weather AND event_id % 37 = 1
  UNION ALL SELECT 'weather_all_or_none' FROM mart WHERE (has_origin_weather AND event_id % 37 = 2) OR (NOT has_origin_weather AND event_id % 37 = 3)
  UNION ALL SELECT 'visibility_capped' FROM mart WHERE visibility_mi IS NOT NULL AND event_id % 37 = 4
  UNION ALL SELECT 'history_of_links_only' FROM mart WHERE link_class = 'c' AND event_id % 37 = 5
  UNION ALL SELECT 'training_by_date' FROM mart WHERE event_id % 37 = 6
  UNION ALL SELECT 'shares' FROM mart WHERE event_id % 37 = 7 AND hist_carrier_rate IS NOT NULL) GROUP BY 1""")
def check_whole_mart(spark, d):
    """The guards over a mart with a fault planted for each; sound rows break none."""
    i = F.col("event_id") % 37
    mart = whole_mart(spark, d)
    faults = {
        "observed_ts": F.when(i == 1, F.timestamp_add("MINUTE", F.lit(1), F.col("dep_ts"))).otherwise(F.col("observed_ts")), "gust_kn": F.when(i != 2, F.col("gust_kn")), "temp_f": F.when((i == 3) & ~F.col("has_origin_weather"), 1.0).otherwise(F.col("temp_f")),
        "visibility_mi": F.when((i == 4) & F.col("visibility_mi").isNotNull(), 11.0).otherwise(F.col("visibility_mi")), "hist_band_n": F.when(i == 5, 1).otherwise(F.col("hist_band_n")),
        "is_training_row": F.when(i == 6, ~F.col("is_training_row")).otherwise(F.col("is_training_row")), "hist_carrier_rate": F.when(i == 7, F.col("hist_carrier_rate") + 1).otherwise(F.col("hist_carrier_rate")),
    }
    return quality.counts_of(features.mart_violations(mart.withColumns(faults), CUT))


_ASKED = """asked AS (SELECT event_id AS request_id, carrier, CASE WHEN event_id % 23 = 0 THEN 9 ELSE origin END AS origin, dest, service_date + 30 AS flight_date, strftime(dep_ts, '%H:%M') AS dep_time, strftime(dep_ts + INTERVAL 2 HOUR, '%H:%M') AS arr_time,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN -5.0 WHEN 2 THEN 'nan'::DOUBLE ELSE distance::DOUBLE END AS distance, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 0.0 ELSE 3.0 END AS density,
  CASE WHEN event_id % 3 > 0 THEN 1 + event_id % 7 END AS rotation_position, CASE WHEN event_id % 6 <> 1 THEN event_id % 4 END AS legs_today, CASE WHEN event_id % 7 > 0 THEN event_id % 10 * 100 END AS turnaround_min,
  CASE WHEN event_id % 11 > 0 THEN event_id % 9 * 100 END AS inbound_distance, CASE WHEN event_id % 13 > 0 THEN 60 END AS inbound_elapsed_min FROM legs)"""
_USE = "CASE WHEN {0} > 0 AND isfinite({0}) THEN {0} ELSE {1} END"
_PAST = {"route": ("route", "a.route"), "carrier": ("carrier", "a.carrier"), "origin": ("airport", "CAST(a.origin AS VARCHAR)"), "dest": ("airport", "CAST(a.dest AS VARCHAR)"), "band": ("band", "CASE WHEN turnaround_min IS NULL THEN 'no_inbound' WHEN turnaround_min < 35 THEN 'lt_35' WHEN turnaround_min < 60 THEN '35_60' WHEN turnaround_min < 120 THEN '60_120' ELSE 'ge_120' END"), "position": ("position", "coalesce(CAST(CAST(least(floor(rotation_position), 6) AS BIGINT) AS VARCHAR), '3')")}


@query(f"""WITH {WHOLE_SQL}, {_ASKED},
history AS (SELECT level, key, n, round((n * rate + 50 * g_rate) / (n + 50), 9) AS rate, round((n * delay + 50 * g_delay) / (n + 50), 9) AS delay FROM rates, prior),
far AS (SELECT origin || '-' || dest AS route, min(distance)::DOUBLE AS d FROM legs GROUP BY 1),
dens AS (SELECT origin, hour(dep_ts) AS h, isodow(service_date) AS wd, quantile_disc(density, 0.5)::DOUBLE AS m FROM (SELECT DISTINCT origin, service_date, date_trunc('hour', dep_ts) AS dep_ts, density FROM chain) GROUP BY 1, 2, 3),
typ AS (SELECT quantile_disc(rotation_position, 0.5)::DOUBLE AS tp, quantile_disc(legs_today, 0.5)::DOUBLE AS tl, quantile_disc(turnaround_min, 0.5)::DOUBLE AS tt, quantile_disc(inbound_distance, 0.5)::DOUBLE AS td, quantile_disc(inbound_elapsed_min, 0.5)::DOUBLE AS te FROM chain),
b AS (SELECT asked.*, origin || '-' || dest AS route, rotation_position IS NOT NULL AS given, typ.* FROM asked, typ),
g AS (SELECT *, CASE WHEN given THEN turnaround_min ELSE tt END AS gap FROM b),
a AS (SELECT request_id, carrier, g.origin, dest, flight_date, dep_time, arr_time, {_USE.format("g.distance", "far.d")} AS distance, {_USE.format("g.density", "dens.m")} AS density, g.route,
  CASE WHEN given THEN rotation_position::DOUBLE ELSE tp END AS rotation_position, CASE WHEN given THEN greatest(coalesce(legs_today, tl), rotation_position)::DOUBLE ELSE tl END AS legs_today, CASE WHEN gap BETWEEN 0 AND 840 THEN gap::DOUBLE END AS turnaround_min,
  CASE WHEN gap BETWEEN 0 AND 840 THEN nullif(CASE WHEN given THEN coalesce(inbound_distance, td) ELSE td END, 0)::DOUBLE END AS inbound_distance, CASE WHEN gap BETWEEN 0 AND 840 THEN (CASE WHEN given THEN coalesce(inbound_elapsed_min, te) ELSE te END)::DOUBLE END AS inbound_elapsed_min,
  CAST(split_part(dep_time, ':', 1) AS INTEGER) AS dep_hour, CAST(split_part(arr_time, ':', 1) AS INTEGER) AS arr_hour, CAST(isodow(flight_date) AS INTEGER) AS weekday, CAST(month(flight_date) AS INTEGER) AS month, coalesce(gap BETWEEN 0 AND 840, false) AS has_inbound_leg,
  CASE WHEN given THEN 'provided' ELSE 'typical' END AS rotation_context, CASE WHEN g.density > 0 AND isfinite(g.density) THEN 'provided' ELSE 'estimated' END AS density_source
  FROM g LEFT JOIN far ON far.route = g.route LEFT JOIN dens ON dens.origin = g.origin AND dens.h = CAST(split_part(dep_time, ':', 1) AS INTEGER) AND dens.wd = isodow(flight_date))
SELECT a.*, turnaround_min - 35 AS slack_min, coalesce(turnaround_min < 35, false) AS is_tight, {", ".join(f"h_{n}.n AS hist_{n}_n, h_{n}.rate AS hist_{n}_rate, h_{n}.delay AS hist_{n}_delay" for n in _PAST)}
FROM a {" ".join(f"LEFT JOIN history h_{n} ON h_{n}.level = '{level}' AND h_{n}.key = {key}" for n, (level, key) in _PAST.items())}""")
def request_batch(spark, d):
    """Every event as a request, with values that can't be used and blocks that are given in part or not at all."""
    i = F.col("event_id")
    legs = outcome_legs(spark, d)
    linked = materialise(chain.link(legs).withColumn("route", F.concat_ws("-", "origin", "dest")), "linked")
    done = linked.where(~F.col("cancelled") & F.col("del15").isNotNull())
    levels = {"route": F.col("route"), "carrier": F.col("carrier"), "airport": F.col("origin"), "band": F.col("band"), "position": F.col("position_key")}
    known = materialise(rates.level_rates(done, levels, CUT), "rates")
    prior = rates.global_rate(known, "carrier")
    smooth = {c: F.round(rates.smoothed(F.col("n"), F.col(v), prior.select(g).scalar()), 9) for c, v, g in (("rate", "rate", "global_rate"), ("delay", "avg_delay", "global_delay"))}
    history = known.select("level", "key", "n", *[c.alias(n) for n, c in smooth.items()])
    distances = linked.groupBy("route").agg(F.min("distance").alias("distance"))
    slots = linked.select("origin", "service_date", F.hour(F.col("dep_ts").cast("timestamp")).alias("dep_hour"), "density").distinct()
    median = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    densities = slots.groupBy("origin", "dep_hour", (F.weekday("service_date") + 1).alias("weekday")).agg(median("density").alias("density"))
    named = dict(zip(requests.TYPICAL, ("rotation_position", "legs_today", "turnaround_min", "inbound_distance", "inbound_elapsed_min"), strict=True))
    typical = linked.agg(*[median(c).alias(n) for n, c in named.items()])
    clock = lambda ts: F.date_format(ts, "HH:mm")
    nan = F.lit(float("nan"))
    asked = legs.select(
        i.alias("request_id"), "carrier", F.when(i % 23 == 0, 9).otherwise(F.col("origin")).cast("long").alias("origin"), "dest", F.date_add("service_date", 30).alias("flight_date"), clock(F.col("dep_ts")).alias("dep_time"), clock(F.timestamp_add("HOUR", F.lit(2), F.col("dep_ts"))).alias("arr_time"),
        F.when(i % 4 == 1, -5.0).when(i % 4 == 2, nan).when(i % 4 == 3, F.col("distance").cast("double")).alias("distance"), F.when(i % 5 == 1, nan).when(i % 5 == 2, 0.0).when(i % 5 > 2, 3.0).alias("density"),
        F.when(i % 3 > 0, 1 + i % 7).alias("rotation_position"), F.when(i % 6 != 1, i % 4).alias("legs_today"), F.when(i % 7 > 0, i % 10 * 100).alias("turnaround_min"), F.when(i % 11 > 0, i % 9 * 100).alias("inbound_distance"), F.when(i % 13 > 0, 60).alias("inbound_elapsed_min"),
    )
    sides = (materialise(t, n) for t, n in ((history, "history"), (distances, "distances"), (densities, "densities"), (typical, "typical")))
    return requests.assemble_requests(asked, *sides)
