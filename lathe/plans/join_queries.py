"""Joins: null-safe, anti and semi, nearest, as-of with fallback, trailing counts, ranges and outcome settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import joins as j
from lathe.plans.adapters import LEGS_LINEITEM, legs_lineitem, table
from lathe.plans.base import query


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment FROM customer),
r AS (SELECT c_nationkey AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, count(*) AS customers FROM customer GROUP BY ALL)
SELECT l.nation, l.segment, r.customers FROM l JOIN r ON l.nation = r.nation AND l.segment IS NOT DISTINCT FROM r.segment""")
def null_safe_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return j.null_safe(c.distinct(), c.groupBy("nation", "segment").agg(F.count("*").alias("customers")), ["nation", "segment"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def suppliers_near_machinery(spark, d):
    busy = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(busy, "s_nationkey", "left_semi")


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT DISTINCT origin AS airport FROM flown UNION SELECT dest FROM flown)
SELECT airport, n_name, r_name FROM a JOIN nation ON n_nationkey = airport JOIN region ON r_regionkey = n_regionkey""")
def flown_airports(spark, d):
    legs = legs_lineitem(spark, d)
    both = legs.select(F.col("origin").alias("airport")).union(legs.select("dest")).distinct()
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.join(nation, F.col("airport") == F.col("n_nationkey")).select("airport", "n_name", "r_name")


_POINT = "(({k} * 37) % 17000) / 100.0::DOUBLE - 85 AS lat, (({k} * 91) % 35900) / 100.0::DOUBLE - 179.5 AS lon"


def _placed(df, key):
    return df.select(key, (((F.col(key) * 37) % 17000) / 100.0 - 85).alias("lat"), (((F.col(key) * 91) % 35900) / 100.0 - 179.5).alias("lon"))


@query(f"""WITH p AS (SELECT c_custkey, {_POINT.format(k='c_custkey')} FROM customer), s AS (SELECT s_suppkey, {_POINT.format(k='(s_suppkey * 7)')} FROM supplier),
m AS (SELECT c_custkey, s_suppkey, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS km FROM p, s),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS k FROM m)
SELECT c_custkey, s_suppkey, round(km, 2) AS distance_km FROM r WHERE k = 1""")
def nearest_supplier(spark, d):
    sites = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7).alias("k"))
    sites = sites.join(_placed(sites, "k").distinct(), "k").drop("k")
    return j.nearest(_placed(table(spark, d, "customer"), "c_custkey"), sites, "c_custkey", "s_suppkey")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS issued, ts + (event_id % 5) * INTERVAL 1 HOUR AS valid, event_id AS fx, round(value, 6) AS value FROM events WHERE event_type = 'view'),
c AS (SELECT l.*, issued, valid, fx, value, row_number() OVER (PARTITION BY event_id ORDER BY issued DESC, valid DESC, fx DESC) AS k FROM l LEFT JOIN r ON r.user_id = l.user_id AND issued <= ts AND issued >= ts - INTERVAL 30 HOUR AND valid <= ts)
SELECT event_id, user_id, ts, issued, valid, fx, value FROM c WHERE k = 1""")
def two_level_as_of(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("issued"), F.expr("timestampadd(HOUR, CAST(event_id % 5 AS INT), ts)").alias("valid"), F.col("event_id").alias("fx"), F.round("value", 6).alias("value"))
    return j.two_level_as_of(left, right, "user_id", "ts", "issued", "valid", ["fx", "value"], 30 * 3600)


PRESSURE_SQL = """SELECT l.event_id, CAST(count(*) FILTER (r.event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (r.event_type = 'view' AND r.value > 5) AS BIGINT) AS views
FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.ts >= l.ts - INTERVAL 3 HOUR AND r.ts < l.ts WHERE l.event_type = 'purchase' GROUP BY l.event_id"""


@query(PRESSURE_SQL)
def trailing_pressure(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    counts = {"errors": F.col("event_type") == "error", "views": (F.col("event_type") == "view") & (F.col("value") > 5)}
    return j.trailing_counts(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e, "user_id", "ts", 3 * 3600, counts).select("event_id", "errors", "views")


SETTLE_SQL = """WITH r0 AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id % 9 = 0 AS warmup, row_number() OVER w AS k FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id % 9 = 0)),
o0 AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id % 7 = 0 AS cancelled, CASE WHEN event_id % 5 <> 0 THEN value > 5 END AS late, row_number() OVER w AS k FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id % 7 = 0)),
fin AS (SELECT max(ts) AS e FROM (SELECT ts FROM r0 UNION ALL SELECT ts FROM o0)),
j AS (SELECT r.ts AS rts, o.ts AS ots, r.warmup, o.cancelled, o.late, coalesce(o.ts <= r.ts + INTERVAL {ttl} SECOND, false) AS met FROM (SELECT * FROM r0 WHERE k = 1) r FULL JOIN (SELECT * FROM o0 WHERE k = 1) o ON r.user_id = o.user_id AND r.day = o.day),
c AS (
  SELECT CASE WHEN warmup THEN 'warmup' WHEN cancelled THEN 'cancelled' WHEN late IS NULL THEN 'unlabelled' ELSE 'scored' END AS counter FROM j WHERE met
  UNION ALL SELECT CASE WHEN rts + INTERVAL {ttl} SECOND < e THEN 'risk_ttl' ELSE 'risk_end_of_stream' END FROM j, fin WHERE NOT met AND rts IS NOT NULL
  UNION ALL SELECT 'orphan_outcome' FROM j WHERE NOT met AND ots IS NOT NULL
  UNION ALL SELECT 'duplicate_risk' FROM r0 WHERE k > 1 UNION ALL SELECT 'duplicate_outcome' FROM o0 WHERE k > 1)
SELECT counter, count(*) AS events FROM c GROUP BY counter"""


def settlement_inputs(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    risks = e.where("event_type = 'signup'").select("user_id", "day", "ts", (F.col("event_id") % 9 == 0).alias("warmup"))
    outcomes = e.where("event_type = 'purchase'").select("user_id", "day", "ts", (F.col("event_id") % 7 == 0).alias("cancelled"), F.when(F.col("event_id") % 5 != 0, F.col("value") > 5).alias("late"))
    return risks, outcomes


@query(SETTLE_SQL.format(ttl=48 * 3600))
def outcome_settlement(spark, d):
    return j.settle_outcomes(*settlement_inputs(spark, d), ["user_id", "day"], 48 * 3600)


@query(SETTLE_SQL.format(ttl=3600))
def outcome_settlement_short(spark, d):
    return j.settle_outcomes(*settlement_inputs(spark, d), ["user_id", "day"], 3600)


@query(f"""WITH {LEGS_LINEITEM} SELECT CASE WHEN arr_delay < 0 THEN 'early' WHEN arr_delay < 15 THEN 'on_time' WHEN arr_delay < 45 THEN 'late' WHEN arr_delay <= 60 THEN 'very_late' END AS band, count(*) AS legs FROM flown GROUP BY 1""")
def delay_bands(spark, d):
    bands = [(-1e9, 0, "early"), (0, 15, "on_time"), (15, 45, "late"), (45, 60, "very_late")]
    return j.band_join(legs_lineitem(spark, d), F.col("arr_delay"), bands).groupBy("band").agg(F.count("*").alias("legs"))


@query(f"""WITH {LEGS_LINEITEM}, g AS (SELECT origin, isodow(service_date) AS wd, max(service_date) AS day FROM flown WHERE isodow(service_date) = 3 GROUP BY ALL)
SELECT f.origin, f.service_date, count(*) AS legs, round(sum(p), 6) AS expected FROM flown f JOIN g ON f.origin = g.origin AND f.service_date = g.day GROUP BY ALL""")
def proxy_day(spark, d):
    legs = legs_lineitem(spark, d)
    days = legs.where(F.weekday("service_date") == 2).groupBy("origin").agg(F.max("service_date").alias("service_date"))
    return legs.join(days, ["origin", "service_date"]).groupBy("origin", "service_date").agg(F.count("*").alias("legs"), F.round(F.sum("p"), 6).alias("expected"))


@query("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS code, o_custkey FROM orders), c AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 3 = 1 THEN 'K' ELSE 'P' END || l_orderkey AS station FROM lineitem),
t AS (SELECT station, p.rank, p.key FROM c, LATERAL (VALUES (1, station), (2, substr(station, 2))) p(rank, key))
SELECT station, min_by(r.code, rank) AS code FROM t JOIN r ON r.code = t.key GROUP BY station""")
def prefix_trials(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("code"))
    third = F.col("l_orderkey") % 3
    station = F.concat(F.when(third == 0, "").when(third == 1, "K").otherwise("P"), F.col("l_orderkey").cast("string"))
    tries = table(spark, d, "lineitem").select(station.alias("station")).distinct().select("station", F.posexplode(F.array("station", F.expr("substring(station, 2)"))).alias("rank", "key"))
    return tries.join(o, F.col("code") == F.col("key")).groupBy("station").agg(F.min_by("code", "rank").alias("code"))
