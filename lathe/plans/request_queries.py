"""Guards of requests and observations, orderings with every tie broken, labels and side tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import scalars as s
from lathe.operators import chain, clean, evaluate, joins, measures, quality, rates
from lathe.plans.adapters import LEGS_EVENTS, LEGS_LINEITEM, legs_events, legs_lineitem, table
from lathe.plans.base import ORACLES, query
from lathe.plans.chain_queries import CHAIN_SQL, cascade_exposure, fragile_banks
from lathe.plans.evaluate_queries import SCORED, scored
from lathe.plans.feature_queries import historical_rates
from lathe.plans.stream_queries import _stream
from lathe.session import materialise
from lathe.sources import files
from lathe.streaming import replay


@query(f"""WITH {CHAIN_SQL}, b AS (SELECT CASE WHEN event_id % 41 <> 0 THEN rotation_position END AS pos, CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN 0 ELSE legs_today END AS n,
  CASE WHEN event_id % 59 = 0 THEN turnaround_min + 0.5::DOUBLE ELSE turnaround_min END AS turn, CASE WHEN event_id % 61 <> 0 THEN inbound_distance END AS dist, inbound_elapsed_min AS el FROM chain),
g AS (SELECT *, CAST(turn IS NOT NULL AS INT) + CAST(dist IS NOT NULL AS INT) + CAST(el IS NOT NULL AS INT) AS k FROM b),
v AS (SELECT 'position_range' AS violation FROM g WHERE pos < 1 OR pos > 30 UNION ALL SELECT 'total_range' FROM g WHERE n < 1 OR n > 30 UNION ALL SELECT 'turnaround_range' FROM g WHERE turn < 0 OR turn > 840
  UNION ALL SELECT 'turnaround_whole' FROM g WHERE turn <> floor(turn) UNION ALL SELECT 'no_position' FROM g WHERE pos IS NULL AND (n IS NOT NULL OR k > 0) UNION ALL SELECT 'no_total' FROM g WHERE pos IS NOT NULL AND n IS NULL
  UNION ALL SELECT 'total_below_position' FROM g WHERE n < pos UNION ALL SELECT 'inbound_in_part' FROM g WHERE k IN (1, 2) UNION ALL SELECT 'inbound_needed' FROM g WHERE pos >= 2 AND k < 3)
SELECT violation, count(*) AS rows FROM v GROUP BY 1""")
def check_request_block(spark, d):
    """Rotation blocks of requests, some broken on purpose."""
    i = F.col("event_id")
    asked = chain.link(legs_events(spark, d)).select(
        F.when(i % 41 != 0, F.col("rotation_position")).alias("position"), F.when(i % 43 == 0, None).when(i % 47 == 0, 0).otherwise(F.col("legs_today")).alias("total"),
        F.when(i % 59 == 0, F.col("turnaround_min") + 0.5).otherwise(F.col("turnaround_min")).alias("turnaround"), F.when(i % 61 != 0, F.col("inbound_distance")).alias("inbound_distance"), "inbound_elapsed_min",
    )
    rules = quality.block_rules("position", "total", ["turnaround", "inbound_distance", "inbound_elapsed_min"], {"position": (1, 30), "total": (1, 30), "turnaround": (0, 840)}, ["turnaround"])
    return quality.counts_of(quality.labelled(asked, rules))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT p.event_id, p.ts, (SELECT max(v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts > p.ts - INTERVAL 30 HOUR) AS seen FROM p),
b AS (SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN ts END AS dep, CASE WHEN event_id % 29 = 0 THEN seen + INTERVAL 31 HOUR WHEN event_id % 23 = 0 THEN seen - INTERVAL 31 HOUR ELSE seen END AS seen, CASE WHEN event_id % 19 = 0 THEN seen IS NULL ELSE seen IS NOT NULL END AS has FROM m)
SELECT event_id, 'observed_after_departure' AS violation FROM b WHERE seen > dep UNION ALL SELECT event_id, 'outside_lookback' FROM b WHERE seen <= dep - INTERVAL 30 HOUR
UNION ALL SELECT event_id, 'flag_without_observation' FROM b WHERE has AND seen IS NULL UNION ALL SELECT event_id, 'observation_without_flag' FROM b WHERE NOT has AND seen IS NOT NULL
UNION ALL SELECT event_id, 'cannot_verify' FROM b WHERE seen IS NOT NULL AND dep IS NULL
UNION ALL SELECT NULL, 'too_many_missing' FROM (SELECT count(*) FILTER (NOT has)::DOUBLE / count(*) AS f FROM b) WHERE f > 0.05""")
def check_observations(spark, d):
    """As-of matches, some broken on purpose."""
    e, i = table(spark, d, "events"), F.col("event_id")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    met = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", ["view_id"], 30 * 3600)
    seen = F.col("ts_matched")
    moved = F.when(i % 29 == 0, F.timestamp_add("HOUR", F.lit(31), seen)).when(i % 23 == 0, F.timestamp_add("HOUR", F.lit(-31), seen)).otherwise(seen)
    broken = met.select("event_id", F.when(i % 31 != 0, F.col("ts")).alias("dep"), moved.alias("seen"), F.when(i % 19 == 0, seen.isNull()).otherwise(seen.isNotNull()).alias("has"))
    return quality.observation_violations(broken, ["event_id"], "dep", "seen", "has", 30 * 3600, 0.05)


@query(f"WITH {SCORED} SELECT service_date, origin, carrier, flight_number, line, p, rank() OVER (PARTITION BY service_date, origin ORDER BY p DESC, dep_hour, carrier, flight_number, line) AS place FROM s")
def risk_ordering(spark, d):
    order = [F.desc("p"), F.col("dep_hour"), F.col("carrier"), F.col("flight_number"), F.col("line")]
    return evaluate.placed(scored(spark, d), ["service_date", "origin"], order).select("service_date", "origin", "carrier", "flight_number", "line", "p", "place")


@query(f"WITH c AS ({ORACLES['cascade_exposure']}), {LEGS_EVENTS} SELECT event_id, c.later_weight, row_number() OVER (PARTITION BY service_date, origin ORDER BY c.later_weight DESC, dep_ts, carrier, event_id) AS place FROM c JOIN legs USING (event_id)")
def cascade_ordering(spark, d):
    score = cascade_exposure(spark, d).select("event_id", "later_weight")
    both = legs_events(spark, d).join(score, "event_id")
    return evaluate.placed(both, ["service_date", "origin"], [F.desc("later_weight"), F.col("dep_ts"), F.col("carrier"), F.col("event_id")]).select("event_id", "later_weight", "place")


@query(f"WITH f AS ({ORACLES['fragile_banks']}) SELECT origin, hour, downstream_legs, tight_share, fragile, row_number() OVER (PARTITION BY origin ORDER BY downstream_legs DESC, tight_share DESC, hour) AS place FROM f")
def fragile_bank_ordering(spark, d):
    order = [F.desc("downstream_legs"), F.desc("tight_share"), F.col("hour")]
    return evaluate.placed(fragile_banks(spark, d), ["origin"], order).select("origin", "hour", "downstream_legs", "tight_share", "fragile", "place")


@query(f"""WITH {SCORED}, r AS (SELECT carrier, y, rank() OVER (PARTITION BY carrier ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY carrier) AS n FROM s)
SELECT carrier, count(*) AS n, count(*) FILTER (k <= greatest(1, n // 10)) AS top_n, round(avg(y::INT), 9) AS base, round(avg(y::INT) FILTER (k <= greatest(1, n // 10)), 9) AS top_late,
  round(avg(y::INT) FILTER (k <= greatest(1, n // 10)) / avg(y::INT), 9) AS lift FROM r GROUP BY carrier""")
def top_decile(spark, d):
    return evaluate.top_share(scored(spark, d), ["carrier"])


@query(f"WITH h AS ({ORACLES['historical_rates']}) SELECT * FROM h WHERE level <> 'dest' UNION ALL SELECT * REPLACE ('dest' AS level) FROM h WHERE level = 'origin'")
def destination_as_origin(spark, d):
    """Rates in which an airport's record as an origin stands for it as a destination."""
    return rates.relabelled(historical_rates(spark, d), "origin", "dest")


@query("SELECT event_id, CAST(NULL AS BIGINT) AS user_id, CASE WHEN value > 6 THEN 6.01 ELSE value END AS value FROM events")
def harmonised_values(spark, d):
    return clean.harmonised(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], {"value": (6.0, 6.01)})


@query("""SELECT s_suppkey, to_json({'id': s_suppkey, 'zone': CASE WHEN s_nationkey <> 0 THEN s_nationkey END, 'note': CASE WHEN s_suppkey % 5 <> 0 THEN 'n' || s_nationkey END})::VARCHAR AS record FROM supplier""")
def station_records(spark, d):
    """Records as JSON with their nulls, and only columns that may be shown."""
    zone, note = s.present(F.col("s_nationkey")), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    record = F.to_json(F.struct(F.col("s_suppkey").alias("id"), zone.alias("zone"), note.alias("note")), {"ignoreNullFields": "false"})
    return clean.allowed(table(spark, d, "supplier").withColumn("record", record), ["s_suppkey", "record", "owner"])


@query("SELECT event_id, TRY_CAST((2023 + event_id % 3) || '-' || (event_id % 15) || '-' || (event_id % 33) AS DATE) AS day FROM events")
def guarded_dates(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", s.date_of(2023 + i % 3, i % 15, i % 33).alias("day"))


@query("""WITH b AS (SELECT s_suppkey, 'S' || s_suppkey AS code, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'City ' || s_nationkey END AS city, least(s_suppkey * 37 % 1440 + 45, 1439) AS m FROM supplier)
SELECT s_suppkey, CASE WHEN trim(name) <> '' THEN trim(name) || ' (' || code || ')' WHEN city IS NOT NULL THEN city || ' (' || code || ')' ELSE code END AS label, code, lpad((m // 60)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS onward FROM b""")
def picker_labels(spark, d):
    """Labels, the codes read back from them, and the first time that one can go on."""
    i = F.col("s_suppkey")
    name = F.when(i % 4 == 0, None).when(i % 4 == 1, " ").otherwise(F.col("s_name"))
    label = s.place_label(F.concat(F.lit("S"), i.cast("string")), name, F.when(i % 3 != 0, F.concat(F.lit("City "), F.col("s_nationkey").cast("string"))))
    return table(spark, d, "supplier").select("s_suppkey", label.alias("label"), s.label_code(label).alias("code"), s.earliest_connection(i * 37 % 1440).alias("onward"))


@query("SELECT event_id, i AS layer FROM events LEFT JOIN LATERAL (SELECT unnest(range(1, event_id % 4 + 1)) AS i) ON true")
def layers_or_none(spark, d):
    """A row per layer, and one for an event whose array is null."""
    layers = F.when(F.col("event_id") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("event_id") % 4))
    return table(spark, d, "events").select("event_id", F.explode_outer(layers).alias("layer"))


@query("""SELECT c_nationkey AS zone, count(*) AS orders, count(DISTINCT custkey) AS covered, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN custkey END) AS large, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM (SELECT c_custkey AS custkey, c_nationkey FROM customer) JOIN (SELECT o_custkey AS custkey, o_totalprice, o_orderdate FROM orders) USING (custkey) GROUP BY 1""")
def zone_coverage(spark, d):
    """What an inner join covers, counted by key first so that distinct counts need no copies of rows."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("zone"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))
    out = c.join(o, "custkey").groupBy("zone").agg(F.sum("n").alias("orders"), F.count("*").alias("covered"), F.count_if(F.col("most") > 200000).alias("large"), F.min("low").alias("first"), F.max("high").alias("last"))
    return out.select("zone", "orders", "covered", "large", F.col("first").cast("date").alias("first_day"), F.col("last").cast("date").alias("last_day"))


@query(f"""WITH {LEGS_LINEITEM}, o AS (SELECT CASE WHEN cancelled THEN 'cancelled' WHEN diverted THEN 'diverted' WHEN del15 THEN 'late' ELSE 'on time' END AS outcome FROM flown)
SELECT outcome, count(*) AS legs, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM o GROUP BY 1""")
def outcome_mix(spark, d):
    outcome = F.when(F.col("cancelled"), "cancelled").when(F.col("diverted"), "diverted").when(F.col("del15"), "late").otherwise("on time")
    return measures.share_of_total(legs_lineitem(spark, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("legs")), "legs")


@query("SELECT 'absent.parquet' AS name")
def check_contract(spark, d):
    """Files of a contract that the folder of tables lacks."""
    names = files.absent_parts(spark, d, ["lineitem.parquet", "orders.parquet", "absent.parquet"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(f"""WITH {LEGS_EVENTS}, sched AS (SELECT tail, service_date, count(*) AS n FROM legs WHERE tail IS NOT NULL AND event_id % 3 = 0 GROUP BY ALL)
SELECT event_id, tail, 1 + event_id % 4 AS position, greatest(coalesce(n, 1 + event_id % 4), 1 + event_id % 4) AS legs_today, n IS NULL AS missed FROM legs LEFT JOIN sched USING (tail, service_date)""")
def stream_day_legs(spark, d):
    """Legs as a stream met by a schedule that knows only some of the days."""
    legs = legs_events(spark, d)
    schedule = legs.where("tail IS NOT NULL AND event_id % 3 = 0").groupBy("tail", "service_date").agg(F.count("*").alias("legs"))
    stream = _stream(legs.select("event_id", "tail", "service_date", "dep_ts", (1 + F.col("event_id") % 4).alias("position")), "dep_ts")
    out = replay.run_once(replay.with_day_legs(stream, materialise(schedule, "schedule")), "day-legs")
    return out.select("event_id", "tail", "position", "legs_today", "missed")
