"""Training-window rates, the feature mart and the serving lookups made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import rates
from lathe.operators.joins import as_of
from lathe.operators.measures import rate
from lathe.plans.adapters import CUTOFF, LEGS_LINEITEM, legs_lineitem
from lathe.plans.base import query
from lathe.session import materialise


def levels():
    return {"carrier": F.col("carrier"), "airport": F.col("origin"), "dest_airport": F.col("dest"), "route": F.concat_ws("-", "origin", "dest"), "hour": F.col("dep_hour")}


_LEVELS = {"carrier": "carrier", "airport": "origin", "dest_airport": "dest", "route": "origin || '-' || dest", "hour": "dep_hour"}
RATES_SQL = f"""{LEGS_LINEITEM}, done AS (SELECT * FROM flown WHERE service_date < DATE '{CUTOFF}' AND del15 IS NOT NULL),
rates AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS level, CAST({k} AS VARCHAR) AS key, count(*) AS n, round(count(*) FILTER (del15)::DOUBLE / count(*), 9) AS rate, round(avg(arr_delay), 9) AS avg_delay FROM done GROUP BY 2" for n, k in _LEVELS.items()) + "), " + """
globals AS (SELECT sum(n * rate) / sum(n) AS global_rate, sum(n * avg_delay) / sum(n) AS global_delay FROM rates WHERE level = 'carrier')"""


def _rates(spark, d, cutoff=CUTOFF):
    return rates.level_rates(legs_lineitem(spark, d), levels(), cutoff)


@query(f"WITH {RATES_SQL} SELECT * FROM rates")
def historical_rates(spark, d):
    return _rates(spark, d)


@query(f"WITH {RATES_SQL.replace(CUTOFF, '1996-07-01')} SELECT * FROM rates")
def historical_rates_refit(spark, d):
    return _rates(spark, d, "1996-07-01")


@query(f"WITH {RATES_SQL} SELECT round(global_rate, 9) AS global_rate, round(global_delay, 9) AS global_delay FROM globals")
def global_prior(spark, d):
    return rates.global_rate(_rates(spark, d), "carrier").select(F.round("global_rate", 9).alias("global_rate"), F.round("global_delay", 9).alias("global_delay"))


def features(spark, d):
    """Completed legs with smoothed rates by carrier, route, origin and, from the origin-grain level, destination."""
    known = materialise(_rates(spark, d), "rates")
    fact = legs_lineitem(spark, d).where("del15 IS NOT NULL")
    prior = rates.global_rate(known, "carrier")
    fact = fact.withColumns({"global_rate": prior.select("global_rate").scalar(), "global_delay": prior.select("global_delay").scalar()})
    for prefix, level, key in (("carrier", "carrier", F.col("carrier")), ("route", "route", F.concat_ws("-", "origin", "dest")), ("origin", "airport", F.col("origin")), ("dest", "airport", F.col("dest"))):
        fact = rates.with_level(fact, known, level, key, prefix)
    return fact.withColumn("is_training_row", F.col("service_date") < F.lit(CUTOFF).cast("date")).drop("global_rate", "global_delay")


_SMOOTH = "{p}.n AS {p}_n, round(({p}.n * {p}.rate + 50 * global_rate) / ({p}.n + 50), 9) AS {p}_rate, round(({p}.n * {p}.avg_delay + 50 * global_delay) / ({p}.n + 50), 9) AS {p}_delay"
FEATURES_SQL = f"""{RATES_SQL}, features AS (SELECT f.*, {", ".join(_SMOOTH.format(p=p) for p in ("c", "r", "o", "t"))}, service_date < DATE '{CUTOFF}' AS is_training_row
FROM (SELECT * FROM flown WHERE del15 IS NOT NULL) f CROSS JOIN globals
LEFT JOIN rates c ON c.level = 'carrier' AND c.key = CAST(f.carrier AS VARCHAR) LEFT JOIN rates r ON r.level = 'route' AND r.key = f.origin || '-' || f.dest
LEFT JOIN rates o ON o.level = 'airport' AND o.key = CAST(f.origin AS VARCHAR) LEFT JOIN rates t ON t.level = 'airport' AND t.key = CAST(f.dest AS VARCHAR))"""


@query(f"WITH {FEATURES_SQL} SELECT * RENAME (" + ", ".join(f"{a}_{s} AS {b}_{s}" for a, b in (("c", "carrier"), ("r", "route"), ("o", "origin"), ("t", "dest")) for s in ("n", "rate", "delay")) + ") FROM features")
def feature_mart(spark, d):
    return features(spark, d)


@query(f"""WITH {LEGS_LINEITEM}, n AS (SELECT origin, dep_hour, CAST(isodow(service_date) AS INTEGER) AS weekday, service_date, count(*) AS density FROM flown GROUP BY ALL)
SELECT origin, dep_hour, weekday, quantile_disc(density, 0.5)::DOUBLE AS density_median FROM n GROUP BY ALL""")
def density_profile(spark, d):
    day = legs_lineitem(spark, d).groupBy("origin", "dep_hour", "service_date").agg(F.count("*").alias("density"))
    keyed = day.groupBy("origin", "dep_hour", (F.weekday("service_date") + 1).alias("weekday"))
    return keyed.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY density)").alias("density_median"))


@query(f"""WITH {RATES_SQL}, d AS (SELECT origin || '-' || dest AS key, min(arr_delay) AS least_delay FROM flown GROUP BY 1)
SELECT level AS entity_level, key AS entity_key, n, rate, avg_delay, least_delay FROM rates LEFT JOIN d USING (key)""")
def entity_profile(spark, d):
    least = legs_lineitem(spark, d).groupBy(F.concat_ws("-", "origin", "dest").alias("key")).agg(F.min("arr_delay").alias("least_delay"))
    return _rates(spark, d).join(least, "key", "left").select(F.col("level").alias("entity_level"), F.col("key").alias("entity_key"), "n", "rate", "avg_delay", "least_delay")


@query(f"WITH {LEGS_LINEITEM} SELECT " + ", ".join(f"quantile_disc({c}, 0.5)::DOUBLE AS median_{c}" for c in ("arr_delay", "dep_delay", "dep_hour", "line")) + " FROM flown")
def typical_leg(spark, d):
    return legs_lineitem(spark, d).agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast("double").alias(f"median_{c}") for c in ("arr_delay", "dep_delay", "dep_hour", "line")])


@query(f"""WITH {RATES_SQL}, r AS (SELECT DISTINCT origin, dest + 20 AS asked FROM flown)
SELECT origin, asked, coalesce(t.rate, round(global_rate, 9)) AS rate, t.key IS NOT NULL AS known FROM r CROSS JOIN globals LEFT JOIN rates t ON t.level = 'airport' AND t.key = CAST(asked AS VARCHAR)""")
def request_lookup(spark, d):
    known = _rates(spark, d)
    asked = legs_lineitem(spark, d).select("origin", (F.col("dest") + 20).alias("asked")).distinct()
    default = rates.global_rate(known, "carrier").select(F.round("global_rate", 9).alias("rate"))
    side = known.where("level = 'airport'").select(F.col("key").alias("_key"), F.col("rate").alias("_rate"))
    out = asked.join(side, F.col("asked").cast("string") == F.col("_key"), "left")
    return out.select("origin", "asked", F.coalesce("_rate", default.scalar()).alias("rate"), F.col("_key").isNotNull().alias("known"))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS obs_id, user_id, ts, value FROM events WHERE event_type <> 'purchase'),
c AS (SELECT l.*, r.obs_id, r.ts AS ts_matched, round(r.value, 6) AS value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.obs_id DESC) AS k FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.ts > l.ts - INTERVAL 3 HOUR)
SELECT event_id, user_id, ts, ts_matched, obs_id, value, value IS NOT NULL AS has_value, CASE WHEN value > 10 THEN 10 ELSE value END AS value_capped FROM c WHERE k = 1""")
def as_of_observation(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type <> 'purchase'").select(F.col("event_id").alias("obs_id"), "user_id", "ts", F.round("value", 6).alias("value"))
    out = as_of(left, right, "user_id", "ts", ["obs_id", "value"], 3 * 3600)
    return out.withColumns({"has_value": F.col("value").isNotNull(), "value_capped": F.when(F.col("value") > 10, 10).otherwise(F.col("value"))})
