"""Marts, roll-ups and dashboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import measures as m
from lathe.plans.adapters import LEGS_LINEITEM, legs_lineitem, table
from lathe.plans.base import query

_MEASURES = """count(*) AS n_flight_legs, count(*) FILTER (cancelled) AS n_cancelled,
  (count(*) FILTER (cancelled))::DOUBLE / count(*) AS cancellation_rate, count(*) FILTER (diverted) AS n_diverted,
  (count(*) FILTER (diverted))::DOUBLE / count(*) AS diversion_rate, count(*) FILTER (del15) AS n_arr_del15,
  (count(*) FILTER (del15))::DOUBLE / nullif(count(del15), 0) AS arr_del15_rate,
  avg(arr_delay) AS avg_arr_delay_minutes, avg(dep_delay) AS avg_dep_delay_minutes,
  quantile_disc(arr_delay, 0.9) AS p90_arr_delay_minutes"""
_ADD = """count(*) AS n_flights, count(del15) AS n_with_arr_outcome, count(dep_delay) AS n_with_dep_outcome,
  count(*) FILTER (del15) AS n_arr_del15, count(*) FILTER (cancelled) AS n_cancelled, count(*) FILTER (diverted) AS n_diverted,
  round(sum(arr_delay), 6) AS sum_arr_delay, round(sum(dep_delay), 6) AS sum_dep_delay"""
_RATES = """round(n_arr_del15::DOUBLE / nullif(n_with_arr_outcome, 0), 9) AS arr_del15_rate,
  round(n_cancelled::DOUBLE / nullif(n_flights, 0), 9) AS cancellation_rate,
  round(n_diverted::DOUBLE / nullif(n_flights, 0), 9) AS diversion_rate,
  round(sum_arr_delay / nullif(n_with_arr_outcome, 0), 9) AS avg_arr_delay,
  round(sum_dep_delay / nullif(n_with_dep_outcome, 0), 9) AS avg_dep_delay"""


def _exact(df):
    return df.withColumns({c: F.round(c, 9) for c in ("cancellation_rate", "diversion_rate", "arr_del15_rate", "avg_arr_delay_minutes", "avg_dep_delay_minutes")})


def _exact_sql(keys: str) -> str:
    return f"""WITH {LEGS_LINEITEM}, g AS (SELECT {keys}, {_MEASURES} FROM flown GROUP BY {keys})
SELECT * REPLACE (round(cancellation_rate, 9) AS cancellation_rate, round(diversion_rate, 9) AS diversion_rate,
  round(arr_del15_rate, 9) AS arr_del15_rate, round(avg_arr_delay_minutes, 9) AS avg_arr_delay_minutes,
  round(avg_dep_delay_minutes, 9) AS avg_dep_delay_minutes) FROM g"""


for _name, _keys in {"measures_by_carrier": ["carrier"], "measures_by_airport": ["origin"], "measures_by_route": ["origin", "dest"]}.items():

    @query(_exact_sql(", ".join(_keys)), _name)
    def _measures(spark, d, keys=tuple(_keys)):
        return _exact(legs_lineitem(spark, d).groupBy(*keys).agg(*m.delay_measures()))


_GRAINS = {
    "mart_schedule": (["month", "weekday", "dep_hour"], "month(service_date) AS month, isodow(service_date) AS weekday, dep_hour"),
    "mart_monthly": (["month_start"], "CAST(date_trunc('month', service_date) AS DATE) AS month_start"),
    "mart_route_carrier": (["origin", "dest", "carrier"], "origin, dest, carrier"),
    "mart_time_slice": (["origin", "carrier", "year", "month", "weekday", "dep_hour"], "origin, carrier, year(service_date) AS year, month(service_date) AS month, isodow(service_date) AS weekday, dep_hour"),
}


def parts(legs):
    day = F.col("service_date")
    return legs.withColumns({"year": F.year(day), "month": F.month(day), "weekday": F.weekday(day) + 1, "month_start": F.trunc(day, "MM")})


for _name, (_keys, _sql) in _GRAINS.items():

    @query(f"WITH {LEGS_LINEITEM} SELECT {_sql}, {_ADD} FROM flown GROUP BY ALL".replace("year(service_date)", "CAST(year(service_date) AS INTEGER)").replace("month(service_date)", "CAST(month(service_date) AS INTEGER)").replace("isodow(service_date)", "CAST(isodow(service_date) AS INTEGER)"), _name)
    def _mart(spark, d, keys=tuple(_keys)):
        return m.additive(parts(legs_lineitem(spark, d)), keys)


@query(f"WITH {LEGS_LINEITEM} SELECT origin, dep_hour, {_ADD} FROM flown WHERE service_date < DATE '1999-01-01' GROUP BY ALL")
def mart_airport_hour_training(spark, d):
    return m.additive(legs_lineitem(spark, d).where("service_date < DATE '1999-01-01'"), ["origin", "dep_hour"])


def _mart_rc(spark, d):
    return m.additive(legs_lineitem(spark, d), ["origin", "dest", "carrier"])


@query(f"WITH {LEGS_LINEITEM}, a AS (SELECT carrier, {_ADD} FROM flown GROUP BY carrier) SELECT *, {_RATES} FROM a")
def rollup_carrier(spark, d):
    return m.rolled_up(_mart_rc(spark, d), ["carrier"])


@query(f"WITH {LEGS_LINEITEM}, a AS (SELECT {_ADD} FROM flown) SELECT *, {_RATES} FROM a")
def scorecard(spark, d):
    return m.rolled_up(_mart_rc(spark, d))


@query(f"WITH {LEGS_LINEITEM}, a AS (SELECT carrier, count(*) AS n_flights FROM flown GROUP BY carrier) SELECT *, round(n_flights::DOUBLE / sum(n_flights) OVER (), 9) AS share FROM a")
def share_by_carrier(spark, d):
    return m.share_of_total(_mart_rc(spark, d).groupBy("carrier").agg(F.sum("n_flights").alias("n_flights")), "n_flights")


@query(f"""WITH {LEGS_LINEITEM}, c AS (
  SELECT carrier, origin || '-' || dest AS route, count(*) AS n, count(*) FILTER (del15) AS a, count(del15) AS d FROM flown GROUP BY ALL),
s AS (SELECT route, sum(a)::DOUBLE / nullif(sum(d), 0) AS r FROM c GROUP BY route),
g AS (SELECT carrier, CAST(sum(n) AS BIGINT) AS n_flights, CAST(sum(a) AS BIGINT) AS actual, CAST(sum(d) AS BIGINT) AS denominator, round(sum(d * r), 6) AS expected FROM c JOIN s USING (route) GROUP BY carrier)
SELECT *, round(actual::DOUBLE / nullif(denominator, 0), 9) AS rate, round(expected / nullif(denominator, 0), 9) AS expected_rate, round(actual / nullif(expected, 0), 9) AS mix_index FROM g""")
def mix_adjusted_carriers(spark, d):
    return m.mix_adjusted(_mart_rc(spark, d).withColumn("route", F.concat_ws("-", "origin", "dest")), "carrier", "route")


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT CAST(year(service_date) AS INTEGER) AS year, count(*) AS n_flights, round(count(*) FILTER (del15)::DOUBLE / nullif(count(del15), 0), 9) AS arr_del15_rate FROM flown GROUP BY 1)
SELECT *, round(arr_del15_rate - lag(arr_del15_rate) OVER (ORDER BY year), 9) AS rate_change FROM a""")
def year_over_year(spark, d):
    return m.year_over_year(m.additive(parts(legs_lineitem(spark, d)), ["year"]), F.col("year"))


@query(f"WITH {LEGS_LINEITEM} SELECT CAST(isodow(service_date) AS INTEGER) AS weekday, " + ", ".join(f"round(count(*) FILTER (del15 AND dep_hour = {h})::DOUBLE / nullif(count(del15) FILTER (dep_hour = {h}), 0), 9) AS dep_hour_{h}" for h in range(24)) + " FROM flown GROUP BY 1")
def weekday_hour_matrix(spark, d):
    return m.rate_matrix(m.additive(parts(legs_lineitem(spark, d)), ["weekday", "dep_hour"]), "weekday", "dep_hour", range(24))


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT carrier, origin, round(count(*) FILTER (del15)::DOUBLE / nullif(count(del15), 0), 9) AS r FROM flown GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY r DESC, origin) AS hi, row_number() OVER (PARTITION BY carrier ORDER BY r, origin) AS lo FROM a)
SELECT carrier, max(origin) FILTER (hi = 1) AS most_origin, max(r) AS most_rate, max(origin) FILTER (lo = 1) AS least_origin, min(r) AS least_rate FROM o GROUP BY carrier""")
def extreme_airports(spark, d):
    rates = m.rolled_up(_mart_rc(spark, d), ["carrier", "origin"]).select("carrier", "origin", F.col("arr_del15_rate").alias("rate"))
    return m.extremes(rates, ["carrier"], "rate", "origin")


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT origin, dest, count(*) AS n_flights, round(count(*) FILTER (del15)::DOUBLE / nullif(count(del15), 0), 9) AS rate FROM flown GROUP BY ALL)
SELECT * FROM a WHERE n_flights >= 20 ORDER BY rate DESC, origin, dest LIMIT 15""")
def worst_routes(spark, d):
    rates = m.rolled_up(_mart_rc(spark, d), ["origin", "dest"]).select("origin", "dest", "n_flights", F.col("arr_del15_rate").alias("rate"))
    return rates.where("n_flights >= 20").orderBy(F.desc("rate"), "origin", "dest").limit(15)


@query(f"""WITH {LEGS_LINEITEM}, r AS (SELECT origin, dest, count(*) AS n, round(count(*) FILTER (del15)::DOUBLE / nullif(count(del15), 0), 9) AS rate FROM flown GROUP BY ALL)
SELECT origin, CAST(sum(n) AS BIGINT) AS n_flights, round(sum(rate * n) / sum(n), 9) AS weighted_rate FROM r GROUP BY origin""")
def weighted_mean_rate(spark, d):
    r = m.rolled_up(_mart_rc(spark, d), ["origin", "dest"])
    return r.groupBy("origin").agg(F.sum("n_flights").alias("n_flights"), F.round(m.rate(F.sum(F.col("arr_del15_rate") * F.col("n_flights")), F.sum("n_flights")), 9).alias("weighted_rate"))


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT CAST(isodow(service_date) AS INTEGER) AS weekday, CASE WHEN month(service_date) IN (12, 1, 2) THEN 'winter' WHEN month(service_date) <= 5 THEN 'spring' WHEN month(service_date) <= 8 THEN 'summer' ELSE 'autumn' END AS season, {_ADD} FROM flown GROUP BY ALL)
SELECT *, {_RATES}, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][weekday] AS weekday_name, CASE season WHEN 'winter' THEN 1 WHEN 'spring' THEN 2 WHEN 'summer' THEN 3 ELSE 4 END AS season_order FROM a""")
def view_delays_by_time(spark, d):
    month = F.col("month")
    season = F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("autumn")
    mart = m.rolled_up(m.additive(parts(legs_lineitem(spark, d)).withColumn("season", season), ["weekday", "season"]), ["weekday", "season"])
    names = F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")))
    return mart.withColumn("weekday_name", F.element_at(names, F.col("weekday"))).withColumn("season_order", F.when(F.col("season") == "winter", 1).when(F.col("season") == "spring", 2).when(F.col("season") == "summer", 3).otherwise(4))


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT origin, dest, carrier, {_ADD} FROM flown GROUP BY ALL)
SELECT a.*, o.n_name AS origin_name, t.n_name AS dest_name FROM a LEFT JOIN nation o ON o.n_nationkey = a.origin LEFT JOIN nation t ON t.n_nationkey = a.dest""")
def view_route_drilldown(spark, d):
    from lathe.operators.joins import role_playing

    return role_playing(_mart_rc(spark, d), table(spark, d, "nation"), "n_nationkey", {"origin": {"n_name": "origin_name"}, "dest": {"n_name": "dest_name"}})


@query(f"""WITH {LEGS_LINEITEM} SELECT carrier, CAST(year(service_date) AS INTEGER) AS year, {_ADD} FROM flown WHERE origin = 3 AND service_date >= DATE '1997-01-01' GROUP BY ALL""")
def filtered_slice(spark, d):
    legs_lineitem(spark, d).createOrReplaceTempView("lathe_legs")
    picked = spark.sql("SELECT *, year(service_date) AS year FROM lathe_legs WHERE origin = :origin AND service_date >= :since", args={"origin": 3, "since": __import__("datetime").date(1997, 1, 1)})
    return m.additive(picked, ["carrier", "year"])


@query(f"""WITH {LEGS_LINEITEM} SELECT coalesce(CAST(carrier AS VARCHAR), 'all') AS carrier, coalesce(CAST(origin AS VARCHAR), 'all') AS origin, {_ADD} FROM flown GROUP BY ROLLUP (carrier, origin)""")
def rollup_levels(spark, d):
    legs = legs_lineitem(spark, d)
    aggregates = m.additive(legs, ["carrier", "origin"])
    out = aggregates.rollup("carrier", "origin").agg(*m._totals())
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("carrier", "origin")})
