"""Guards that rebuild what they check, and lookups of unknown size: rotation, nested diffs, slack, gridded forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import weather
from lathe.operators import chain, joins, quality
from lathe.plans.adapters import CUTOFF, LEGS_LINEITEM, legs_events, legs_lineitem, table
from lathe.plans.base import query
from lathe.plans.chain_queries import CHAIN_SQL
from lathe.session import materialise


def rotation_mart(spark, d):
    """Links with the history of their bands and positions; and that history (level, key, n, rate)."""
    linked = chain.link(legs_events(spark, d))
    keys = F.explode(F.array(F.struct(F.lit("band").alias("level"), F.col("band").alias("key")), F.struct(F.lit("position").alias("level"), F.col("position_key").alias("key"))))
    done = linked.withColumn("late", F.when(F.col("event_id") % 8 > 0, F.col("event_id") % 5 < 2)).where("late IS NOT NULL").select("late", keys.alias("k")).where("k.key IS NOT NULL")
    rates = materialise(done.groupBy("k.level", "k.key").agg(F.count("*").alias("n"), F.round(F.avg(F.col("late").cast("int")), 9).alias("rate")), "rotation-rates")
    mart = linked
    for level, key in (("band", "band"), ("position", "position_key")):
        side = rates.where(F.col("level") == level).select(F.col("key").alias("_key"), F.col("n").alias(f"{level}_n"), F.col("rate").alias(f"{level}_rate"))
        mart = mart.join(side, F.col(key) == F.col("_key"), "left").drop("_key")
    return mart, rates


#: What each planted fault does to a mart, by event_id mod 101: column, fault, where; the same in SQL.
FAULTS = {
    1: ("turnaround_min", "turnaround_min + 1", "true"), 2: ("inbound_distance", "inbound_distance + 1", "true"), 3: ("density", "density + 1", "true"), 4: ("has_inbound_leg", "NOT has_inbound_leg", "true"), 5: ("rotation_position", "CAST(9 AS BIGINT)", "link_class = 'c'"),
    6: ("band_rate", "NULL", "true"), 7: ("density", "NULL", "true"), 8: ("slack_min", "CAST(5 AS BIGINT)", "link_class = 'b'"), 9: ("band_rate", "band_rate + 0.5", "true"), 10: ("position_n", "position_n + 1", "true"), 11: ("band_n", "CAST(0 AS BIGINT)", "band = 'ge_120'"),
    12: ("position_n", "CAST(0 AS BIGINT)", "position_key = '3'"), 13: ("legs_today", "CAST(1 AS BIGINT)", "link_class = 'c'"),
}


def planted(mart, faults):
    """mart with faults in place, each in the rows of its remainder; unknown tails get one where event_id is even."""
    new = {c: F.col(c) for c in mart.columns}
    for k, (column, fault, where) in faults.items():
        new[column] = F.when(F.expr(f"event_id % 101 = {k} AND {where}"), F.expr(fault)).otherwise(new[column])
    return mart.select(*[c.alias(n) for n, c in new.items()])


def _sql_planted():
    columns: dict[str, str] = {}
    for k, (column, fault, where) in FAULTS.items():
        columns[column] = columns.get(column, "") + f" WHEN event_id % 101 = {k} AND {where} THEN {fault}"
    return ", ".join(f"CASE{whens} ELSE {c} END AS {c}" for c, whens in columns.items())


_HISTORY = ("band_n", "band_rate", "position_n", "position_rate")
_LINKS = ("rotation_position", "legs_today", "turnaround_min", "slack_min", "is_tight", "inbound_distance", "inbound_elapsed_min")
_SOME = lambda columns, test: "(" + " OR ".join(f"m.{c} {test}" for c in columns) + ")"
ROTATION_GUARD_SQL = f"""WITH {CHAIN_SQL},
done AS (SELECT band, position_key, event_id % 5 < 2 AS late FROM chain WHERE event_id % 8 > 0),
rates AS (SELECT 'band' AS level, band AS key, count(*) AS n, round(avg(CAST(late AS INT)), 9) AS rate FROM done WHERE band IS NOT NULL GROUP BY band
  UNION ALL SELECT 'position', position_key, count(*), round(avg(CAST(late AS INT)), 9) FROM done WHERE position_key IS NOT NULL GROUP BY position_key),
mart AS (SELECT c.*, b.n AS band_n, b.rate AS band_rate, p.n AS position_n, p.rate AS position_rate FROM chain c LEFT JOIN rates b ON b.level = 'band' AND b.key = c.band LEFT JOIN rates p ON p.level = 'position' AND p.key = c.position_key),
m AS (SELECT * REPLACE ({_sql_planted()}) FROM mart),
j AS (SELECT c.tail AS t, c.link_class AS kind, c.turnaround_min AS gap, t.pdist, t.pel, t.pos, t.n AS day_legs, c.density AS e_density, m.*
  FROM m JOIN chain c USING (event_id) LEFT JOIN classed t USING (event_id)),
v AS (
  SELECT 'turnaround_mismatch' AS violation FROM j m WHERE t IS NOT NULL AND turnaround_min IS DISTINCT FROM gap
  UNION ALL SELECT 'inbound_attr_mismatch' FROM j m WHERE t IS NOT NULL AND has_inbound_leg AND (inbound_distance IS DISTINCT FROM pdist OR inbound_elapsed_min IS DISTINCT FROM pel OR slack_min IS DISTINCT FROM gap - 35 OR is_tight IS DISTINCT FROM (gap < 35))
  UNION ALL SELECT 'position_or_day_mismatch' FROM j m WHERE density IS DISTINCT FROM e_density OR (kind <> 'c' AND (rotation_position IS DISTINCT FROM pos OR legs_today IS DISTINCT FROM day_legs))
  UNION ALL SELECT 'flag_mismatch' FROM j m WHERE t IS NOT NULL AND has_inbound_leg IS DISTINCT FROM CASE kind WHEN 'a' THEN true WHEN 'b' THEN false END
  UNION ALL SELECT 'swap_shaped_not_nulled' FROM j m WHERE t IS NOT NULL AND kind = 'c' AND {_SOME((*_LINKS, *_HISTORY), "IS NOT NULL")}
  UNION ALL SELECT 'clean_link_hist_missing' FROM j m WHERE kind <> 'c' AND {_SOME(_HISTORY, "IS NULL")}
  UNION ALL SELECT 'rotation_join_miss' FROM j m WHERE density IS NULL
  UNION ALL SELECT 'inbound_attrs_without_inbound' FROM j m WHERE kind = 'b' AND ({_SOME(("turnaround_min", "slack_min", "inbound_distance", "inbound_elapsed_min"), "IS NOT NULL")} OR is_tight IS DISTINCT FROM false OR rotation_position IS NULL OR legs_today IS NULL)
  UNION ALL SELECT 'tail_null_not_nulled' FROM j m WHERE t IS NULL AND {_SOME((*_LINKS, "has_inbound_leg", *_HISTORY), "IS NOT NULL")}
  UNION ALL SELECT 'hist_not_constant_within_band' FROM j WHERE kind <> 'c' GROUP BY CASE WHEN kind = 'b' THEN 'no_inbound' WHEN gap < 35 THEN 'lt_35' WHEN gap < 60 THEN '35_60' WHEN gap < 120 THEN '60_120' ELSE 'ge_120' END HAVING count(DISTINCT band_rate) > 1 OR count(DISTINCT band_n) > 1
  UNION ALL SELECT 'hist_not_constant_within_position' FROM j WHERE kind <> 'c' GROUP BY least(pos, 6) HAVING count(DISTINCT position_rate) > 1 OR count(DISTINCT position_n) > 1
  UNION ALL SELECT 'band_hist_relabelled' FROM (SELECT CASE WHEN kind = 'b' THEN 'no_inbound' WHEN gap < 35 THEN 'lt_35' WHEN gap < 60 THEN '35_60' WHEN gap < 120 THEN '60_120' ELSE 'ge_120' END AS key, min(band_n) AS low FROM j WHERE kind <> 'c' GROUP BY 1) JOIN rates r USING (key) WHERE level = 'band' AND low IS DISTINCT FROM r.n
  UNION ALL SELECT 'position_hist_relabelled' FROM (SELECT CAST(least(pos, 6) AS VARCHAR) AS key, min(position_n) AS low FROM j WHERE kind <> 'c' GROUP BY 1) JOIN rates r USING (key) WHERE level = 'position' AND low IS DISTINCT FROM r.n)
SELECT violation, count(*) AS rows FROM v GROUP BY 1"""


@query(ROTATION_GUARD_SQL)
def check_rotation_rebuilt(spark, d):
    """A mart with a fault of each kind planted in it, against a chain that is rebuilt without the mart's windows."""
    mart, rates = rotation_mart(spark, d)
    return quality.counts_of(chain.link_violations(planted(mart, FAULTS), chain.rebuilt(legs_events(spark, d)), rates))


_SLACK = "((l_orderkey * 7 + l_linenumber * 13) % 150)"


@query(f"""WITH {LEGS_LINEITEM}, held AS (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS band, arr_delay FROM flown WHERE arr_delay IS NOT NULL AND service_date >= DATE '{CUTOFF}'),
steps AS (SELECT band, t, round(count(*) FILTER (arr_delay >= t)::DOUBLE / count(*), 9) AS risk FROM held, (VALUES (5), (15), (30), (45)) v(t) WHERE band < 9 GROUP BY ALL),
asked AS (SELECT flight_number, line, least(CAST(floor(p * 10) AS BIGINT), 9) AS band, (flight_number * 7 + line * 13) % 150 - 45 AS slack FROM flown),
met AS (SELECT a.*, coalesce((SELECT max(t) FROM steps s WHERE s.band = a.band AND t <= slack), (SELECT min(t) FROM steps s WHERE s.band = a.band)) AS t FROM asked a)
SELECT flight_number, line, slack, t, risk, CASE WHEN t IS NULL THEN 'no history' WHEN slack <= 0 THEN 'inside' WHEN slack < t THEN 'lower bound' WHEN slack = t THEN 'exact' WHEN t = 45 THEN 'upper bound' ELSE 'overstated' END AS reading
FROM met LEFT JOIN steps s USING (band, t)""")
def connection_risk(spark, d):
    """Of each leg as the first of a connection, how likely it eats the slack: read at the largest measured threshold not above the slack."""
    legs = legs_lineitem(spark, d).withColumn("band", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long"))
    held = legs.where(F.col("arr_delay").isNotNull() & (F.col("service_date") >= F.lit(CUTOFF).cast("date")) & (F.col("band") < 9)).select("band", "arr_delay", F.explode(F.array(*map(F.lit, (5, 15, 30, 45)))).alias("t"))
    steps = held.groupBy("band", F.col("t").cast("long").alias("t")).agg(F.round(F.count_if(F.col("arr_delay") >= F.col("t")) / F.count("*"), 9).alias("risk"))
    asked = legs.select("flight_number", "line", "band", ((F.col("flight_number") * 7 + F.col("line") * 13) % 150 - 45).alias("slack"))
    met = joins.at_or_below(asked, materialise(steps, "exceedance"), ["band"], "slack", "t", ["risk"], 10.0)
    reading = F.when(F.col("t").isNull(), "no history").when(F.col("slack") <= 0, "inside")
    for place, name in (("below", "lower bound"), ("at", "exact"), ("above", "upper bound"), ("between", "overstated")):
        reading = reading.when(F.col("place") == place, name)
    return met.select("flight_number", "line", "slack", "t", "risk", reading.alias("reading"))


@query("""WITH e AS (SELECT event_id, event_id % 7 = 0 AS note_differs, event_id % 11 = 0 AS longer, event_id % 13 = 0 AS nan_differs, event_id % 17 = 0 AS key_missing, event_id % 19 = 0 AS gone, event_id % 3 AS z, event_id % 5 AS v FROM events),
d AS (
  SELECT event_id, 'trip.legs.length' AS path, '2' AS left, '3' AS right FROM e WHERE longer
  UNION ALL SELECT event_id, 'trip.legs[1].note', 'n' || v, CASE WHEN z = 0 THEN NULL ELSE 'other' END FROM e WHERE note_differs AND NOT longer
  UNION ALL SELECT event_id, 'rates.b', 'NaN', '0.5' FROM e WHERE nan_differs AND NOT key_missing
  UNION ALL SELECT event_id, 'rates.b', 'NaN', NULL FROM e WHERE key_missing)
SELECT d.* FROM d JOIN e USING (event_id) WHERE NOT gone UNION ALL SELECT event_id, '', 'row', NULL FROM e WHERE gone""")
def check_nested_parity(spark, d):
    """Two captures of nested answers, the second with faults at known places."""
    i = F.col("event_id")

    def capture(after):
        note = F.concat(F.lit("n"), (i % 5).cast("string"))
        changed = F.when(i % 7 == 0, F.when(i % 3 != 0, "other")).otherwise(note) if after else note
        leg = lambda at, text: F.struct(F.lit(at).alias("at"), text.alias("note"))
        two = F.array(leg(0, note), leg(1, changed))
        legs = F.when(i % 11 == 0, F.array(leg(0, note), leg(1, note), leg(2, note))).otherwise(two) if after else two
        b = F.when(i % 13 == 0, 0.5).otherwise(float("nan")) if after else F.lit(float("nan"))
        rates = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), b)
        rates = F.when(i % 17 == 0, F.create_map(F.lit("a"), F.lit(1.0))).otherwise(rates) if after else rates
        rows = table(spark, d, "events").select("event_id", F.struct(legs.alias("legs"), F.col("event_type").alias("kind")).alias("trip"), rates.alias("rates"))
        return rows.where(i % 19 != 0) if after else rows

    return quality.nested_differences(capture(False), capture(True), ["event_id"])


_PHENOMENA = ("fog", "rain_showers", "snow", "thunderstorms", "freezing_fog", "drizzle", None)
_NAMES = tuple(weather.UNITS)
_SPANS = ("PT6H", "PT1H30M", "P1D", "PT45M", "P1W")
_GRID_SQL = "\n".join(f"{n} AS (SELECT event_id, min_by(v, src) FILTER (v IS NOT NULL) AS v, min_by(secs, src) FILTER (v IS NOT NULL) AS secs FROM met WHERE layer = {k} AND good GROUP BY 1)," for k, n in enumerate(_NAMES))


@query(f"""WITH parts AS (SELECT event_id AS src, user_id, date_trunc('hour', ts) AS start, event_id % 6 AS layer, CASE WHEN event_id % 19 > 0 THEN value END AS v, event_id % 4 = 0 AS told,
  CASE event_id % 7 WHEN 0 THEN 'fog' WHEN 1 THEN 'rain_showers' WHEN 2 THEN 'snow' WHEN 3 THEN 'thunderstorms' WHEN 4 THEN 'freezing_fog' WHEN 5 THEN 'drizzle' END AS phenomenon,
  CASE event_id % 5 WHEN 0 THEN 21600 WHEN 1 THEN 5400 WHEN 2 THEN 86400 WHEN 3 THEN 2700 ELSE 0 END AS secs, NOT (event_id % 6 = 2 AND user_id % 5 = 0) AS good FROM events),
met AS (SELECT e.event_id, p.* FROM events e JOIN parts p ON e.user_id = p.user_id AND e.ts >= p.start AND e.ts < p.start + p.secs * INTERVAL 1 SECOND),
{_GRID_SQL}
phen AS (SELECT event_id, bool_or(phenomenon LIKE '%fog%') AS fog, bool_or(phenomenon IN ('rain_showers', 'drizzle')) AS rain, bool_or(phenomenon = 'snow') AS snow, bool_or(phenomenon LIKE '%thunder%') AS thunder FROM met WHERE told AND phenomenon IS NOT NULL GROUP BY 1),
f AS (SELECT e.event_id, t.v IS NOT NULL AS ok, t.v AS temp, dw.v AS dew, w.v AS wind, g.v AS gust, vi.v AS vis, q.v AS mm, q.secs, coalesce(fog, false) AS fog, coalesce(rain, false) AS rain, coalesce(snow, false) AS snow, coalesce(thunder, false) AS thunder
  FROM events e LEFT JOIN temperature t USING (event_id) LEFT JOIN dewpoint dw USING (event_id) LEFT JOIN windSpeed w USING (event_id) LEFT JOIN windGust g USING (event_id) LEFT JOIN visibility vi USING (event_id) LEFT JOIN quantitativePrecipitation q USING (event_id) LEFT JOIN phen USING (event_id))
SELECT event_id, CASE WHEN ok THEN round(temp * 9 / 5 + 32, 6) END AS temp_f, CASE WHEN ok THEN round(dew * 9 / 5 + 32, 6) END AS dewpoint_f, CASE WHEN ok THEN round(wind / 1.852::DOUBLE, 6) END AS wind_kn, CASE WHEN ok THEN round(coalesce(gust / 1.852::DOUBLE, 0), 6) END AS gust_kn,
  CASE WHEN ok THEN CAST(gust IS NOT NULL AS DOUBLE) END AS gust_reported, CASE WHEN ok THEN round(coalesce(least(vis / 1609.344::DOUBLE, 10), 10), 6) END AS visibility_mi, CASE WHEN ok THEN round(coalesce(mm / greatest(secs / 3600.0::DOUBLE, 1) / 25.4::DOUBLE, 0), 6) END AS precip_1h_in,
  CASE WHEN ok THEN CAST(fog AS DOUBLE) END AS had_fog, CASE WHEN ok THEN CAST(rain AS DOUBLE) END AS had_rain, CASE WHEN ok THEN CAST(snow AS DOUBLE) END AS had_snow, CASE WHEN ok THEN CAST(thunder AS DOUBLE) END AS had_thunder, CAST(ok AS DOUBLE) AS has_weather
FROM f""")
def gridded_weather(spark, d):
    """Every event's weather from the JSON grid of its user: six layers with units, minutes and days, and phenomena, the first value whose interval holds the instant."""
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), "value")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    valid = F.concat(F.date_format(F.date_trunc("hour", "at"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00/"), pick(_SPANS, 5))
    value = F.when(i % 19 > 0, F.col("value"))
    parts = e.select("user_id", "event_id", valid.alias("validTime"), value.alias("value"), (i % 6).alias("layer"), F.when(i % 4 == 0, F.array(F.struct(pick(_PHENOMENA, 7).alias("weather")))).alias("told"))
    cells = lambda which, what: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("event_id", "validTime", what.alias("value"))))), lambda v: F.struct(v["validTime"].alias("validTime"), v["value"].alias("value")))
    unit = lambda name: F.when((F.col("user_id") % 5 == 0) & F.lit(name == "windSpeed"), "wmoUnit:m_s-1").otherwise(weather.UNITS[name]).alias("uom")
    layers = [F.struct(unit(n), cells(F.col("layer") == k, F.col("value")).alias("values")).alias(n) for k, n in enumerate(_NAMES)]
    grids = parts.groupBy("user_id").agg(F.to_json(F.struct(*layers, F.struct(cells(F.col("told").isNotNull(), F.col("told")).alias("values")).alias("weather"))).alias("grid"))
    parsed = materialise(grids.select("user_id", weather.timed(F.from_json("grid", weather.GRID)).alias("grid")), "grids")
    found = weather.timed_features(F.col("grid"), F.col("at"))
    whole = ("gust_reported", "had_fog", "had_rain", "had_snow", "had_thunder", "has_weather")
    return e.join(parsed, "user_id", "left").select("event_id", *[(c if n in whole else F.round(c, 6)).alias(n) for n, c in found.items()])
