"""The whole feature row of a leg: history, weather as of departure, holidays, rotation and density, and its guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators import chain, quality
from lathe.operators.joins import as_of
from lathe.operators.rates import global_rate, level_rates, with_level
from lathe.session import materialise

# Seconds that an observation may be old, and the visibility that is told apart at most.
WEATHER_AGE, MOST_VISIBILITY = 3 * 3600, 10.0
#: Readings of an observation; gust is calm where an observation has none.
READINGS = ("temp_f", "wind_kn", "gust_kn", "gust_reported", "visibility_mi", "precip_in", "had_fog", "had_rain")
HISTORY = {"route": "route", "carrier": "carrier", "origin": "airport", "dest": "airport", "band": "band", "position": "position"}


def holidays_padded(days: DataFrame, day: str, is_holiday: Column) -> DataFrame:
    """day, is_holiday, is_day_before, is_day_after for the holidays of a table of days and the days next to them: one row a day, also outside of the table."""
    held = days.where(is_holiday).select(F.explode(F.expr(f"array(struct({day} AS {day}, 0 AS step), struct(date_add({day}, -1) AS {day}, -1 AS step), struct(date_add({day}, 1) AS {day}, 1 AS step))")).alias("h")).select("h.*")
    flags = {"is_holiday": 0, "is_day_before": -1, "is_day_after": 1}
    return held.groupBy(day).agg(*[F.bool_or(F.col("step") == step).alias(name) for name, step in flags.items()])


def assemble(legs: DataFrame, observations: DataFrame, stations: DataFrame, holidays: DataFrame, cutoff: str, order: Sequence[str] = ("dep_ts", "event_id")) -> DataFrame:
    """A row for each completed leg (del15 known): its columns, smoothed history by six levels, weather, holiday flags, rotation, density and is_training_row.

    legs: what chain.link() takes, with cancelled, del15 and arr_delay; links and densities are found among all of them, also those that weren't flown. History is fitted on completed legs before cutoff, the
    destination from the level of origins. observations: station, ts and READINGS; stations: airport to station, one each; the latest observation of the origin's station counts, if younger than WEATHER_AGE.
    holidays: holidays_padded(). Sides that are one row a level, an airport or a day are left to the planner to broadcast by their written size; legs are shuffled for density, chain and weather.
    """
    linked = chain.link(legs, order).withColumn("route", F.concat_ws("-", "origin", "dest"))
    completed = materialise(linked.where(~F.col("cancelled") & F.col("del15").isNotNull()), "mart-legs")
    levels = {"route": F.col("route"), "carrier": F.col("carrier"), "airport": F.col("origin"), "band": F.col("band"), "position": F.col("position_key")}
    rates = materialise(level_rates(completed, levels, cutoff), "mart-rates")
    prior = global_rate(rates, "carrier")
    fact = completed.withColumns({c: prior.select(c).scalar() for c in ("global_rate", "global_delay")})
    keys = {"route": "route", "carrier": "carrier", "origin": "origin", "dest": "dest", "band": "band", "position": "position_key"}
    for prefix, level in HISTORY.items():
        fact = with_level(fact, rates, level, F.col(keys[prefix]), f"hist_{prefix}")
    side = stations.select(F.col("airport").alias("_airport"), F.col("station"))
    met = as_of(fact.join(side, F.col("origin") == F.col("_airport"), "left").withColumn("ts", F.col("dep_ts")), observations, "station", "ts", READINGS, WEATHER_AGE)
    there = F.col("ts_matched").isNotNull()
    weather = {"gust_kn": F.when(there, F.coalesce("gust_kn", F.lit(0.0))), "visibility_mi": F.when(F.col("visibility_mi").isNotNull(), F.least("visibility_mi", F.lit(MOST_VISIBILITY))), "has_origin_weather": there}
    days = holidays.withColumnRenamed("day", "_day")
    out = met.withColumns(weather).join(days, F.col("service_date") == F.col("_day"), "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_holiday", "is_day_before", "is_day_after")}
    calendar = {"dep_hour": F.hour(F.col("dep_ts").cast("timestamp")), "weekday": F.weekday("service_date") + 1, "month": F.month("service_date")}
    out = out.withColumns({**flags, **calendar, "is_training_row": F.col("service_date") < F.lit(cutoff).cast("date"), "observed_ts": F.col("ts_matched")})
    return out.drop("global_rate", "global_delay", "_airport", "_day", "station", "ts", "ts_matched", "cancelled")


def mart_rules(cutoff: str) -> Mapping[str, Column]:
    """What holds for each row of assemble(), by name; null counts as broken."""
    known = F.col("has_origin_weather")
    blank = lambda columns: ~F.greatest(*[F.col(c).isNotNull() for c in columns])
    return {
        "observed_before_departure": ~known | ((F.col("observed_ts") <= F.col("dep_ts")) & (F.unix_micros(F.col("observed_ts").cast("timestamp")) > F.unix_micros(F.col("dep_ts").cast("timestamp")) - WEATHER_AGE * 1_000_000)),
        "weather_all_or_none": F.when(known, F.col("gust_kn").isNotNull()).otherwise(blank(READINGS)),
        "visibility_capped": F.coalesce(F.col("visibility_mi") <= MOST_VISIBILITY, F.lit(True)),
        "one_holiday_flag": F.col("is_holiday").cast("int") + F.col("is_day_before").cast("int") + F.col("is_day_after").cast("int") <= 2,
        "history_of_links_only": (F.col("link_class") != "c") | blank(("hist_band_n", "hist_position_n", "rotation_position", "turnaround_min")),
        "training_by_date": F.col("is_training_row") == (F.col("service_date") < F.lit(cutoff).cast("date")),
        "shares": F.coalesce(F.col("hist_carrier_rate").between(0, 1), F.lit(True)) & F.coalesce(F.col("hist_route_rate").between(0, 1), F.lit(True)),
    }


def mart_violations(mart: DataFrame, cutoff: str, row: str = "event_id") -> DataFrame:
    """(row, violation) for every rule of mart_rules() that a row breaks."""
    return quality.labelled(mart, mart_rules(cutoff), [row])
