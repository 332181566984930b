"""Forecast text and layers: report tokens and ISO 8601 intervals, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions.scalars import KMH_PER_KNOT

_TOKEN_FLAGS = {"had_fog": ("FG", "BR"), "had_rain": ("RA", "DZ"), "had_snow": ("SN", "PL", "SG"), "had_thunder": ("TS",)}


def token_flags(listed: Column) -> dict[str, Column]:
    """Flags of a listed string of weather tokens such as "['-RA', 'VCTS']": signs are ignored, tokens of the vicinity skipped."""
    bare = F.transform(F.filter(F.split(F.regexp_replace(listed, r"[\[\]'\"\s]", ""), ","), lambda t: (t != "") & ~t.startswith("VC")), lambda t: F.regexp_replace(t, r"^[+-]", ""))
    found = lambda parts: F.coalesce(F.exists(bare, lambda t: sum((t.contains(p).cast("int") for p in parts), F.lit(0)) > 0), F.lit(False))
    return {name: found(parts) for name, parts in _TOKEN_FLAGS.items()}


def interval_start(iso: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(iso, r"^([^/+Z]+)", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def interval_hours(iso: Column) -> Column:
    """Hours of the duration of start/PnDTnH; null if there is none."""
    part = lambda p: F.coalesce(F.regexp_extract(iso, p, 1).try_cast("int"), F.lit(0))
    hours = part(r"/P(\d+)D") * 24 + part(r"/P(?:\d+D)?T(\d+)H")
    return F.nullif(hours, F.lit(0))


def covers(iso: Column, at: Column) -> Column:
    """Whether an instant lies in the interval, its start included and its end not."""
    start = interval_start(iso)
    return (at >= start) & (F.unix_seconds(at) < F.unix_seconds(start) + interval_hours(iso) * 3600)


def knots(value: Column, unit: Column) -> Column:
    """Speed in knots of a value in km/h; null for any other unit."""
    return F.when(unit == "km_h-1", value / KMH_PER_KNOT)


# Units that the conversions below hold for, phenomena of each flag, factors, and the visibility that stands for unrestricted.
UNITS = {"temperature": "wmoUnit:degC", "dewpoint": "wmoUnit:degC", "windSpeed": "wmoUnit:km_h-1", "windGust": "wmoUnit:km_h-1", "visibility": "wmoUnit:m", "quantitativePrecipitation": "wmoUnit:mm"}
RAIN, SNOW = ("rain", "drizzle", "rain_showers", "freezing_rain", "freezing_drizzle"), ("snow", "sleet", "ice_pellets", "snow_showers")
METRES_PER_MILE, MM_PER_INCH, CLEAR_MILES = 1609.344, 25.4, 10.0
_LAYER = "struct<uom: string, values: array<struct<validTime: string, value: {}>>>"
#: What is read of a grid's JSON.
GRID = "struct<" + ", ".join(f"{name}: {_LAYER.format('double')}" for name in UNITS) + f", weather: {_LAYER.format('array<struct<weather: string>>')}>"


def duration_seconds(iso: Column) -> Column:
    """Seconds of the duration of start/PnDTnHnM, of any parts; 0 for anything else, so that such an interval holds no instant."""
    form = r"/P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?)?$"
    part = lambda n: F.coalesce(F.regexp_extract(iso, form, n).try_cast("long"), F.lit(0).cast("long"))
    return part(1) * 86400 + part(2) * 3600 + part(3) * 60


def instant_of(iso: Column) -> Column:
    """The start of start/duration with its offset; null for anything else."""
    return F.try_to_timestamp(F.substring_index(iso, "/", 1), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def holds(iso: Column, at: Column) -> Column:
    """Whether an instant lies in start/duration, the start included and the end not."""
    start = instant_of(iso)
    return (at >= start) & (F.unix_micros(at) < F.unix_micros(start) + duration_seconds(iso) * 1_000_000)


def timed(grid: Column) -> Column:
    """A parsed grid (GRID) whose intervals are read: start and end in epoch microseconds and seconds in place of texts, so that instants that are looked up later only compare numbers.

    Intervals that hold no instant, and values that are null, are left out; all others keep their order.
    """
    def layer(name: str) -> Column:
        start = lambda v: F.unix_micros(instant_of(v["validTime"]))
        read = F.transform(grid[name]["values"], lambda v: F.struct(v["value"].alias("value"), start(v).alias("start"), duration_seconds(v["validTime"]).alias("seconds")))
        usable = F.filter(read, lambda v: v["start"].isNotNull() & (v["seconds"] > 0) & v["value"].isNotNull())
        ends = F.transform(usable, lambda v: F.struct(v["value"].alias("value"), v["start"].alias("start"), (v["start"] + v["seconds"] * 1_000_000).alias("end"), v["seconds"].alias("seconds")))
        return F.struct(grid[name]["uom"].alias("uom"), ends.alias("values")).alias(name)

    return F.struct(*map(layer, (*UNITS, "weather")))


def _holding(values: Column, at: Column) -> Column:
    micros = F.unix_micros(at.cast("timestamp"))
    return F.filter(values, lambda v: F.coalesce((v["start"] <= micros) & (micros < v["end"]), F.lit(False)))


def value_at(layer: Column, at: Column, unit: str | None = None) -> Column:
    """struct(value, seconds) of the first value of a timed() layer whose interval holds an instant; null if none does, or if the layer names another unit."""
    first = F.get(_holding(layer["values"], at), F.lit(0))
    known = F.lit(True) if unit is None else F.coalesce(layer["uom"] == unit, F.lit(True))
    return F.when(known & first.isNotNull(), F.struct(first["value"].alias("value"), first["seconds"].alias("seconds")))


def grid_features(grid: Column, at: Column) -> dict[str, Column]:
    """timed_features() of a parsed grid (GRID) whose intervals are still texts."""
    return timed_features(timed(grid), at)


def timed_features(grid: Column, at: Column) -> dict[str, Column]:
    """The weather features of an instant from a timed() grid, by name; all null, and has_weather 0, where it has no temperature then.

    No gust is calm, no visibility unrestricted, and precipitation over some hours is shared out to one.
    """
    met = {name: value_at(grid[name], at, unit) for name, unit in UNITS.items()}
    there = met["temperature"].isNotNull()
    fahrenheit = lambda v: v["value"] * 9 / 5 + 32
    gust, rain = met["windGust"], met["quantitativePrecipitation"]
    now = F.flatten(F.transform(_holding(grid["weather"]["values"], at), lambda v: v["value"]))
    seen = F.coalesce(F.transform(now, lambda c: c["weather"]), F.array().cast("array<string>"))
    named = lambda test: F.coalesce(F.exists(seen, test), F.lit(False)).cast("double")
    found = {
        "temp_f": fahrenheit(met["temperature"]), "dewpoint_f": fahrenheit(met["dewpoint"]), "wind_kn": met["windSpeed"]["value"] / KMH_PER_KNOT,
        "gust_kn": F.coalesce(gust["value"] / KMH_PER_KNOT, F.lit(0.0)), "gust_reported": gust.isNotNull().cast("double"),
        "visibility_mi": F.coalesce(F.least(met["visibility"]["value"] / METRES_PER_MILE, F.lit(CLEAR_MILES)), F.lit(CLEAR_MILES)),
        "precip_1h_in": F.coalesce(rain["value"] / F.greatest(rain["seconds"] / 3600, F.lit(1.0)) / MM_PER_INCH, F.lit(0.0)),
        "had_fog": named(lambda p: p.contains("fog")), "had_rain": named(lambda p: p.isin(*RAIN)), "had_snow": named(lambda p: p.isin(*SNOW)), "had_thunder": named(lambda p: p.contains("thunder")),
    }
    return {name: F.when(there, c) for name, c in found.items()} | {"has_weather": F.coalesce(there, F.lit(False)).cast("double")}
