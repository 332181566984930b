"""From raw strings to typed, deduplicated and decoded rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.functions import scalars as s
from lathe.session import materialise

#: How a raw string column becomes a typed one, by the name of the kind.
KINDS = {
    "text": s.cleaned, "code": s.code, "whole": s.whole, "flag": s.flag, "clock": s.clock_minutes,
    "number": lambda c: s.cleaned(c).try_cast("double"),
    "date": lambda c: s.cleaned(c).try_cast("date"),
}
# Ranges of the present-weather codes, manned and automatic.
WEATHER = {
    "had_fog": (((40, 49), (10, 12)), ((10, 10), (30, 35))),
    "had_rain_drizzle": (((50, 69), (80, 84)), ((40, 44), (47, 48), (50, 58), (60, 68), (80, 84))),
    "had_snow_ice_pellets": (((68, 79), (83, 88)), ((45, 46), (67, 68), (70, 78), (85, 87))),
    "had_thunder": (((17, 17), (95, 99)), ((90, 96),)),
}
REPORTS = ("FM-15", "FM-16", "FM-12")


def typed(raw: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """{name: (raw column, kind)} of KINDS as one projection."""
    return raw.select(*[KINDS[kind](F.col(source)).alias(name) for name, (source, kind) in columns.items()])


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    turn = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def observations(raw: DataFrame) -> DataFrame:
    """Packed hourly observations (station_id, obs_ts, report_type, TMP, DEW, WND, VIS, OC1, precip and codes as arrays) decoded.

    Of several reports of a station and time the one of the best type stays, then the first by its raw fields. Precipitation of one
    hour is 0 without any group and null if no group can be used. A quality code that is missing keeps a value but drops a group.
    """
    tenths = lambda c: c / 10
    bad = lambda c, i: ~s.part(c, i).isin(*s.BAD_QUALITY)
    codes = lambda column: F.transform(F.filter(column, lambda c: F.coalesce(bad(c, 1), F.lit(False))), lambda c: s.part(c, 0).try_cast("bigint"))
    groups = F.filter("precip", lambda g: g.isNotNull())
    hourly = F.filter(groups, lambda g: F.coalesce(bad(g, 3) & (s.part(g, 1).try_cast("bigint") != 9999) & (s.part(g, 0) == "01"), F.lit(False)))
    rain = F.array_min(F.transform(hourly, lambda g: s.part(g, 1).try_cast("bigint")))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REPORTS)), F.col("report_type")), F.lit(0)), F.lit(len(REPORTS) + 1))
    once = first_of(raw, ["station_id", "obs_ts"], [rank, F.col("report_type").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ("TMP", "DEW", "WND", "VIS", "OC1")]])
    gust = tenths(s.decoded(F.col("OC1"), 0, 1, 9999)) * s.KNOTS_PER_MS
    values = {
        "temp_f": tenths(s.decoded(F.col("TMP"), 0, 1, 9999)) * 9 / 5 + 32, "dewpoint_f": tenths(s.decoded(F.col("DEW"), 0, 1, 9999)) * 9 / 5 + 32,
        "wind_speed_kn": tenths(s.decoded(F.col("WND"), 3, 4, 9999)) * s.KNOTS_PER_MS, "visibility_mi": s.decoded(F.col("VIS"), 0, 1, 999999) / s.METRES_PER_MILE,
        "gust_kn": gust, "precip_1h_in": F.when(F.size(F.coalesce(groups, F.array().cast("array<string>"))) == 0, 0.0).otherwise(rain / 10 / s.MM_PER_INCH),
    }
    flags = {name: s.any_in(codes(F.col("manned")), manned) | s.any_in(codes(F.col("automatic")), automatic) for name, (manned, automatic) in WEATHER.items()}
    return once.select("station_id", "obs_ts", "report_type", *[F.round(c, 4).alias(n) for n, c in values.items()], gust.isNotNull().alias("gust_reported"), *[c.alias(n) for n, c in flags.items()])


def harmonised(df: DataFrame, hidden: Sequence[str], limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """df in a poorer source's vocabulary: hidden columns null, and for {column: (limit, value)} what is above the limit becomes the value; NaN stays."""
    types = {f.name: f.dataType for f in df.schema}
    above = {c: F.when(~F.isnan(c) & (F.col(c) > limit), value).otherwise(F.col(c)) for c, (limit, value) in limits.items()}
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in hidden} | above)


def allowed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that df has, in the order of the names; all others are left out."""
    return df.select(*[n for n in names if n in df.columns])


def smallest_digests(df: DataFrame, group: str, digest: str, n: int, head: int = 3) -> DataFrame:
    """Of each group the distinct rows with the n smallest digests (hex text; a row without one takes no part).

    Each first `head` digits that occur stand for a row at least, so the n smallest that occur hold all that is wanted: only rows with those are made distinct and sorted, a
    share of n / 16 ** head of a large group's. What is gathered before that is a row for each group and head.
    """
    first = F.substring(digest, 1, head)
    order = W.Window.partitionBy(group).orderBy("_head")
    heads = df.select(group, first.alias("_head")).distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    highest = materialise(heads.groupBy(F.col(group).alias("_group")).agg(F.max("_head").alias("_most")), "heads")
    low = df.join(highest, F.col(group).eqNullSafe(F.col("_group")) & (first <= F.col("_most"))).drop("_group", "_most").distinct()
    return low.withColumn("_k", F.row_number().over(W.Window.partitionBy(group).orderBy(digest))).where(F.col("_k") <= n).drop("_k")
