"""Chains of legs of one vehicle, linked by schedule alone, and what hangs on the later legs of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.session import materialise

# Longest gap in minutes that is a turnaround and not a night; edges and names of the bands; shortest usual turnaround; last position told apart.
DUTY_MIN, EDGES, TIGHT_MIN, MOST_POSITION = 840, (35, 60, 120), 35, 6
BANDS = ("no_inbound", "lt_35", "35_60", "60_120", "ge_120")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, truncated toward zero."""
    return F.timestamp_diff("MINUTE", earlier, later)


def turnaround_band(minutes: Column) -> Column:
    """The band of a turnaround; null is no inbound leg."""
    low, mid, high = EDGES
    return F.when(minutes.isNull(), BANDS[0]).when(minutes < low, BANDS[1]).when(minutes < mid, BANDS[2]).when(minutes < high, BANDS[3]).otherwise(BANDS[4])


def link(legs: DataFrame, order: Sequence[str] = ("dep_ts", "event_id"), carrier_resets: bool = False) -> DataFrame:
    """legs (tail, service_date, origin, dest, dep_ts, elapsed_min, distance, carrier) with link_class and what it allows to know.

    Class b: no leg before, or one that ended here over DUTY_MIN minutes ago. a: one that ended here up to DUTY_MIN minutes ago. c: any other
    link (overlap, another station, a predecessor that itself overlaps, unknown arrival) and unknown tails: the
    chain was changed on the day, so all that comes from it is null. density counts departures of the origin, day and hour over all
    legs, before tails are looked at. With carrier_resets a change of carrier starts a new chain.

    One shuffle by origin, day and hour and one by tail: the windows by tail, and by tail and day, share it. A vehicle's legs are bounded
    by what it can fly; legs without a tail skip the windows, so the null key never gathers in a task.
    """
    hour = F.hour(F.col("dep_ts").cast("timestamp"))
    dense = legs.withColumn("density", F.count("*").over(W.Window.partitionBy("origin", "service_date", hour)))
    known, unknown = dense.where("tail IS NOT NULL"), dense.where("tail IS NULL")
    chain = W.Window.partitionBy("tail").orderBy(*order)
    if carrier_resets:
        starts = F.when(F.lag("carrier").over(chain) != F.col("carrier"), 1).otherwise(0)
        known = known.withColumn("_run", starts).withColumn("_run", F.sum("_run").over(chain))
        chain = W.Window.partitionBy("tail", "_run").orderBy(*order)
    day = W.Window.partitionBy("tail", "service_date")
    arrival = F.timestamp_add("MINUTE", F.round("elapsed_min").cast("int"), F.col("dep_ts"))
    linked = known.withColumns(
        {
            "_arr": F.lag(arrival).over(chain), "_dest": F.lag("dest").over(chain), "_distance": F.lag("distance").over(chain), "_elapsed": F.lag("elapsed_min").over(chain),
            "_position": F.row_number().over(day.orderBy(*order)).cast("long"), "_legs": F.count("*").over(day),
        }
    ).withColumn("_gap", minutes_between(F.col("dep_ts"), F.col("_arr")))
    linked = linked.withColumn("_tainted", F.coalesce(F.lag(F.col("_gap") < 0).over(chain), F.lit(False)))
    usable = (F.col("_dest") == F.col("origin")) & ~F.col("_tainted")
    kind = F.when(F.col("_dest").isNull(), "b").when(usable & F.col("_gap").between(0, DUTY_MIN), "a").when(usable & (F.col("_gap") > DUTY_MIN), "b").otherwise("c")
    classed = linked.withColumn("link_class", kind).unionByName(unknown.withColumn("link_class", F.lit("c")), allowMissingColumns=True)
    linkable, inbound = F.col("link_class") != "c", F.col("link_class") == "a"
    turnaround = F.when(inbound, F.col("_gap"))
    return classed.select(
        *legs.columns, "density", "link_class",
        F.when(linkable, F.col("_position")).alias("rotation_position"), F.when(linkable, F.col("_legs")).alias("legs_today"), F.when(linkable, inbound).alias("has_inbound_leg"),
        turnaround.alias("turnaround_min"), (turnaround - TIGHT_MIN).alias("slack_min"), F.when(linkable, F.coalesce(turnaround < TIGHT_MIN, F.lit(False))).alias("is_tight"),
        F.when(inbound, F.col("_distance")).alias("inbound_distance"), F.when(inbound, F.col("_elapsed")).alias("inbound_elapsed_min"),
        F.when(linkable, turnaround_band(turnaround)).alias("band"),
        F.when(linkable, F.when(F.col("_position") > MOST_POSITION, MOST_POSITION).otherwise(F.col("_position")).cast("string")).alias("position_key"),
    )


def exposure(legs: DataFrame, weight: Column, order: Sequence[str] = ("dep_ts", "event_id")) -> DataFrame:
    """legs with what follows on the same tail and day: later_legs, later_weight (known weights only) and later_unknown."""
    later = W.Window.partitionBy("tail", "service_date").orderBy(*order).rowsBetween(1, W.Window.unboundedFollowing)
    named, unnamed = legs.withColumn("_w", weight).where("tail IS NOT NULL"), legs.where("tail IS NULL")
    out = named.withColumns({"later_legs": F.count("*").over(later), "later_weight": F.coalesce(F.sum("_w").over(later), F.lit(0)), "later_unknown": F.coalesce(F.sum(F.col("_w").isNull().cast("int")).over(later), F.lit(0))}).drop("_w")
    return out.unionByName(unnamed.withColumns({"later_legs": F.lit(0), "later_weight": F.lit(0), "later_unknown": F.lit(0)}), allowMissingColumns=True)


def seams(legs: DataFrame, arrival_order: str, ts: str = "dep_ts", row: str = "event_id") -> DataFrame:
    """Legs that come, in order of arrival (of equals by row, which is unique), no later than their tail's leg before them."""
    w = W.Window.partitionBy("tail").orderBy(arrival_order, row)
    return legs.where("tail IS NOT NULL").withColumn("_before", F.lag(ts).over(w)).where(F.col(ts) <= F.col("_before")).drop("_before")


def rebuilt(legs: DataFrame, row: str = "event_id", ts: str = "dep_ts") -> DataFrame:
    """What link() should find, derived another way: by self-joins and aggregates, without a window over a chain. row is unique.

    (row, kind, position, legs_today, density, gap, prior_distance, prior_elapsed), unknown tails left out of all but row and density. The leg before is the latest of the same tail and day, or else the last one
    of the latest day before, looked for among the days of this and the last month, and only where there is none among all days of the tail. Pairs of legs are those of one day, pairs of days those of two months.
    Pairs of days carry dates alone; a day's last leg is fetched once its date is known. Legs with their leg before are written, as they meet themselves.
    """
    arrival = F.timestamp_add("MINUTE", F.round("elapsed_min").cast("int"), F.col(ts))
    leg = F.struct(F.col(ts).alias("ts"), F.col(row).alias("row"), F.col("dest").alias("dest"), arrival.alias("arr"), F.col("distance").alias("distance"), F.col("elapsed_min").alias("elapsed"))
    known = legs.where("tail IS NOT NULL").select(F.col(row).alias("row"), "tail", "service_date", "origin", F.col(ts).alias("ts"), leg.alias("leg"))
    earlier = known.select(F.col("tail").alias("_tail"), F.col("service_date").alias("_day"), F.col("leg").alias("_leg"))
    same_day = (F.col("tail") == F.col("_tail")) & (F.col("service_date") == F.col("_day")) & (F.struct(F.col("_leg.ts"), F.col("_leg.row")) < F.struct("ts", "row"))
    today = known.drop("leg").join(earlier, same_day, "left").groupBy("row", "tail", "service_date", "origin", "ts").agg(F.max("_leg").alias("today"), (F.count("_leg") + 1).alias("position"))

    days = known.groupBy("tail", "service_date").agg(F.max("leg").alias("last"), F.count("*").alias("legs_today"))
    month = F.year("service_date") * 12 + F.month("service_date")
    past = days.select(F.col("tail").alias("_tail"), F.col("service_date").alias("_day"), F.explode(F.array(month, month + 1)).alias("_month"))
    before = (F.col("tail") == F.col("_tail")) & (F.col("_day") < F.col("service_date"))
    near = days.withColumn("month", month).join(past, before & (F.col("month") == F.col("_month")), "left").groupBy("tail", "service_date", "legs_today").agg(F.max("_day").alias("near"))
    far = near.where("near IS NULL").select("tail", "service_date").join(days.select(F.col("tail").alias("_tail"), F.col("service_date").alias("_day")), before)
    far = far.groupBy("tail", "service_date").agg(F.max("_day").alias("far"))
    flown = near.join(far, ["tail", "service_date"], "left").withColumn("_day", F.coalesce("near", "far"))
    lasts = days.select("tail", F.col("service_date").alias("_day"), F.col("last").alias("yesterday"))
    yesterday = flown.join(lasts, ["tail", "_day"], "left").select("tail", "service_date", "legs_today", "yesterday")

    prior = today.join(yesterday, ["tail", "service_date"]).withColumn("prior", F.coalesce("today", "yesterday")).withColumn("gap", minutes_between(F.col("ts"), F.col("prior.arr")))
    prior = materialise(
        prior.select(
            "row", "position", "legs_today", "gap", F.col("prior").isNull().alias("first"), (F.col("prior.dest") == F.col("origin")).alias("here"),
            F.col("prior.row").alias("prior_row"), F.col("prior.distance").alias("prior_distance"), F.col("prior.elapsed").alias("prior_elapsed"),
        ),
        "legs-before",
    )
    overlaps = prior.select(F.col("row").alias("_row"), (F.col("gap") < 0).alias("_overlaps"))
    linked = prior.join(overlaps.hint("merge"), F.col("prior_row") == F.col("_row"), "left")
    fits = F.col("here") & ~F.coalesce("_overlaps", F.lit(False))
    kind = F.when(F.col("first"), "b").when(fits & (F.col("gap") >= 0), F.when(F.col("gap") <= DUTY_MIN, "a").otherwise("b")).otherwise("c")
    found = linked.select("row", kind.alias("kind"), "position", "legs_today", "gap", "prior_distance", "prior_elapsed")
    hour = F.hour(F.col(ts).cast("timestamp"))
    slots = legs.groupBy("origin", "service_date", hour.alias("_hour")).agg(F.count("*").alias("density"))
    placed = legs.select(F.col(row).alias("row"), "origin", "service_date", hour.alias("_hour")).join(slots, ["origin", "service_date", "_hour"]).select("row", "density")
    return placed.join(found, "row", "left").withColumnRenamed("row", row)


def link_violations(mart: DataFrame, expected: DataFrame, rates: DataFrame, row: str = "event_id") -> DataFrame:
    """(row, violation): where a mart of links departs from what rebuilt() expects; group violations have a null row.

    mart: link()'s columns with band_n, band_rate, position_n and position_rate, the history by band and by position; rates: level ("band", "position"), key, n. All comparisons take null as equal to null.
    mart and expected meet once; what rows and groups are judged by is written.
    """
    differs = lambda a, b: ~F.col(a).eqNullSafe(b if isinstance(b, Column) else F.col(b))
    e = expected.select(*[F.col(c).alias(f"e_{c}") for c in expected.columns])
    both = mart.join(e, mart[row] == e[f"e_{row}"])
    kind, gap = F.col("e_kind"), F.when(F.col("e_kind") == "a", F.col("e_gap"))
    clean, swapped, history = F.coalesce(kind != "c", F.lit(False)), F.coalesce(kind == "c", F.lit(False)), ("band_n", "band_rate", "position_n", "position_rate")
    links = ("rotation_position", "legs_today", "turnaround_min", "slack_min", "is_tight", "inbound_distance", "inbound_elapsed_min")
    some = lambda columns, test: F.greatest(*[test(c) for c in columns])
    known = F.col("tail").isNotNull()
    rules = {
        "turnaround_mismatch": known & differs("turnaround_min", gap),
        "inbound_attr_mismatch": known & F.coalesce("has_inbound_leg", F.lit(False)) & (differs("inbound_distance", "e_prior_distance") | differs("inbound_elapsed_min", "e_prior_elapsed") | differs("slack_min", gap - TIGHT_MIN) | differs("is_tight", gap < TIGHT_MIN)),
        "position_or_day_mismatch": differs("density", "e_density") | (clean & (differs("rotation_position", "e_position") | differs("legs_today", "e_legs_today"))),
        "flag_mismatch": known & differs("has_inbound_leg", F.when(kind == "a", True).when(kind == "b", False)),
        "swap_shaped_not_nulled": swapped & some((*links, *history), lambda c: F.col(c).isNotNull()),
        "clean_link_hist_missing": clean & some(history, lambda c: F.col(c).isNull()),
        "rotation_join_miss": F.col("density").isNull(),
        "inbound_attrs_without_inbound": F.coalesce(kind == "b", F.lit(False)) & (some(("turnaround_min", "slack_min", "inbound_distance", "inbound_elapsed_min"), lambda c: F.col(c).isNotNull()) | differs("is_tight", F.lit(False)) | F.col("rotation_position").isNull() | F.col("legs_today").isNull()),
        "tail_null_not_nulled": ~known & some((*links, "has_inbound_leg", *history), lambda c: F.col(c).isNotNull()),
    }
    labels = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    keys = {"band": turnaround_band(gap), "position": F.least(F.col("e_position"), F.lit(MOST_POSITION)).cast("string")}
    judged = both.select(F.col(row), labels.alias("broken"), *[F.when(clean, F.struct(key.alias("key"), F.col(f"{name}_rate").alias("rate"), F.col(f"{name}_n").alias("n"))).alias(name) for name, key in keys.items()])
    judged = materialise(judged, "links-judged")
    out = judged.select(F.col(row), F.explode("broken").alias("violation"))
    for name in keys:
        groups = judged.where(F.col(name).isNotNull()).groupBy(F.col(name)["key"].alias("key")).agg(F.count_distinct(F.col(name)["rate"]).alias("rates"), F.count_distinct(F.col(name)["n"]).alias("ns"), F.min(F.col(name)["n"]).alias("least"))
        against = groups.join(rates.where(F.col("level") == name).select("key", "n"), "key", "left")
        found = F.array_compact(F.array(F.when((F.col("rates") > 1) | (F.col("ns") > 1), F.lit(f"hist_not_constant_within_{name}")), F.when(F.col("n").isNotNull() & differs("least", "n"), F.lit(f"{name}_hist_relabelled"))))
        out = out.unionByName(against.select(F.lit(None).cast(mart.schema[row].dataType).alias(row), F.explode(found).alias("violation")))
    return out
