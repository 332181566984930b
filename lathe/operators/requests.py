"""A batch of requests to the feature rows that a model scores, by lookups alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.scalars import usable
from lathe.operators.chain import DUTY_MIN, MOST_POSITION, TIGHT_MIN, turnaround_band
from lathe.operators.joins import level_lookup

#: Columns of the one row that stands for a rotation that isn't given: medians of what was trained on.
TYPICAL = ("position", "legs", "turnaround", "distance", "elapsed")
# Fixed value: the position whose history stands for an unknown one.
UNKNOWN_POSITION = "3"


def assemble_requests(requests: DataFrame, history: DataFrame, distances: DataFrame, densities: DataFrame, typical: DataFrame) -> DataFrame:
    """requests (carrier, origin, dest, flight_date, dep_time and arr_time as HH:MM, distance, density, rotation_position, legs_today, turnaround_min, inbound_distance, inbound_elapsed_min, any others) to feature rows.

    A distance or density that isn't finite and above zero is looked up by route, or by origin, hour and weekday. With a position the rotation is as given, legs never below
    it, and what is missing of it typical; without one all of it is typical. A turnaround outside of 0 to DUTY_MIN is no inbound leg. Keys that the history doesn't know give nulls, never
    another key's values. rotation_context and density_source say what a row rests on. history: level (route, carrier, airport, band, position), key, n, rate, delay; the other lookups have a row a
    key, typical has one row. Sides meet the batch by left joins, so a batch of any size is one pass, and no request is lost.
    """
    typ = {c: typical.select(F.col(c).cast("double")).scalar() for c in TYPICAL}
    given = F.col("rotation_position").isNotNull()
    held = requests.withColumns({f"_{c}": v for c, v in typ.items()})
    hour = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1)).cast("int")
    fact = held.withColumns({"route": F.concat_ws("-", "origin", "dest"), "dep_hour": hour("dep_time"), "arr_hour": hour("arr_time"), "weekday": F.weekday("flight_date") + 1, "month": F.month("flight_date")})
    far = distances.select(F.col("route").alias("_route"), F.col("distance").cast("double").alias("_known_distance"))
    dense = densities.select(F.col("origin").alias("_origin"), F.col("dep_hour").alias("_hour"), F.col("weekday").alias("_weekday"), F.col("density").cast("double").alias("_known_density"))
    fact = fact.join(far, F.col("route") == F.col("_route"), "left").join(dense, (F.col("origin") == F.col("_origin")) & (F.col("dep_hour") == F.col("_hour")) & (F.col("weekday") == F.col("_weekday")), "left")
    own = usable(F.col("density").cast("double"), F.lit(None).cast("double"))

    def pick(name: str, other: str) -> Column:
        return F.when(given, F.coalesce(F.col(name).cast("double"), F.col(f"_{other}"))).otherwise(F.col(f"_{other}"))

    position = F.when(given, F.col("rotation_position").cast("double")).otherwise(F.col("_position"))
    legs = F.when(given, F.greatest(pick("legs_today", "legs"), position)).otherwise(F.col("_legs"))
    gap = F.when(given, F.col("turnaround_min").cast("double")).otherwise(F.col("_turnaround"))
    inbound = F.coalesce(gap.between(0, DUTY_MIN), F.lit(False))
    positive = lambda c: F.when(inbound, usable(c, F.lit(None).cast("double")))
    rotation = {
        "rotation_position": position, "legs_today": legs, "has_inbound_leg": inbound, "turnaround_min": F.when(inbound, gap), "slack_min": F.when(inbound, gap - TIGHT_MIN), "is_tight": inbound & F.coalesce(gap < TIGHT_MIN, F.lit(False)),
        "inbound_distance": positive(pick("inbound_distance", "distance")), "inbound_elapsed_min": positive(pick("inbound_elapsed_min", "elapsed")),
    }
    basis = {"rotation_context": F.when(given, "provided").otherwise("typical"), "density_source": F.when(own.isNotNull(), "provided").otherwise("estimated")}
    fact = fact.withColumns({"distance": usable(F.col("distance").cast("double"), F.col("_known_distance")), "density": F.coalesce(own, F.col("_known_density")), **rotation, **basis})
    keys = {"_band": turnaround_band(F.col("turnaround_min")), "_place": F.coalesce(F.least(F.floor("rotation_position"), F.lit(MOST_POSITION)).cast("string"), F.lit(UNKNOWN_POSITION))}
    wanted = {"hist_route": ("route", F.col("route")), "hist_carrier": ("carrier", F.col("carrier").cast("string")), "hist_origin": ("airport", F.col("origin").cast("string")), "hist_dest": ("airport", F.col("dest").cast("string")), "hist_band": ("band", F.col("_band")), "hist_position": ("position", F.col("_place"))}
    found = level_lookup(fact.withColumns(keys), history, wanted, ["n", "rate", "delay"])
    return found.drop(*[f"_{c}" for c in TYPICAL], "_route", "_origin", "_hour", "_weekday", "_known_distance", "_known_density", *keys)
