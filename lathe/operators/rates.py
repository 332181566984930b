"""Historical rates by level, smoothed toward a global prior, and lookups made of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.measures import rate

# Fixed value: pseudo-observations of the global rate.
PRIOR_WEIGHT = 50


def level_rates(legs: DataFrame, levels: Mapping[str, Column], cutoff: str) -> DataFrame:
    """(level, key, n, rate, avg_delay) over completed legs before cutoff, for all levels in one scan.

    Each leg is repeated once per level, which map-side aggregation takes back at once; null keys are left out.
    """
    tagged = F.explode(F.array(*[F.struct(F.lit(name).alias("level"), key.cast("string").alias("key")) for name, key in levels.items()]))
    done = legs.where((F.col("service_date") < F.lit(cutoff).cast("date")) & F.col("del15").isNotNull())
    grouped = done.select(tagged.alias("e"), "del15", "arr_delay").where("e.key IS NOT NULL").groupBy("e.level", "e.key")
    return grouped.agg(F.count("*").alias("n"), F.round(rate(F.count_if("del15"), F.count("*")), 9).alias("rate"), F.round(F.avg("arr_delay"), 9).alias("avg_delay"))


def global_rate(rates: DataFrame, level: str) -> DataFrame:
    """One row: the means over a level whose keys part all legs, weighted by their numbers."""
    n = F.sum("n")
    return rates.where(F.col("level") == level).agg(rate(F.sum(F.col("n") * F.col("rate")), n).alias("global_rate"), rate(F.sum(F.col("n") * F.col("avg_delay")), n).alias("global_delay"))


def smoothed(n: Column, value: Column, prior: Column, weight: int = PRIOR_WEIGHT) -> Column:
    """(n * value + weight * prior) / (n + weight); null stays null."""
    return (n * value + weight * prior) / (n + weight)


def with_level(fact: DataFrame, rates: DataFrame, level: str, key: Column, prefix: str) -> DataFrame:
    """fact with the n, rate and delay of one level, smoothed toward the global row (scalars, as it is one row)."""
    side = rates.where(F.col("level") == level).select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("rate").alias("_rate"), F.col("avg_delay").alias("_delay"))
    joined = fact.join(side, key.cast("string") == F.col("_key"), "left")
    values = {f"{prefix}_n": F.col("_n"), f"{prefix}_rate": F.round(smoothed(F.col("_n"), F.col("_rate"), F.col("global_rate")), 9), f"{prefix}_delay": F.round(smoothed(F.col("_n"), F.col("_delay"), F.col("global_delay")), 9)}
    return joined.withColumns(values).drop("_key", "_n", "_rate", "_delay")


def relabelled(rates: DataFrame, level: str, as_level: str) -> DataFrame:
    """rates whose level as_level is a copy of another: what is known of a key in one role stands for it in the other."""
    copy = rates.where(F.col("level") == level).withColumn("level", F.lit(as_level))
    return rates.where(F.col("level") != as_level).unionByName(copy)
