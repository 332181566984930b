"""Delay measures, additive marts and the rates that are rolled up from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator; null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def counted(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def delay_measures() -> list[Column]:
    """The ten measures of a group of legs; the 90th percentile is the exact discrete one."""
    n = F.count("*")
    return [
        n.alias("n_flight_legs"),
        counted(F.col("cancelled"), "n_cancelled"),
        rate(F.count_if("cancelled"), n).alias("cancellation_rate"),
        counted(F.col("diverted"), "n_diverted"),
        rate(F.count_if("diverted"), n).alias("diversion_rate"),
        counted(F.col("del15"), "n_arr_del15"),
        rate(F.count_if("del15"), F.count("del15")).alias("arr_del15_rate"),
        F.avg("arr_delay").alias("avg_arr_delay_minutes"),
        F.avg("dep_delay").alias("avg_dep_delay_minutes"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY arr_delay)").alias("p90_arr_delay_minutes"),
    ]


def additive(legs: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Counts and sums only, so that any coarser grain is a sum of these rows."""
    return legs.groupBy(*keys).agg(
        F.count("*").alias("n_flights"),
        F.count("del15").alias("n_with_arr_outcome"),
        F.count("dep_delay").alias("n_with_dep_outcome"),
        counted(F.col("del15"), "n_arr_del15"),
        counted(F.col("cancelled"), "n_cancelled"),
        counted(F.col("diverted"), "n_diverted"),
        F.round(F.sum("arr_delay"), 6).alias("sum_arr_delay"),
        F.round(F.sum("dep_delay"), 6).alias("sum_dep_delay"),
    )


def _totals() -> list[Column]:
    sums = ("n_flights", "n_with_arr_outcome", "n_with_dep_outcome", "n_arr_del15", "n_cancelled", "n_diverted", "sum_arr_delay", "sum_dep_delay")
    return [F.round(F.sum(c), 6).alias(c) if c.startswith("sum") else F.sum(c).alias(c) for c in sums]


def with_rates(totals: DataFrame) -> DataFrame:
    col = F.col
    return totals.withColumns(
        {
            "arr_del15_rate": F.round(rate(col("n_arr_del15"), col("n_with_arr_outcome")), 9),
            "cancellation_rate": F.round(rate(col("n_cancelled"), col("n_flights")), 9),
            "diversion_rate": F.round(rate(col("n_diverted"), col("n_flights")), 9),
            "avg_arr_delay": F.round(rate(col("sum_arr_delay"), col("n_with_arr_outcome")), 9),
            "avg_dep_delay": F.round(rate(col("sum_dep_delay"), col("n_with_dep_outcome")), 9),
        }
    )


def rolled_up(mart: DataFrame, keys: Sequence[Column | str] = ()) -> DataFrame:
    """Rates at any grain of an additive mart, always as sum by sum; without keys the grand totals."""
    return with_rates(mart.groupBy(*keys).agg(*_totals()))


def share_of_total(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Each row's part of the sum over `by` (all rows without). Meant for aggregated rows: without `by` they meet in one task."""
    return df.withColumn(name, F.round(rate(F.col(column), F.sum(column).over(W.Window.partitionBy(*by))), 9))


def mix_adjusted(mart: DataFrame, entity: str, stratum: str, numerator: str = "n_arr_del15", denominator: str = "n_with_arr_outcome") -> DataFrame:
    """Indirect standardisation: what each entity does against what its own mix of strata would predict."""
    cells = mart.groupBy(entity, stratum).agg(F.sum("n_flights").alias("n"), F.sum(numerator).alias("a"), F.sum(denominator).alias("d"))
    strata = cells.groupBy(stratum).agg(rate(F.sum("a"), F.sum("d")).alias("stratum_rate"))
    joined = cells.join(strata, stratum).withColumn("expected", F.col("d") * F.col("stratum_rate"))
    out = joined.groupBy(entity).agg(F.sum("n").alias("n_flights"), F.sum("a").alias("actual"), F.sum("d").alias("denominator"), F.round(F.sum("expected"), 6).alias("expected"))
    col = F.col
    return out.withColumns({"rate": F.round(rate(col("actual"), col("denominator")), 9), "expected_rate": F.round(rate(col("expected"), col("denominator")), 9), "mix_index": F.round(rate(col("actual"), col("expected")), 9)})


def year_over_year(mart: DataFrame, year: Column) -> DataFrame:
    """Rates of each year with the change against the year before (null for the first)."""
    years = rolled_up(mart, [year.alias("year")])
    before = F.lag("arr_del15_rate").over(W.Window.orderBy("year"))
    return years.select("year", "n_flights", "arr_del15_rate", F.round(F.col("arr_del15_rate") - before, 9).alias("rate_change"))


def rate_matrix(mart: DataFrame, row: str, column: str, values: Sequence[object]) -> DataFrame:
    """Late rate by row and column; the columns are named so that the plan needs no pass to find them."""
    cells = mart.groupBy(row).pivot(column, list(values)).agg(F.round(rate(F.sum("n_arr_del15"), F.sum("n_with_arr_outcome")), 9))
    return cells.withColumnsRenamed({str(v): f"{column}_{v}" for v in values})


def extremes(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """Per group the rows of the largest and the smallest value, ties to the smaller `tie`."""
    return df.groupBy(*by).agg(
        F.min(F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t")))["t"].alias(f"most_{tie}"), F.max(value).alias(f"most_{value}"),
        F.min(F.struct(F.col(value).alias("v"), F.col(tie).alias("t")))["t"].alias(f"least_{tie}"), F.min(value).alias(f"least_{value}"),
    )
