"""Evaluation of scored legs as relations: ranking metrics, calibration, sweeps, banks and days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.operators.measures import rate

#: Ranges of the score into which ranks are cut for prefix sums.
RANGES = 1024


def ranked_scores(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (and group) with n, pos, and above_n, above_pos: the sums over all higher scores.

    Scores are first aggregated, then cut into RANGES ranges: sums of ranges and running sums inside a range add up, so
    no task orders more than a range's distinct scores.
    """
    ties = scored.groupBy(*by, "p").agg(F.count("*").alias("n"), F.count_if("y").alias("pos")).withColumn("_r", F.floor(F.col("p") * RANGES))
    ranges = ties.groupBy(*by, "_r").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    higher = W.Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy(*by)
    starts = ranges.select(*by, "_r", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_n"), F.coalesce(F.sum("_pos").over(higher), F.lit(0)).alias("_pos"), F.sum("_n").over(whole).alias("all_n"), F.sum("_pos").over(whole).alias("all_pos"))
    inside = W.Window.partitionBy(*by, "_r").orderBy(F.desc("p")).rowsBetween(W.Window.unboundedPreceding, -1)
    placed = ties.withColumns({"_an": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_ap": F.coalesce(F.sum("pos").over(inside), F.lit(0))})
    return placed.join(starts, [*by, "_r"]).withColumns({"above_n": F.col("_n") + F.col("_an"), "above_pos": F.col("_pos") + F.col("_ap")}).drop("_r", "_n", "_pos", "_an", "_ap")


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, positives, average precision (stepwise, ties as one step) and ROC AUC (ties count half) of (p, y)."""
    ranks = ranked_scores(scored, by)
    step = F.col("pos") * rate(F.col("above_pos") + F.col("pos"), F.col("above_n") + F.col("n"))
    negatives = F.col("n") - F.col("pos")
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("above_n") - F.col("above_pos")) - negatives
    won = F.col("pos") * (below + negatives / 2)
    n, pos = F.sum("n"), F.sum("pos")
    return ranks.groupBy(*by).agg(
        n.alias("n"), pos.alias("positives"), F.round(rate(F.sum(step), pos), 9).alias("average_precision"), F.round(rate(F.sum(won), pos.cast("double") * (n - pos)), 9).alias("roc_auc")
    )


def score_bin(p: Column, bins: int = 10) -> Column:
    """The index of p's bin of equal width; 1 falls into the last."""
    return F.least(F.floor(F.round(p * bins, 9)), F.lit(bins - 1)).cast("int")


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin: n, mean score, share late and the gap between them."""
    table = scored.groupBy(score_bin(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), rate(F.count_if("y"), F.count("*")).alias("late_share"))
    return table.withColumn("gap", F.abs(F.col("mean_p") - F.col("late_share")))


def calibration_errors(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected and maximal calibration error, Brier score, base rate."""
    y = F.col("y").cast("int")
    cells = scored.groupBy(score_bin(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col("p") - y, 2)).alias("se"))
    gap = F.abs(F.col("sp") - F.col("sy"))
    n = F.sum("n")
    return cells.agg(F.round(F.sum(gap) / n, 9).alias("ece"), F.round(F.max(gap / F.col("n")), 9).alias("mce"), F.round(F.sum("se") / n, 9).alias("brier"), F.round(F.sum("sy") / n, 9).alias("base_rate"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """alerts, precision and recall at each threshold, in one scan: a conditional sum each, then unpivoted."""
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= t
        sums += [F.count_if(hit).alias(f"a{i}"), F.count_if(hit & F.col("y")).alias(f"t{i}")]
    wide = scored.groupBy(*by).agg(F.count_if("y").alias("pos"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("alerts"), F.col(f"t{i}").alias("hits")) for i, t in enumerate(thresholds)]))
    return wide.select(*by, "pos", rows.alias("r")).select(*by, "r.threshold", "r.alerts", F.round(rate(F.col("r.hits"), F.col("r.alerts")), 6).alias("precision"), F.round(rate(F.col("r.hits"), F.col("pos")), 6).alias("recall"))


def exceedance(scored: DataFrame, minutes: Sequence[int], bins: int = 10) -> DataFrame:
    """Per score bin the share of legs at least so many minutes late."""
    return scored.groupBy(score_bin(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), *[F.round(rate(F.count_if(F.col("delay") >= t), F.count("*")), 9).alias(f"late_{t}") for t in minutes])


def day_moments(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected late legs (sum of p), their Poisson-binomial deviation, what happened, and the standardised miss z."""
    out = scored.groupBy(*by).agg(F.count("*").alias("n"), F.sum("p").alias("e"), F.sqrt(F.sum(F.col("p") * (1 - F.col("p")))).alias("s"), F.count_if("y").alias("actual"))
    return out.select(*by, "n", F.round("e", 6).alias("expected"), F.round("s", 6).alias("sd"), "actual", F.round(rate(F.col("actual") - F.col("e"), F.col("s")), 6).alias("z"))


def typicality(days: DataFrame, day: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """days (one row each, with z) with the band of usual z, whether each is inside and the share of days with a smaller z."""
    band = days.agg(F.expr(f"percentile(z, {low})").alias("lo"), F.expr(f"percentile(z, {high})").alias("hi"))
    marked = days.withColumns({"lo": F.round(band.select("lo").scalar(), 6), "hi": F.round(band.select("hi").scalar(), 6)})
    share = rate(F.rank().over(W.Window.orderBy(F.col("z").asc_nulls_last())) - 1, F.count("*").over(W.Window.partitionBy()))
    return marked.select(day, "z", "lo", "hi", F.col("z").between(F.col("lo"), F.col("hi")).alias("in_band"), F.round(share, 9).alias("percentile"))


def best_week(days: DataFrame, day: str) -> DataFrame:
    """The Monday of the week whose seven days are all in band with the smallest mean |z|; ties to the earliest."""
    weeks = days.groupBy(F.date_trunc("week", F.col(day).cast("timestamp")).cast("date").alias("monday")).agg(F.count("*").alias("n"), F.every("in_band").alias("inside"), F.round(F.avg(F.abs("z")), 6).alias("mean_abs_z"))
    return weeks.where("n = 7 AND inside").orderBy("mean_abs_z", "monday").limit(1).select("monday", "mean_abs_z")


def top_curve(scored: DataFrame, cuts: Sequence[int], key: str) -> DataFrame:
    """Late share of the `cut` highest scores for each cut (a top-k report), ties to the smaller key."""
    top = scored.orderBy(F.desc("p"), key).limit(max(cuts)).select("p", "y", key)
    placed = top.withColumn("place", F.row_number().over(W.Window.orderBy(F.desc("p"), key)))
    rows = F.explode(F.array(*map(F.lit, cuts))).alias("cut")
    return placed.select("place", "y", rows).where("place <= cut").groupBy("cut").agg(F.count("*").alias("n"), F.round(rate(F.count_if("y"), F.count("*")), 9).alias("late_share"))


def average_ranks(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """key with the mean of the columns' average ranks over n, for blending scores of different scales."""
    out = df.select(key, *columns)
    for c in columns:
        r = ranked_scores(df.select(F.col(c).alias("p"), F.lit(False).alias("y"))).select(F.col("p").alias(f"_{c}"), ((F.col("all_n") - F.col("above_n") - F.col("n") + (F.col("n") + 1) / 2) / F.col("all_n")).alias(f"{c}_rank"))
        out = out.join(r, F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    blend = sum((F.col(f"{c}_rank") for c in columns[1:]), F.col(f"{columns[0]}_rank")) / len(columns)
    return out.select(key, *[F.round(f"{c}_rank", 9).alias(f"{c}_rank") for c in columns], F.round(blend, 9).alias("blend"))


def top_share(scored: DataFrame, by: Sequence[str], share: float = 0.1) -> DataFrame:
    """by with n, base (late share), top_n, top_late and lift of the rows whose rank by p is within `share` of their group, ties included.

    Rows are counted by score before anything is ordered, so a window sees distinct scores alone.
    """
    w = W.Window.partitionBy(*by)
    counted = scored.groupBy(*by, "p").agg(F.count("*").alias("n"), F.count_if("y").alias("late"))
    placed = counted.withColumns({"above": F.sum("n").over(w.orderBy(F.desc("p"))) - F.col("n"), "all": F.sum("n").over(w)})
    top = F.col("above") < F.greatest(F.lit(1), F.floor(share * F.col("all")))
    sums = placed.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("late").alias("late"), F.sum(F.when(top, F.col("n"))).alias("top_n"), F.sum(F.when(top, F.col("late"))).alias("hit"))
    base, hit = rate(F.col("late"), F.col("n")), rate(F.col("hit"), F.col("top_n"))
    return sums.select(*by, "n", "top_n", F.round(base, 9).alias("base"), F.round(hit, 9).alias("top_late"), F.round(hit / base, 9).alias("lift"))


def placed(df: DataFrame, within: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place in its group by the whole order; rows that tie in all of it share a place."""
    return df.withColumn(name, F.rank().over(W.Window.partitionBy(*within).orderBy(*order)).cast("long"))


def ranking_kept(scored: DataFrame, maps: Mapping[str, Column], tolerance: float = 1e-6) -> DataFrame:
    """(map, average_precision, roc_auc, pr_delta, roc_delta, passed) for "raw" scores p and for each map of them: a calibration may move scores but not their order.

    All maps are ranked in one pass, by map. A map that ties or turns scores moves a metric and fails; compare with refuse().
    """
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("map"), c.cast("double").alias("p")) for n, c in {"raw": F.col("p"), **maps}.items()]))
    metrics = ranking_metrics(scored.select("y", rows.alias("m")).select("y", "m.map", "m.p"), ["map"]).select("map", "average_precision", "roc_auc")
    raw = metrics.where("map = 'raw'")
    deltas = [F.abs(F.col(c) - raw.select(c).scalar()).alias(n) for c, n in (("average_precision", "pr_delta"), ("roc_auc", "roc_delta"))]
    out = metrics.select("*", *deltas)
    return out.withColumn("passed", F.coalesce((F.col("pr_delta") <= tolerance) & (F.col("roc_delta") <= tolerance), F.lit(False)))


def refuse(kept: DataFrame, name: str) -> None:
    """Raises unless a map of ranking_kept() passed; an unknown one hasn't."""
    row = kept.where(F.col("map") == name).first()
    if row is None or not row.passed:
        raise ValueError(f"map {name} doesn't keep the ranking: {row}")


def drift(scored: DataFrame, window: str, before: str, after: str) -> DataFrame:
    """One row: how much of its margin over 0.5 the ROC AUC loses from one window to another, how much the calibration error grows, and which is more.

    Null where a window is missing, its margin or its error is zero.
    """
    both = scored.where(F.col(window).isin(before, after))
    ranks = ranking_metrics(both, [window]).select(window, "roc_auc")
    cells = both.groupBy(window, score_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.sum("p") - F.sum(F.col("y").cast("int"))).alias("gap"))
    errors = cells.groupBy(window).agg(F.round(F.sum("gap") / F.sum("n"), 9).alias("ece"))
    at = lambda name, column: F.max(F.when(F.col(window) == name, F.col(column)))
    one = ranks.join(errors, window).agg(*[at(name, column).alias(f"{column}_{side}") for side, name in (("before", before), ("after", after)) for column in ("roc_auc", "ece")])
    loss, growth = 1 - rate(F.col("roc_auc_after") - 0.5, F.col("roc_auc_before") - 0.5), rate(F.col("ece_after"), F.col("ece_before")) - 1
    return one.select("*", F.round(loss, 4).alias("margin_loss"), F.round(growth, 4).alias("ece_growth"), (growth > loss).alias("calibration_decays_first"))
