"""Evaluation of the scored legs of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import evaluate as e
from lathe.operators.measures import rate
from lathe.functions.scalars import platt
from lathe.plans.adapters import CUTOFF, LEGS_LINEITEM, legs_lineitem
from lathe.plans.base import query

SCORED = LEGS_LINEITEM + ", s AS (SELECT *, del15 AS y, arr_delay AS delay FROM flown WHERE del15 IS NOT NULL)"


def scored(spark, d):
    return legs_lineitem(spark, d).where("del15 IS NOT NULL").withColumn("y", F.col("del15")).withColumn("delay", F.col("arr_delay"))


def _ranking(by: str = "") -> str:
    g = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""WITH {SCORED}, t AS (SELECT {g}p, count(*) AS n, count(*) FILTER (y) AS pos FROM s GROUP BY {g}p),
c AS (SELECT *, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cn, sum(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS cp, sum(n) OVER ({over}) AS an, sum(pos) OVER ({over}) AS ap FROM t WINDOW w AS ({over} ORDER BY p DESC))
SELECT {g}CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * (cp::DOUBLE / cn)) / nullif(sum(pos), 0), 9) AS average_precision,
  round(sum(pos * ((an - ap) - (cn - cp) + (n - pos) / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * (sum(n) - sum(pos)), 0), 9) AS roc_auc FROM c {"GROUP BY " + by if by else ""}"""


@query(_ranking())
def ranking_metrics(spark, d):
    return e.ranking_metrics(scored(spark, d))


@query(_ranking("carrier"))
def ranking_by_carrier(spark, d):
    return e.ranking_metrics(scored(spark, d), ["carrier"])


_BIN = "CAST(least(floor(round(p * 10, 9)), 9) AS INTEGER)"


@query(f"WITH {SCORED} SELECT {_BIN} AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y::INT), 9) AS late_share, round(abs(avg(p) - avg(y::INT)), 9) AS gap FROM s GROUP BY 1")
def reliability_table(spark, d):
    return e.reliability(scored(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_p", "late_share", "gap")})


@query(f"""WITH {SCORED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(p) AS sp, sum(y::INT) AS sy, sum((p - y::INT) * (p - y::INT)) AS se FROM s GROUP BY 1)
SELECT round(sum(abs(sp - sy)) / sum(n), 9) AS ece, round(max(abs(sp - sy) / n), 9) AS mce, round(sum(se) / sum(n), 9) AS brier, round(sum(sy)::DOUBLE / sum(n), 9) AS base_rate FROM b""")
def calibration_errors(spark, d):
    return e.calibration_errors(scored(spark, d))


SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]
_SWEEP_SQL = f"""SELECT {{g}}t.threshold, count(*) FILTER (p >= t.threshold) AS alerts, round(count(*) FILTER (p >= t.threshold AND y)::DOUBLE / nullif(count(*) FILTER (p >= t.threshold), 0), 6) AS precision,
  round(count(*) FILTER (p >= t.threshold AND y)::DOUBLE / nullif(count(*) FILTER (y), 0), 6) AS recall FROM s, (VALUES {", ".join(f"({t}::DOUBLE)" for t in SWEEP)}) t(threshold) GROUP BY ALL"""


@query(f"WITH {SCORED} " + _SWEEP_SQL.format(g=""))
def threshold_sweep(spark, d):
    return e.threshold_sweep(scored(spark, d), SWEEP)


@query(f"WITH {SCORED} " + _SWEEP_SQL.format(g="service_date, ").replace(", ".join(f"({t}::DOUBLE)" for t in SWEEP), "(0.5::DOUBLE)"))
def daily_threshold(spark, d):
    return e.threshold_sweep(scored(spark, d), [0.5], ["service_date"])


LATE = (0, 15, 30, 45, 60, 90, 120)


@query(f"WITH {SCORED} SELECT {_BIN} AS bin, count(*) AS n, " + ", ".join(f"round(avg((delay >= {t})::INT), 9) AS late_{t}" for t in LATE) + " FROM s GROUP BY 1")
def exceedance_table(spark, d):
    return e.exceedance(scored(spark, d), LATE)


_DAYS = f"""{SCORED}, g AS (SELECT service_date, count(*) AS n, sum(p) AS e, sqrt(sum(p * (1 - p))) AS s, count(*) FILTER (y) AS actual FROM s GROUP BY 1),
days AS (SELECT service_date, n, round(e, 6) AS expected, round(s, 6) AS sd, actual, round((actual - e) / nullif(s, 0), 6) AS z FROM g)"""


@query(f"WITH {_DAYS} SELECT * FROM days")
def day_moments(spark, d):
    return e.day_moments(scored(spark, d), ["service_date"])


@query(f"""WITH {SCORED} SELECT origin, dep_hour, count(*) AS n, round(sum(p), 6) AS expected, round(sqrt(sum(p * (1 - p))), 6) AS sd, count(*) FILTER (y) AS actual,
  round((count(*) FILTER (y) - sum(p)) / nullif(sqrt(sum(p * (1 - p))), 0), 6) AS z FROM s GROUP BY ALL""")
def hourly_banks(spark, d):
    return e.day_moments(scored(spark, d), ["origin", "dep_hour"])


_BAND = f"""{_DAYS}, q AS (SELECT round(quantile_cont(z, 0.1), 6) AS lo, round(quantile_cont(z, 0.9), 6) AS hi FROM days),
typ AS (SELECT service_date, z, lo, hi, z BETWEEN lo AND hi AS in_band, round((rank() OVER (ORDER BY z NULLS LAST) - 1)::DOUBLE / count(*) OVER (), 9) AS percentile FROM days, q)"""


@query(f"WITH {_BAND} SELECT * FROM typ")
def day_typicality(spark, d):
    return e.typicality(e.day_moments(scored(spark, d), ["service_date"]), "service_date")


@query(f"""WITH {_BAND}, w AS (SELECT CAST(date_trunc('week', service_date) AS DATE) AS monday, count(*) AS n, bool_and(in_band) AS inside, round(avg(abs(z)), 6) AS mean_abs_z FROM typ GROUP BY 1)
SELECT monday, mean_abs_z FROM w WHERE n = 7 AND inside ORDER BY mean_abs_z, monday LIMIT 1""")
def best_week(spark, d):
    return e.best_week(e.typicality(e.day_moments(scored(spark, d), ["service_date"]), "service_date"), "service_date")


_KEY = "flight_number * 10 + line"
CUTS = (10, 100, 1000)


@query(f"""WITH {SCORED}, k AS (SELECT y, row_number() OVER (ORDER BY p DESC, key) AS place FROM (SELECT p, y, min({_KEY}) AS key, count(*) FROM s GROUP BY p, y, {_KEY}))
SELECT c.cut, count(*) AS n, round(avg(y::INT), 9) AS late_share FROM k, (VALUES (10), (100), (1000)) c(cut) WHERE place <= c.cut GROUP BY 1""")
def top_score_curve(spark, d):
    rows = scored(spark, d).select("p", "y", F.expr(_KEY).alias("key")).distinct()
    return e.top_curve(rows.withColumn("key", F.col("key")), CUTS, "key").withColumn("cut", F.col("cut").cast("int"))


@query(f"""WITH {SCORED}, k AS (SELECT {_KEY} AS key, any_value(p) AS p, max(round(dep_hour / 24.0::DOUBLE, 9)) AS h FROM s GROUP BY 1),
r AS (SELECT key, (rank() OVER (ORDER BY p) + count(*) OVER (ORDER BY p) ) / 2.0::DOUBLE / count(*) OVER () AS p_rank, (rank() OVER (ORDER BY h) + count(*) OVER (ORDER BY h)) / 2.0::DOUBLE / count(*) OVER () AS h_rank FROM (SELECT key, max(p) AS p, max(h) AS h FROM k GROUP BY key))
SELECT key, round(p_rank, 9) AS p_rank, round(h_rank, 9) AS h_rank, round((p_rank + h_rank) / 2, 9) AS blend FROM r""".replace("any_value(p)", "max(p)"))
def rank_blend(spark, d):
    rows = scored(spark, d).groupBy(F.expr(_KEY).alias("key")).agg(F.max("p").alias("p"), F.max(F.round(F.col("dep_hour") / 24.0, 9)).alias("h"))
    return e.average_ranks(rows, ["p", "h"], "key")


@query(f"WITH {SCORED} SELECT p >= 0.5 AS alerted, y AS late, count(*) AS legs, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM s GROUP BY ALL")
def confusion(spark, d):
    from lathe.operators.measures import share_of_total

    return share_of_total(scored(spark, d).groupBy((F.col("p") >= 0.5).alias("alerted"), F.col("y").alias("late")).agg(F.count("*").alias("legs")), "legs")


@query(f"""WITH {LEGS_LINEITEM} SELECT round(avg((arr_delay IS NULL)::INT), 9) AS arr_delay, round(avg((dep_delay IS NULL)::INT), 9) AS dep_delay, round(avg((del15 IS NULL)::INT), 9) AS del15 FROM flown""")
def null_shares(spark, d):
    return legs_lineitem(spark, d).agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 9).alias(c) for c in ("arr_delay", "dep_delay", "del15")])


@query(f"""WITH {SCORED} SELECT CASE WHEN delay < 0 THEN 'early' WHEN delay < 15 THEN '0_15' WHEN delay < 45 THEN '15_45' ELSE 'ge_45' END AS bucket, count(*) AS n, round(avg(abs(delay - p * 60)), 6) AS mae, round(sqrt(avg((delay - p * 60) * (delay - p * 60))), 6) AS rmse FROM s GROUP BY 1""")
def error_by_bucket(spark, d):
    err = F.col("delay") - F.col("p") * 60
    bucket = F.when(F.col("delay") < 0, "early").when(F.col("delay") < 15, "0_15").when(F.col("delay") < 45, "15_45").otherwise("ge_45")
    return scored(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(err)), 6).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rmse"))


@query(f"""WITH {SCORED}, m AS (SELECT avg(delay) AS mean_delay, avg(y::INT) AS late FROM s)
SELECT round(avg(abs(delay - mean_delay)), 6) AS mean_baseline_mae, round(sqrt(avg((delay - mean_delay) * (delay - mean_delay))), 6) AS mean_baseline_rmse, round(greatest(avg(y::INT), 1 - avg(y::INT)), 9) AS majority_accuracy, round(avg(((p >= 0.5) = y)::INT), 9) AS accuracy FROM s, m""")
def baselines(spark, d):
    s = scored(spark, d)
    mean = s.agg(F.avg("delay")).scalar()
    s = s.withColumn("off", F.col("delay") - mean)
    late = F.avg(F.col("y").cast("int"))
    return s.agg(F.round(F.avg(F.abs("off")), 6).alias("mean_baseline_mae"), F.round(F.sqrt(F.avg(F.col("off") * F.col("off"))), 6).alias("mean_baseline_rmse"), F.round(F.greatest(late, 1 - late), 9).alias("majority_accuracy"), F.round(F.avg(((F.col("p") >= 0.5) == F.col("y")).cast("int")), 9).alias("accuracy"))


@query(f"""WITH {SCORED} SELECT carrier, round(avg(y::INT) FILTER (service_date < DATE '1996-01-01'), 9) AS before, round(avg(y::INT) FILTER (service_date >= DATE '1996-01-01'), 9) AS after,
  round(avg(y::INT) FILTER (service_date >= DATE '1996-01-01') - avg(y::INT) FILTER (service_date < DATE '1996-01-01'), 9) AS drift, round((avg(y::INT)) / (SELECT avg(y::INT) FROM s), 9) AS lift FROM s GROUP BY 1 HAVING count(*) >= 1000""")
def drift_by_carrier(spark, d):
    s = scored(spark, d).withColumn("v", F.col("y").cast("int"))
    early = F.col("service_date") < F.lit("1996-01-01").cast("date")
    before, after = F.avg(F.when(early, F.col("v"))), F.avg(F.when(~early, F.col("v")))
    base = s.agg(F.avg("v")).scalar()
    out = s.groupBy("carrier").agg(F.count("*").alias("n"), before.alias("b"), after.alias("a"), F.avg("v").alias("m")).where("n >= 1000")
    return out.select("carrier", F.round("b", 9).alias("before"), F.round("a", 9).alias("after"), F.round(F.col("a") - F.col("b"), 9).alias("drift"), F.round(rate(F.col("m"), base), 9).alias("lift"))


_MAPPED = SCORED.replace(", s AS (", ", s0 AS (") + ", s AS (SELECT map, y, CASE map WHEN 'coarse' THEN floor(p * 10) / 10 WHEN 'turned' THEN 1 - p ELSE p END AS p FROM s0, (VALUES ('raw'), ('platt'), ('coarse'), ('turned')) v(map))"


@query(f"""SELECT m.map, m.average_precision, m.roc_auc, round(abs(m.average_precision - r.average_precision), 6) AS pr_delta, round(abs(m.roc_auc - r.roc_auc), 6) AS roc_delta, abs(m.average_precision - r.average_precision) <= 1e-6 AND abs(m.roc_auc - r.roc_auc) <= 1e-6 AS passed
FROM ({_ranking("map").replace(f"WITH {SCORED}", f"WITH {_MAPPED}")}) m, ({_ranking("map").replace(f"WITH {SCORED}", f"WITH {_MAPPED}")}) r WHERE r.map = 'raw'""")
def calibration_gate(spark, d):
    """A rising map keeps the ranking; one that ties scores and one that turns them don't."""
    maps = {"platt": platt(F.col("p"), 1.3, -0.4), "coarse": F.floor(F.col("p") * 10) / 10, "turned": 1 - F.col("p")}
    return e.ranking_kept(scored(spark, d), maps).withColumns({c: F.round(c, 6) for c in ("pr_delta", "roc_delta")})


_DRIFT = SCORED.replace(", s AS (", ", s0 AS (") + f", s AS (SELECT CASE WHEN service_date < DATE '{CUTOFF}' THEN 'old' ELSE 'new' END AS part, y, CASE WHEN service_date < DATE '{CUTOFF}' THEN 0.5 * p + 0.5 * y::INT ELSE 0.8 * p + 0.2 * y::INT END AS p FROM s0)"


@query(f"""WITH k AS ({_ranking("part").replace(f"WITH {SCORED}", f"WITH {_DRIFT}")}),
x AS (WITH {_DRIFT} SELECT part, round(sum(gap) / sum(n), 9) AS ece FROM (SELECT part, count(*) AS n, abs(sum(p) - sum(y::INT)) AS gap FROM s GROUP BY part, {_BIN}) GROUP BY part),
w AS (SELECT a.roc_auc AS roc_auc_before, b.ece AS ece_before, c.roc_auc AS roc_auc_after, d.ece AS ece_after FROM k a, x b, k c, x d WHERE a.part = 'old' AND b.part = 'old' AND c.part = 'new' AND d.part = 'new')
SELECT *, round(1 - (roc_auc_after - 0.5) / (roc_auc_before - 0.5), 4) AS margin_loss, round(ece_after / ece_before - 1, 4) AS ece_growth, ece_after / ece_before - 1 > 1 - (roc_auc_after - 0.5) / (roc_auc_before - 0.5) AS calibration_decays_first FROM w""")
def drift_report(spark, d):
    """What ranking and calibration lose between two windows of time."""
    late, old = F.col("y").cast("int"), F.col("service_date") < F.lit(CUTOFF).cast("date")
    s = scored(spark, d).select("y", F.when(old, "old").otherwise("new").alias("part"), F.when(old, 0.5 * F.col("p") + 0.5 * late).otherwise(0.8 * F.col("p") + 0.2 * late).alias("p"))
    return e.drift(s, "part", "old", "new")
