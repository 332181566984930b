"""Splits and models over the feature mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import evaluate, learn
from lathe.functions.scalars import platt
from lathe.plans.adapters import LEGS_LINEITEM, legs_lineitem
from lathe.plans.base import query
from lathe.plans.feature_queries import features
from lathe.session import materialise

CUTS = {"fit": "1997-01-01", "validation": "1999-01-01"}
NUMBERS, CATEGORIES = ["route_rate", "origin_rate", "dest_rate", "dep_hour"], ["carrier_name"]


@query(f"""WITH {LEGS_LINEITEM}, s AS (SELECT service_date, CASE WHEN service_date < DATE '1997-01-01' THEN 'fit' WHEN service_date < DATE '1999-01-01' THEN 'validation' ELSE 'test' END AS part FROM flown)
SELECT part, count(*) AS rows, min(service_date) AS first_day, max(service_date) AS last_day FROM s GROUP BY part""")
def time_split(spark, d):
    return learn.split_proof(learn.time_split(legs_lineitem(spark, d), "service_date", CUTS), "service_date")


@query(f"""WITH {LEGS_LINEITEM}, s AS (SELECT * FROM flown WHERE del15 IS NOT NULL), c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (del15)::DOUBLE AS l FROM s)
SELECT del15, count(*) AS rows, round(any_value(n / (2 * CASE WHEN del15 THEN l ELSE n - l END)), 9) AS weight FROM s, c GROUP BY del15""")
def class_weights(spark, d):
    legs = legs_lineitem(spark, d).where("del15 IS NOT NULL").withColumn("label", F.col("del15").cast("int"))
    return learn.balanced_weights(legs, "label").groupBy("del15").agg(F.count("*").alias("rows"), F.round(F.min("weight"), 9).alias("weight"))


def _parts(spark, d, *names):
    """The named parts of the mart with what models take; it is written once, as models and metrics read it many times. Weights are balanced in the fit part."""
    labelled = lambda legs: learn.time_split(legs.withColumn("label", F.col("del15").cast("double")), "service_date", CUTS)
    counted = labelled(legs_lineitem(spark, d).where("del15 IS NOT NULL")).where("part = 'fit'")
    mart = labelled(features(spark, d)).where(F.col("part").isin(*names)).withColumn("carrier_name", F.col("carrier").cast("string"))
    weight = F.when(F.col("part") == "fit", F.col("weight")).otherwise(1.0)
    kept = learn.balanced_weights(mart, "label", counted).select("flight_number", "line", "carrier", "arr_delay", "del15", "label", weight.alias("weight"), *NUMBERS, *CATEGORIES, "part")
    written = materialise(kept, "learn-parts", ["part"])
    return [written.where(F.col("part") == name) for name in names]


@query()
def logistic_scores(spark, d):
    fit, test = _parts(spark, d, "fit", "test")
    model = learn.classifier("logistic", NUMBERS, CATEGORIES).fit(fit)
    return learn.probabilities(model, test).select("flight_number", "line", "carrier", F.round("p", 6).alias("p"), "del15")


@query()
def calibrated_scores(spark, d):
    fit, test = _parts(spark, d, "fit", "test")
    model = learn.classifier("logistic", NUMBERS, CATEGORIES).fit(fit)
    slope, intercept = learn.fit_platt(learn.probabilities(model, fit))
    scored = learn.probabilities(model, test).withColumn("y", F.col("del15"))
    raw = evaluate.calibration_errors(scored).withColumn("calibration", F.lit("raw"))
    after = evaluate.calibration_errors(scored.withColumn("p", platt(F.col("p"), slope, intercept))).withColumn("calibration", F.lit("platt"))
    return raw.unionByName(after)


@query()
def model_search(spark, d):
    fit, validation = _parts(spark, d, "fit", "validation")
    candidates = {"logistic": learn.classifier("logistic", NUMBERS, CATEGORIES), "forest_8": learn.classifier("forest", NUMBERS, CATEGORIES, numTrees=8, maxDepth=4), "boosted_4": learn.classifier("boosted", NUMBERS, CATEGORIES, maxIter=4, maxDepth=3)}
    return learn.search(fit, validation, candidates)
