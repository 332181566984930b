"""Time splits, MLlib pipelines, calibration and search."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions.scalars import logit
from lathe.operators.evaluate import ranking_metrics
from lathe.session import materialise


def time_split(df: DataFrame, day: str, cutoffs: Mapping[str, str]) -> DataFrame:
    """df with `part`: the first name whose date (exclusive) is after the row's day, else 'test'."""
    part = F.lit("test")
    for name, until in reversed(list(cutoffs.items())):
        part = F.when(F.col(day) < F.lit(until).cast("date"), name).otherwise(part)
    return df.withColumn("part", F.when(F.col(day).isNotNull(), part))


def split_proof(df: DataFrame, day: str) -> DataFrame:
    """One row per part: rows, first and last day; parts don't overlap if each starts after the one before ends."""
    return df.groupBy("part").agg(F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def balanced_weights(df: DataFrame, label: str, counted: DataFrame | None = None) -> DataFrame:
    """df with weight n / (2 * n of the row's class), as in counted, which may be a plainer table of the same rows; else as in df."""
    counted = df if counted is None else counted
    n, late = counted.agg(F.count(label)).scalar(), counted.agg(F.count_if(F.col(label) == 1)).scalar()
    return df.withColumn("weight", n / (2.0 * F.when(F.col(label) == 1, late).otherwise(n - late)))


def _prepare(numbers: Sequence[str], categories: Sequence[str], scaled: bool) -> list:
    filled = [f"{c}_filled" for c in numbers]
    stages = [Imputer(strategy="median", inputCols=list(numbers), outputCols=filled)]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    if not scaled:
        return [*stages, VectorAssembler(inputCols=[*filled, *[f"{c}_index" for c in categories]], outputCol="features")]
    stages += [VectorAssembler(inputCols=filled, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    stages += [OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep")] if categories else []
    return [*stages, VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in categories]], outputCol="features")]


def classifier(kind: str, numbers: Sequence[str], categories: Sequence[str], label: str = "label", **settings: object) -> Pipeline:
    """'logistic', 'forest' or 'boosted', with imputing, scaling and encoding; rows weigh `weight`."""
    last = {
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol="weight", maxIter=50, **settings),
        "forest": lambda: RandomForestClassifier(labelCol=label, weightCol="weight", seed=7, maxBins=64, **settings),
        "boosted": lambda: GBTClassifier(labelCol=label, weightCol="weight", seed=7, maxBins=64, **settings),
    }[kind]()
    return Pipeline(stages=[*_prepare(numbers, categories, kind == "logistic"), last])


def regressor(numbers: Sequence[str], categories: Sequence[str], label: str, **settings: object) -> Pipeline:
    return Pipeline(stages=[*_prepare(numbers, categories, False), GBTRegressor(labelCol=label, seed=7, maxBins=64, **settings)])


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p, the probability of label 1."""
    return model.transform(df).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))


def fit_platt(scored: DataFrame, label: str = "label") -> tuple[float, float]:
    """Slope and intercept of the logistic curve over logit(p); raises if the slope isn't above zero, which would reverse ranks."""
    one = VectorAssembler(inputCols=["z"], outputCol="features").transform(scored.select(logit(F.col("p")).alias("z"), F.col(label).cast("double").alias("label")))
    model = LogisticRegression(maxIter=100).fit(one)
    if model.coefficients[0] <= 0:
        raise ValueError("calibration would reverse the ranking")
    return float(model.coefficients[0]), float(model.intercept)


def fit_isotonic(scored: DataFrame, label: str = "label"):
    return IsotonicRegression(featuresCol="p", labelCol="label").fit(scored.select("p", F.col(label).cast("double").alias("label")))


def importances(model: PipelineModel, numbers: Sequence[str], categories: Sequence[str]) -> list[tuple[str, float]]:
    """Names with their importance, or coefficient by size, largest first; an encoded category has one for each of its values."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        names, values = [*numbers, *categories], last.featureImportances.toArray()
    else:
        known = {stage.getOutputCol().removesuffix("_index"): [*stage.labels, "unknown"] for stage in model.stages if isinstance(stage, StringIndexerModel)}
        names, values = [*numbers, *(f"{c}={value}" for c in categories for value in known[c])], last.coefficients.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def search(train: DataFrame, validation: DataFrame, candidates: Mapping[str, Pipeline]) -> DataFrame:
    """One row per candidate with its metrics on validation rows, best first; only the winner should see test rows."""
    rows = []
    for name, pipeline in candidates.items():
        scored = probabilities(pipeline.fit(train), validation).select("p", (F.col("label") == 1).alias("y"))
        rows.append(ranking_metrics(scored).select(F.lit(name).alias("candidate"), "n", "average_precision", "roc_auc"))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.orderBy(F.desc("average_precision"), "candidate")


def stops_early(pipeline: Pipeline, indicator: str, tolerance: float = 0.001) -> Pipeline:
    """The same pipeline whose boosted last stage adds trees only while rows marked by `indicator` gain at least tolerance of the loss."""
    *before, last = pipeline.getStages()
    return Pipeline(stages=[*before, last.copy().setValidationIndicatorCol(indicator)._set(validationTol=tolerance)])


def search_within(
    train: DataFrame, validation: DataFrame, test: DataFrame, candidates: Mapping[str, Pipeline], seconds: float, clock: Callable[[], float] = time.monotonic
) -> tuple[DataFrame, DataFrame]:
    """(report, scored): candidates fitted in their order until the budget of seconds is spent, one at least; the best on validation rows alone scores the test rows.

    report: candidate, n, average_precision, roc_auc (null where it wasn't fitted any more), fitted, chosen; of equals the first by name is chosen. scored: test with p of
    the chosen model. Test rows are met once, by that model.
    """
    start, models, parts = clock(), {}, []
    for name, pipeline in candidates.items():
        if models and clock() - start >= seconds:
            break
        models[name] = pipeline.fit(train)
        scored = probabilities(models[name], validation).select("p", (F.col("label") == 1).alias("y"))
        parts.append(materialise(ranking_metrics(scored).select(F.lit(name).alias("candidate"), "n", "average_precision", "roc_auc"), "search"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    best = report.orderBy(F.desc_nulls_last("average_precision"), "candidate").first().candidate
    names = train.sparkSession.createDataFrame([(n,) for n in candidates], "candidate string")
    out = names.join(report, "candidate", "left").withColumns({"fitted": F.col("n").isNotNull(), "chosen": F.col("candidate") == best})
    return out, probabilities(models[best], test)
