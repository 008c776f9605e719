"""Scoring models on Spark ML: boosted trees for both stages, isotonic calibration.

Trees grow by level, so depth stands in for a number of leaves; probabilities, and the
thresholds tuned on them, differ from those of leaf-wise boosters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosting:
    trees: int = 60
    depth: int = 6
    step: float = 0.1
    least_rows: int = 20
    rows_share: float = 0.85
    features_share: float = 0.85  # tried at each node
    seed: int = 42


STAGE_ONE = Boosting()
STAGE_TWO = Boosting(trees=50, depth=5)
DEVELOPMENT = Boosting(trees=40, depth=5, step=0.08)


def train(pairs: DataFrame, features: list[str], how: Boosting = STAGE_ONE, label: str = "label") -> PipelineModel:
    booster = GBTClassifier(labelCol=label, maxIter=how.trees, maxDepth=how.depth, stepSize=how.step, minInstancesPerNode=how.least_rows, subsamplingRate=how.rows_share, featureSubsetStrategy=str(how.features_share), seed=how.seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), booster]).fit(pairs.withColumn(label, F.col(label).cast("double")))


def score(pairs: DataFrame, model: PipelineModel, places: int = 6) -> DataFrame:
    """Adds probability of label 1."""
    found = model.transform(pairs)
    return found.withColumn("p1", F.round(vector_to_array("probability")[1], places)).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("p1", "probability")


def cross_score(rows: DataFrame, features: list[str], how: Boosting = STAGE_ONE, label: str = "label") -> DataFrame:
    """Rows of each half (A, B) scored by a model trained on the other half, so that a later stage
    learns from scores as it will meet them."""
    a, b = rows.where("half = 'A'"), rows.where("half = 'B'")
    return score(b, train(a, features, how, label)).unionByName(score(a, train(b, features, how, label)))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, features: list[str], n: int = 15) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:n]


def area_under_precision_recall(scored: DataFrame, label: str = "label") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", metricName="areaUnderPR").evaluate(scored.withColumn(label, F.col(label).cast("double")))


def average_precision(scored: DataFrame, label: str = "label") -> DataFrame:
    """(average_precision): sum over distinct scores of precision x gain in recall; 0 without a
    positive label.  Scores are first reduced to their distinct values with counts, and running
    sums are taken inside score ranges of 1/1024, on top of those of the ranges (1025 rows)."""
    per = scored.groupBy("probability").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    per = per.withColumn("part", F.floor(F.col("probability") * 1024))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("hits").alias("ph"))
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("pn", "ph")))
    order = Window.partitionBy("part").orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.join(F.broadcast(parts), "part").withColumns({"seen": F.sum("n").over(order) + F.col("pn"), "got": F.sum("hits").over(order) + F.col("ph")})
    return run.agg(F.coalesce(F.round(F.try_divide(F.sum(F.round(F.col("got") / F.col("seen") * F.col("hits"), 12)), F.sum("hits")), 6), F.lit(0.0)).alias("average_precision"))


def calibrate(train_rows: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """Isotonic fit of label on probability, applied to rows as `calibrated`; constant beyond the
    range seen."""
    fit = IsotonicRegression(featuresCol="probability", labelCol=label, predictionCol="calibrated").fit(train_rows.select("probability", F.col(label).cast("double").alias(label)))
    return fit.transform(rows)


def cross_calibrate(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each half (A, B) calibrated by the other half's fit."""
    a, b = rows.where("half = 'A'"), rows.where("half = 'B'")
    return calibrate(b, a, label).unionByName(calibrate(a, b, label))
