"""The learned score: gradient-boosted trees over the nine components, in place of their fixed weights."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("explicit", "recency", "frequency", "sentiment", "engagement", "references", "confidence", "source", "novelty")


def fit(examples: DataFrame, label: str = "label", trees: int = 20, depth: int = 4) -> PipelineModel:
    """Fits on examples with all FEATURES and a label; rows where any is null are left out."""
    x = examples.dropna(subset=[*FEATURES, label])
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_p", maxIter=trees, maxDepth=depth, seed=7)]).fit(x)


def predict(model: PipelineModel, rows: DataFrame, name: str = "ego") -> DataFrame:
    """The rows with the model's score, between 0 and 1; a null feature counts as one half."""
    given = [c for c in rows.columns if c not in FEATURES]
    filled = rows.select(*given, *(F.coalesce(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in FEATURES))
    return model.transform(filled).withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p")))).drop("_x", "_p")
