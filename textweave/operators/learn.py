"""Fitting, scoring, tuning and keeping models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA, BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.operators.features import Fitted, fit_transform

# Default parameters of the learning operators.
DECISION_TREE = dict(
    featuresCol="features", labelCol="label", maxDepth=5, maxBins=32, minInstancesPerNode=1, minInfoGain=0.0,
    maxMemoryInMB=256, cacheNodeIds=False, checkpointInterval=10, impurity="gini",
)
LINEAR_REGRESSION = dict(
    featuresCol="features", labelCol="label", maxIter=100, regParam=0.0, elasticNetParam=0.0, tol=1e-6,
    fitIntercept=True, standardization=False, solver="auto", aggregationDepth=2,
)
LOGISTIC_REGRESSION = dict(
    featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, regParam=0.0, elasticNetParam=0.0,
    tol=1e-6, fitIntercept=True, threshold=0.5, standardization=True, aggregationDepth=2, family="auto",
)
NAIVE_BAYES = dict(featuresCol="features", labelCol="label", weightCol="weight", smoothing=1.0)

CLUSTERERS = {
    "kmeans": KMeans, "bisecting_kmeans": BisectingKMeans, "gaussian_mixture": GaussianMixture, "lda": LDA,
}


def _with_weight(df: DataFrame, params: dict[str, Any]) -> dict[str, Any]:
    """Fit unweighted if the default weight column is not in the table."""
    if params.get("weightCol") == "weight" and "weight" not in df.columns:
        return {k: v for k, v in params.items() if k != "weightCol"}
    return params


def decision_tree(df: DataFrame, **params: Any) -> Fitted:
    return fit_transform(df, DecisionTreeClassifier, **{**DECISION_TREE, **params})


def linear_regression(df: DataFrame, **params: Any) -> Fitted:
    return fit_transform(df, LinearRegression, **{**LINEAR_REGRESSION, **params})


def logistic_regression(df: DataFrame, **params: Any) -> Fitted:
    return fit_transform(df, LogisticRegression, **_with_weight(df, {**LOGISTIC_REGRESSION, **params}))


def naive_bayes(df: DataFrame, **params: Any) -> Fitted:
    """Multinomial by default: features must not be negative, so scale them first."""
    return fit_transform(df, NaiveBayes, **_with_weight(df, {**NAIVE_BAYES, **params}))


def score(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def apply_any(transformer: Transformer, df: DataFrame) -> DataFrame:
    return transformer.transform(df)


def cluster(df: DataFrame, method: str = "kmeans", **params: Any) -> Fitted:
    if method not in CLUSTERERS:
        raise ValueError(f"unknown clustering method {method!r}: {sorted(CLUSTERERS)}")
    return fit_transform(df, CLUSTERERS[method], **params)


def rating_blocks(n_ratings: int) -> int:
    """Blocks of users, and of items, for so many ratings: 10, MLlib's number, up to about 1.5 million.

    A task holds the ratings of a block, and a buffer for each two blocks; with the third root both
    grow slowly, to 55 blocks of 4 million ratings and 70 MB of buffers at 216 million.
    """
    return max(10, round(n_ratings ** (1 / 3) / 11))


def recommend(df: DataFrame, user: str, item: str, rating: str, **params: Any) -> Fitted:
    params = {"seed": 1, "coldStartStrategy": "drop", **params}
    if not {"numUserBlocks", "numItemBlocks"} & set(params):
        blocks = rating_blocks(df.count())
        params |= {"numUserBlocks": blocks, "numItemBlocks": blocks}
    return fit_transform(df, ALS, userCol=user, itemCol=item, ratingCol=rating, **params)


def tune(
    df: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence[Any]], evaluator: Evaluator, folds: int = 3,
    train_ratio: float | None = None, seed: int = 1, parallelism: int = 1,
) -> Fitted:
    """Best parameters by cross-validation, or by one split if ``train_ratio`` is given."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    common = dict(
        estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, seed=seed, parallelism=parallelism
    )
    if train_ratio is None:
        return fit_transform(df, CrossValidator(numFolds=folds, **common))
    return fit_transform(df, TrainValidationSplit(trainRatio=train_ratio, **common))


def save_model(model: Model, path: str) -> None:
    """Keep any model, alone or as part of a pipeline, under one loadable type."""
    kept = model if isinstance(model, PipelineModel) else PipelineModel([model])
    kept.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def positive_score(df: DataFrame, probability: str = "probability", output_col: str = "score") -> DataFrame:
    """Probability of class 1 as a plain number."""
    return df.withColumn(output_col, vector_to_array(F.col(probability))[1])
