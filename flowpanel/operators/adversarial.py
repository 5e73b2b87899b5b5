"""Classifiers that try to tell synthetic homes from real ones. An AUC near 0.5 is the goal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpanel.operators.compare import SYNTHETIC
from flowpanel.plans.ranks import hash_bucket, with_weight_before
from flowpanel.session import materialize

PREDICTORS = ["mean_usage", "max_peak", "zero_proportion", "usage_variance", "p90_usage"]
# Fixed values of the evaluation.
TRAIN_SHARE = 0.8
FOLDS = 10
TREES = 500


def labelled(features: DataFrame) -> DataFrame:
    return features.withColumn("label", F.when(F.col("source") == SYNTHETIC, 1.0).otherwise(0.0))


def _ranked(df: DataFrame, stratum: str, keys: list[str], seed: int) -> DataFrame:
    """Rank in hash order within the stratum; the ranks of a large stratum come from many tasks.

    The hash is the md5 of seed and keys joined by slashes, which other engines have too.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), *keys)))
    return with_weight_before(hashed, [stratum], hash_bucket(F.col("_h")), ["_h", *keys]).drop("_h")


def stratified_split(
    df: DataFrame, share: float = TRAIN_SHARE, stratum: str = "source",
    keys: tuple[str, ...] = ("source", "home_id"), seed: int = 42,
) -> DataFrame:
    """Add `is_train`: an exact share of every stratum, chosen by a seeded hash."""
    ranked = _ranked(df, stratum, list(keys), seed)
    return ranked.withColumn("is_train", F.col("before") < F.floor(F.col("total") * share)).drop("before", "total")


def stratified_kfold(
    df: DataFrame, folds: int = FOLDS, stratum: str = "source",
    keys: tuple[str, ...] = ("source", "home_id"), seed: int = 43,
) -> DataFrame:
    """Add `fold` in [0, folds): equal folds within every stratum."""
    ranked = _ranked(df, stratum, list(keys), seed)
    fold = F.floor(F.col("before") * folds / F.col("total")).cast("int")
    return ranked.withColumn("fold", fold).drop("before", "total")


def _preparation() -> list:
    return [
        VectorAssembler(inputCols=PREDICTORS, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def normalize_predictors(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Standardise the predictors of `rows` with the mean and deviation of `train`."""
    fitted = Pipeline(stages=_preparation()).fit(train)
    scaled = fitted.transform(rows).withColumn("_v", vector_to_array("features"))
    return scaled.select(
        *[c for c in rows.columns if c not in PREDICTORS],
        *[F.col("_v")[i].alias(c) for i, c in enumerate(PREDICTORS)],
    )


@dataclass
class Fitted:
    name: str
    model: PipelineModel
    cv_auc: float
    predictions: DataFrame


def _tune(name: str, classifier, grid, train: DataFrame, test: DataFrame, folds: int, parallelism: int) -> Fitted:
    steps = Pipeline(stages=[*_preparation(), classifier])
    scorer = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    search = CrossValidator(
        estimator=steps, estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, foldCol="fold",
        parallelism=parallelism,
    )
    found = search.fit(train)
    return Fitted(name, found.bestModel, max(found.avgMetrics), found.bestModel.transform(test))


def split_and_fold(features: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """Training rows with folds and hold-out rows, written once because tuning reads them many times."""
    split = materialize(stratified_split(labelled(features)), "adversarial-split")
    train = materialize(stratified_kfold(split.where("is_train"), folds), "adversarial-train")
    return train, split.where(~F.col("is_train"))


def adversarial_rf(
    train: DataFrame, test: DataFrame, trees: int = TREES, folds: int = FOLDS,
    subsets: tuple[str, ...] = ("1", "2", "3", "4", "5"), min_rows: tuple[int, ...] = (1, 5),
    depth: int = 10, parallelism: int = 4, seed: int = 42,
) -> Fitted:
    """Random forest, tuned over predictors per split and rows per leaf by cross-validated AUC."""
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed
    )
    grid = (
        ParamGridBuilder()
        .addGrid(forest.featureSubsetStrategy, list(subsets))
        .addGrid(forest.minInstancesPerNode, list(min_rows))
        .build()
    )
    return _tune("random_forest", forest, grid, train, test, folds, parallelism)


def adversarial_gbt(
    train: DataFrame, test: DataFrame, rounds: int = TREES, folds: int = FOLDS,
    depths: tuple[int, ...] = (3, 5), rates: tuple[float, ...] = (0.05, 0.1), parallelism: int = 4, seed: int = 42,
) -> Fitted:
    """Boosted trees, tuned over depth and learning rate by cross-validated AUC."""
    boosted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, seed=seed)
    grid = ParamGridBuilder().addGrid(boosted.maxDepth, list(depths)).addGrid(boosted.stepSize, list(rates)).build()
    return _tune("boosted_trees", boosted, grid, train, test, folds, parallelism)


def adversarial_metrics(fits: list[Fitted]) -> DataFrame:
    """Hold-out AUC, accuracy and Brier score per model."""
    rows = []
    for fit in fits:
        auc = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC").evaluate(fit.predictions)
        accuracy = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(fit.predictions)
        p = vector_to_array("probability")[1]
        brier = fit.predictions.agg(F.avg((p - F.col("label")) * (p - F.col("label")))).first()[0]
        rows += [(fit.name, "roc_auc", auc), (fit.name, "accuracy", accuracy), (fit.name, "brier_class", brier)]
    return fits[0].predictions.sparkSession.createDataFrame(rows, "model string, metric string, estimate double")


def feature_importance(fits: list[Fitted]) -> DataFrame:
    """Predictor importances of the model with the higher hold-out AUC; ties go to the last one."""
    scorer = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    best = max(reversed(fits), key=lambda fit: scorer.evaluate(fit.predictions))
    weights = best.model.stages[-1].featureImportances.toArray()
    rows = [(best.name, c, float(w)) for c, w in zip(PREDICTORS, weights)]
    return best.predictions.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
