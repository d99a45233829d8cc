"""Hyper-parameter search for gradient-boosted trees of Spark ML."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .space import HyperparameterSpace, ParzenSampler


def stack(train: DataFrame, validation: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """The rows a final model is fitted on."""
    out = train
    for more in (validation, test):
        out = out if more is None else out.unionByName(more)
    return out


@dataclass(frozen=True)
class Tuned:
    """The final model with the best parameters, their test score, and every trial."""

    model: Any
    params: dict[str, Any]
    score: float
    trials: list[tuple[dict[str, Any], float]]

    def importances(self, features: list[str]) -> dict[str, float]:
        return dict(zip(features, map(float, self.model.featureImportances.toArray()), strict=True))


class OneVsRest:
    """Boosted trees for each class 0..k-1 against the others; shares of their probabilities add up to one."""

    def __init__(self, models: list, label: str):
        self.models, self.label = models, label

    @classmethod
    def fit(cls, make, df: DataFrame, label: str, classes: int) -> OneVsRest:
        rest = [make().fit(df.withColumn(label, (F.col(label) == i).cast("double"))) for i in range(classes)]
        return cls([m.setPredictionCol(f"_told{i}").setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_share{i}") for i, m in enumerate(rest)], label)

    def transform(self, df: DataFrame) -> DataFrame:
        columns, made = df.columns, df
        for m in self.models:
            made = m.transform(made)
        shares = F.transform(F.array(*[vector_to_array(f"_share{i}") for i in range(len(self.models))]), lambda p: p[1])
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        made = made.withColumn("_shares", F.transform(shares, lambda x: x / total))
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return made.select(*columns, array_to_vector("_shares").alias("probability"), best.alias("prediction"))

    @property
    def getNumTrees(self) -> int:
        return max(m.getNumTrees for m in self.models)

    @property
    def featureImportances(self):
        return Vectors.dense(sum(m.featureImportances.toArray() for m in self.models) / len(self.models))

    def evaluateEachIteration(self, df: DataFrame) -> list[float]:
        """The mean loss over classes after each round; a class that stopped early keeps its last."""
        runs = [list(m.evaluateEachIteration(df.withColumn(self.label, (F.col(self.label) == i).cast("double")))) for i, m in enumerate(self.models)]
        longest = max(map(len, runs))
        return [sum(r[min(k, len(r) - 1)] for r in runs) / len(runs) for k in range(longest)]


class _Maker:
    def __init__(self, make, label: str, classes: int):
        self.make, self.label, self.classes = make, label, classes

    def fit(self, df: DataFrame) -> OneVsRest:
        return OneVsRest.fit(self.make, df, self.label, self.classes)


def _search(kind: str, make, score, better, train, test, validation, features, label, space, n_trials, final_fit_data, seed) -> Tuned:
    if final_fit_data not in ("train", "train_val", "train_val_test"):
        raise ValueError(f"unknown final_fit_data {final_fit_data!r}")
    if validation is None and final_fit_data != "train":
        raise ValueError("there is no validation table to fit the final model on")
    space = (space or HyperparameterSpace.default(kind))
    if space.kind != kind:
        raise ValueError(f"the space is for a {space.kind}, the model is a {kind}")
    space = space.with_defaults()
    together = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    ready = lambda df, held: together.transform(df.select(*features, F.col(label).cast("double").alias(label))).select("_features", label, F.lit(held).alias("_held"))
    fitted_on = ready(train, False) if validation is None else ready(train, False).unionByName(ready(validation, True))
    fitted_on, scored_on = fitted_on.persist(), ready(test, False).persist()
    sampler, trials = ParzenSampler(space, better, seed), []
    try:
        for _ in range(n_trials):
            params = sampler.ask()
            model = make(params, validation is not None).fit(fitted_on)
            trials.append((params, score(model.transform(scored_on)), getattr(model, "getNumTrees", None)))
            sampler.tell(params, trials[-1][1])
        best = (max if better else min)(trials, key=lambda t: t[1])
        params = dict(best[0])
        if best[2]:
            params["maxIter"] = int(best[2])
        parts = {"train": (train,), "train_val": (train, validation), "train_val_test": (train, validation, test)}[final_fit_data]
        final = make(params, False).fit(ready(stack(*parts), False))
    finally:
        fitted_on.unpersist()
        scored_on.unpersist()
    return Tuned(final, params, best[1], [t[:2] for t in trials])


def fit_gbt_regressor(train: DataFrame, test: DataFrame, features: list[str], label: str, validation: DataFrame | None = None, space: HyperparameterSpace | None = None,
                      n_trials: int = 100, metric: str = "rmse", final_fit_data: str = "train", seed: int = 42) -> Tuned:
    """Parzen search: trials are fitted on train, stopped early by validation, scored on test; the best
    parameters are fitted again on ``final_fit_data``."""
    if metric not in metrics.REGRESSION:
        raise ValueError(f"unknown metric {metric!r}")

    def make(params, held):
        model = GBTRegressor(featuresCol="_features", labelCol=label, seed=seed, **params)
        return model.setValidationIndicatorCol("_held") if held else model

    def score(df):
        return metrics.regression_metrics(df, label, "prediction").first()[metric]

    return _search("regressor", make, score, metrics.REGRESSION[metric], train, test, validation, features, label, space, n_trials, final_fit_data, seed)


def fit_gbt_classifier(train: DataFrame, test: DataFrame, features: list[str], label: str, validation: DataFrame | None = None, space: HyperparameterSpace | None = None,
                       n_trials: int = 100, metric: str = "f1", final_fit_data: str = "train", seed: int = 42) -> Tuned:
    """As for regressors. Labels are 0..k-1; more than two classes are boosted each against the others."""
    if metric not in metrics.CLASSIFICATION:
        raise ValueError(f"unknown metric {metric!r}")
    classes = int(train.agg(F.max(F.col(label).cast("int"))).first()[0] or 0) + 1

    def one(params, held):
        model = GBTClassifier(featuresCol="_features", labelCol=label, seed=seed, **params)
        return model.setValidationIndicatorCol("_held") if held else model

    def make(params, held):
        return one(params, held) if classes <= 2 else _Maker(lambda: one(params, held), label, classes)

    def score(df):
        if metric in ("roc_auc", "log_loss"):
            return probability_score(df, metric, label)
        return metrics.classification_metrics(df, label, "prediction", positive=1.0 if classes == 2 else None).first()[metric]

    return _search("classifier", make, score, metrics.CLASSIFICATION[metric], train, test, validation, features, label, space, n_trials, final_fit_data, seed)


def probability_score(df: DataFrame, metric: str, label: str) -> float:
    """roc_auc or log_loss of Spark ML's ``probability``; the area over more than two classes is the mean
    of each against the rest, classes without cases or without others left out (NaN if none is left)."""
    rows = df.select(F.col(label).cast("int").alias("y"), vector_to_array("probability").alias("p")).where("y is not null")
    k = rows.select(F.size("p").alias("k")).first()
    if k is None:
        return float("nan")
    if metric == "log_loss":
        # a class that training lacks has no probability
        own = F.coalesce(F.get("p", F.col("y")), F.lit(0.0))
        return rows.select(F.lit(1).alias("y_true"), own.alias("y_proba")).transform(metrics.log_loss).first()[0]
    areas = [metrics.roc_auc(rows.select((F.col("y") == i).cast("int").alias("y_true"), F.get("p", F.lit(i)).alias("y_proba"))).first()[0]
             for i in ((1,) if k[0] == 2 else range(k[0]))]
    known = [a for a in areas if a is not None]
    return sum(known) / len(known) if known else float("nan")


def learning_curve(model, df: DataFrame, features: list[str], label: str) -> list[float]:
    """The loss after each boosting round."""
    ready = VectorAssembler(inputCols=features, outputCol="_features").transform(df.withColumn(label, F.col(label).cast("double")))
    return list(model.evaluateEachIteration(ready, "squared") if "Regression" in type(model).__name__ else model.evaluateEachIteration(ready))
