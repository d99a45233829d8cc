"""Classes that hold a table once and give the data of its charts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decomposition, metrics, plotdata
from .summary import summarize


class EDAPlotter:
    """Charts of any table."""

    def __init__(self, df: DataFrame):
        self.df = df

    def summary(self, columns: Sequence[str] | None = None) -> DataFrame:
        return summarize(self.df, columns)

    def missing_values(self) -> DataFrame:
        return plotdata.missing_values(self.df)

    def corr_heatmap(self, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
        return plotdata.correlations(self.df, columns, method)

    def category_counts(self, column: str, top_k: int = 10) -> DataFrame:
        return plotdata.category_counts(self.df, column, top_k)

    def feature_target(self, feature: str, target: str, n_bins: int = 10, top_k: int = 10) -> DataFrame:
        return plotdata.feature_target(self.df, feature, target, n_bins, top_k)

    def histogram(self, column: str, **options: Any) -> DataFrame:
        return plotdata.histogram(self.df, column, **options)

    def kde(self, column: str, **options: Any) -> DataFrame:
        return plotdata.kde(self.df, column, **options)

    def boxplot(self, column: str, **options: Any) -> DataFrame:
        return plotdata.boxplot(self.df, column, **options)

    def violin(self, column: str, **options: Any) -> tuple[DataFrame, DataFrame]:
        return plotdata.violin(self.df, column, **options)


class TimeSeriesPlotter:
    """Charts of a series."""

    def __init__(self, df: DataFrame, ts: str = "ts", val: str = "val"):
        self.df = df.select(F.col(ts).alias("ts"), F.col(val).alias("val"))

    def grid(self) -> DataFrame:
        return plotdata.timeseries_grid(self.df)

    def gaps(self, interval: int | None = None) -> tuple[DataFrame, DataFrame]:
        return plotdata.gaps(self.df, interval=interval), plotdata.gap_totals(self.df, interval=interval)

    def seasonal_profile(self, rows: str, columns: str | None = None, agg: str = "mean") -> DataFrame:
        return plotdata.seasonal_profile(self.df, rows, columns, agg)

    def autocorrelation(self, lags: int = 50) -> DataFrame:
        return plotdata.autocorrelation(self.df, lags)

    def partial_autocorrelation(self, lags: int = 50) -> list[float]:
        return plotdata.partial_autocorrelation(self.df, lags)

    def rolling_stats(self, window: int | str | None = None) -> DataFrame:
        return plotdata.rolling_stats(self.df, window if window is not None else plotdata.default_period(plotdata.infer_interval(self.df)))

    def decomposition(self, periods: Sequence[int] | None = None, robust: bool = False) -> DataFrame:
        step = plotdata.infer_interval(self.df)
        return decomposition.decompose(plotdata.resample(self.df, step), periods or [plotdata.default_period(step)], robust=robust)


class ClassifierPlotter:
    """Charts of a classifier: labels, and predicted labels or an array of probabilities by class."""

    def __init__(self, df: DataFrame, y_true: str = "y_true", y_pred: str | None = None, y_proba: str | None = None, classes: Sequence[Any] | None = None):
        if y_pred is None and y_proba is None:
            raise ValueError("y_pred or y_proba is needed")
        self.classes = list(classes) if classes is not None else [r[0] for r in df.select(y_true).distinct().orderBy(y_true).collect()]
        self.proba = y_proba
        told = F.col(y_pred) if y_pred else metrics.argmax_class(F.col(y_proba), self.classes)
        self.df = df.select(F.col(y_true).alias("y_true"), told.alias("y_pred"), *([F.col(y_proba).alias("proba")] if y_proba else []))

    def confusion_matrix(self) -> DataFrame:
        return metrics.confusion(self.df)

    def _each(self, make) -> dict[Any, DataFrame]:
        if self.proba is None:
            raise ValueError("y_proba is needed")
        if len(self.classes) > 8:
            raise ValueError("more than 8 classes")
        which = list(enumerate(self.classes))[1:] if len(self.classes) == 2 else enumerate(self.classes)
        return {k: make(self.df.select((F.col("y_true") == k).cast("int").alias("y_true"), F.element_at("proba", i + 1).alias("y_proba"))) for i, k in which}

    def roc_curves(self) -> dict[Any, DataFrame]:
        return self._each(metrics.roc_curve)

    def macro_roc(self) -> tuple[list[tuple[float, float]], float]:
        """The mean ROC curve over classes and the area under it."""
        points = metrics.macro_roc(list(self.roc_curves().values()))
        return points, metrics.area(points)

    def precision_recall(self) -> dict[Any, DataFrame]:
        return self._each(metrics.pr_curve)

    def calibration(self, n_bins: int = 10) -> dict[Any, DataFrame]:
        return self._each(lambda df: plotdata.calibration(df, n_bins=n_bins))

    def diagnostics(self) -> dict[str, Any]:
        out: dict[str, Any] = {"confusion_matrix": self.confusion_matrix()}
        return out | {"roc": self.roc_curves(), "pr": self.precision_recall(), "calibration": self.calibration()} if self.proba else out


class RegressionPlotter:
    """Charts of a regression."""

    def __init__(self, df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", ts: str | None = None):
        self.df = df.select(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"), *([F.col(ts).alias("ts")] if ts else []))

    def diagnostics(self) -> dict[str, DataFrame]:
        return {"metrics": metrics.regression_metrics(self.df), "bins": plotdata.residual_bins(self.df), "residual": plotdata.residual_summary(self.df)}

    def forecast(self) -> DataFrame:
        return self.df.join(plotdata.forecast_breaks(self.df), "ts").orderBy("ts")


class ModelPlotter:
    """Charts of a tuned model."""

    def __init__(self, tuned, features: Sequence[str], label: str):
        self.tuned, self.features, self.label = tuned, list(features), label

    def feature_importance(self, top_k: int = 10) -> list[tuple[str, float]]:
        return plotdata.feature_importance(self.tuned.importances(self.features), top_k)

    def learning_curves(self, **tables: DataFrame) -> dict[str, list[float]]:
        from ..tuning.search import learning_curve

        return {name: learning_curve(self.tuned.model, df, self.features, self.label) for name, df in tables.items()}
