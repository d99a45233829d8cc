"""A seasonal forecasting model: bent trend, Fourier seasons and regressors, fitted as a Bayesian ridge.

Fitting needs only sums of products of the features, a bounded number whatever the rows; tasks add up
their rows' sums and the driver solves for the coefficients. Prior scales enter the solution alone, so
trials that differ in nothing else share their sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from statistics import NormalDist
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import micros
from ..operators import metrics
from ..operators.plotdata import infer_interval
from .space import HyperparameterSpace, ParzenSampler, rolling_origins, weighted_score

DAY = 86_400.0
EPOCH = datetime(1970, 1, 1)
#: Name, period in days, Fourier order, days of history that switch it on, longest step in days.
SEASONS = (("yearly", 365.25, 10, 730.0, math.inf), ("weekly", 7.0, 3, 14.0, 7.0), ("daily", 1.0, 4, 2.0, 1.0))
#: Trend and seasons of a multiplicative model are fitted in turn this often.
ROUNDS = 3
#: Parts of the horizon whose errors are scored apart.
HORIZON_PARTS = 100


def _seconds(ds: pd.Series) -> np.ndarray:
    return ds.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


@dataclass(frozen=True)
class SeasonalModel:
    """Parameters, and what ``fit`` learns. Changes of slope stand at even distances over the first
    ``changepoint_range`` of the history; priors are normal with the given scales."""

    regressors: tuple[str, ...] = ()
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    seasonality_mode: str = "additive"
    interval_width: float = 0.8
    seasons: tuple[tuple[float, int], ...] | None = None
    start: float = 0.0
    span: float = 1.0
    scale: float = 1.0
    centers: tuple[tuple[float, float], ...] = ()
    coefficients: np.ndarray | None = None
    sigma: float = 0.0

    def __post_init__(self):
        if self.seasonality_mode not in ("additive", "multiplicative"):
            raise ValueError(f"unknown seasonality_mode {self.seasonality_mode!r}")
        if not 0 < self.interval_width < 1 or not 0 < self.changepoint_range <= 1 or self.n_changepoints < 0:
            raise ValueError("interval_width, changepoint_range or n_changepoints is out of range")

    def _trend(self, seconds: np.ndarray) -> np.ndarray:
        t = (seconds - self.start) / self.span
        bends = np.arange(1, self.n_changepoints + 1) / max(self.n_changepoints, 1) * self.changepoint_range
        return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - bends, 0)])

    def _rest(self, seconds: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
        parts = [np.empty((len(seconds), 0))]
        for period, order in self.seasons or ():
            angle = 2 * np.pi * seconds[:, None] / (period * DAY) * np.arange(1, order + 1)
            parts += [np.sin(angle), np.cos(angle)]
        for name, (center, spread) in zip(self.regressors, self.centers, strict=True):
            parts.append((frame[name].to_numpy(float)[:, None] - center) / spread)
        return np.hstack(parts)

    def _prior(self) -> tuple[np.ndarray, np.ndarray]:
        """Precisions of the trend's and of the other coefficients."""
        trend = np.concatenate([[1 / 25, 1 / 25], np.full(self.n_changepoints, self.changepoint_prior_scale ** -2.0)])
        waves = sum(2 * order for _, order in self.seasons or ())
        rest = np.concatenate([np.full(waves, self.seasonality_prior_scale ** -2.0), np.full(len(self.regressors), self.holidays_prior_scale ** -2.0)])
        return trend, rest

    def _products(self, df: DataFrame, design) -> np.ndarray:
        """Sums over rows of the products of [design, target], of which ``design`` makes both."""
        model = self

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for frame in frames:
                both = np.column_stack(design(model, _seconds(frame["ds"]), frame))
                total = both.T @ both if total is None else total + both.T @ both
            if total is not None:
                yield pd.DataFrame({"place": np.arange(total.size), "v": total.ravel()})

        got = df.mapInPandas(add, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()  # features squared
        side = math.isqrt(len(got))
        return np.array([r["v"] for r in sorted(got, key=lambda r: r["place"])]).reshape(side, side)

    def fit(self, df: DataFrame, interval: float | None = None, sums: dict | None = None) -> SeasonalModel:
        """The model of the history ``df`` (ds, y, regressors). Rows with a null or NaN in them count for
        nothing; fewer than two instants are an error. ``interval``: seconds between rows, else the modal
        step. ``sums`` keeps sums of products for further fits of the same history."""
        used = _complete(df, ["ds", "y", *self.regressors])
        sums = {} if sums is None else sums
        if "facts" not in sums:
            sums["facts"] = used.agg(F.min("ds"), F.max("ds"), F.max(F.abs("y")), F.count("*"),
                                     *[f(F.col(f"`{r}`").cast("double")) for r in self.regressors for f in (F.avg, F.stddev_samp)]).first()
        first, last, top, n, *rest = sums["facts"]
        if n == 0 or first == last:
            raise ValueError("a history of two instants at least is needed")
        if "interval" not in sums:
            sums["interval"] = interval or infer_interval(used, "ds") / 1e6
        span = (last - first).total_seconds()
        seasons = self.seasons
        if seasons is None:
            seasons = tuple((period, order) for _, period, order, least, step in SEASONS if span >= least * DAY and sums["interval"] < step * DAY)
        model = replace(self, seasons=seasons, start=(first - EPOCH).total_seconds(), span=span, scale=float(top) or 1.0,
                        centers=tuple((a, b if b else 1.0) for a, b in zip(rest[::2], rest[1::2], strict=True)))
        trend_prior, rest_prior = model._prior()
        key = (model.n_changepoints, model.changepoint_range, seasons)
        if key not in sums:
            sums[key] = model._products(used, lambda m, s, f: (m._trend(s), m._rest(s, f), f["y"].to_numpy(float) / m.scale))
        found, sigma = _ridge(sums[key], np.concatenate([trend_prior, rest_prior]), n)
        if self.seasonality_mode == "multiplicative" and len(rest_prior):
            k = len(trend_prior)
            level = max(abs(found[0] + found[1] / 2), 1e-9)
            trend, rest = found[:k], found[k:] / level
            for _ in range(ROUNDS):
                trend, sigma = _ridge(model._products(used, lambda m, s, f, r=rest: (m._trend(s) * (1 + m._rest(s, f) @ r)[:, None], f["y"].to_numpy(float) / m.scale)), trend_prior, n)
                rest, sigma = _ridge(model._products(used, lambda m, s, f, g=trend: (m._rest(s, f) * (m._trend(s) @ g)[:, None], f["y"].to_numpy(float) / m.scale - m._trend(s) @ g)), rest_prior, n)
            found = np.concatenate([trend, rest])
        return replace(model, coefficients=found, sigma=sigma)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with trend, yhat, yhat_lower and yhat_upper; null where ds or a regressor is null.
        The interval widens beyond the history as the slope may change as often and as much as before."""
        if self.coefficients is None:
            raise RuntimeError("the model is not fitted")
        taken = {"trend", "yhat", "yhat_lower", "yhat_upper"} & set(df.columns)
        if taken:
            raise ValueError(f"columns {sorted(taken)} exist already")
        z = NormalDist().inv_cdf(0.5 + self.interval_width / 2)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                whole = frame["ds"].notna().to_numpy()
                seconds = _seconds(frame["ds"].where(whole, pd.Timestamp(0)))
                k = 2 + self.n_changepoints
                trend = self._trend(seconds) @ self.coefficients[:k]
                rest = self._rest(seconds, frame) @ self.coefficients[k:]
                mean = trend * (1 + rest) if self.seasonality_mode == "multiplicative" else trend + rest
                ahead = np.maximum((seconds - self.start) / self.span - 1, 0)
                bend = np.abs(self.coefficients[2:k]).mean() if k > 2 else 0.0
                half = z * np.sqrt(self.sigma ** 2 + self.n_changepoints / self.changepoint_range * 2 * bend ** 2 * ahead ** 3 / 3)
                out = {"trend": trend, "yhat": mean, "yhat_lower": mean - half, "yhat_upper": mean + half}
                yield frame.assign(**{c: np.where(whole, v * self.scale, np.nan) for c, v in out.items()})

        names = ["trend", "yhat", "yhat_lower", "yhat_upper"]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{n} double" for n in names])
        return df.mapInPandas(run, schema).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.select(F.col("ds").cast("timestamp_ntz").alias("ds"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns if c != "ds"])
    for c in columns:
        out = out.where(F.col(f"`{c}`").isNotNull() & (F.lit(True) if c == "ds" else ~F.isnan(F.col(f"`{c}`"))))
    return out


def _ridge(products: np.ndarray, precision: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(coefficients, noise): the most likely ones, the noise from the residuals of the solution before."""
    a, b, c = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    sigma2, found = 0.25, np.zeros(len(b))
    for _ in range(10):
        found = np.linalg.solve(a + sigma2 * np.diag(precision), b)
        sigma2 = max((c - 2 * found @ b + found @ a @ found) / n, 1e-10)
    return found, math.sqrt(sigma2)


@dataclass(frozen=True)
class TunedForecast:
    """The final model, its parameters, its metrics on the test rows, and every trial."""

    model: SeasonalModel
    params: dict[str, Any]
    metrics: dict[str, float]
    trials: list[tuple[dict[str, Any], float]]


def fit_seasonal_model(y: DataFrame, y_test: DataFrame, regressors: Sequence[str] | None = None, interval_width: float = 0.8, space: HyperparameterSpace | None = None,
                       n_trials: int = 100, final_fit_data: str = "train", metric: str = "mape", horizon: timedelta = timedelta(days=180), seed: int = 42) -> TunedForecast:
    """Parzen search: each trial is scored by rolling-origin validation inside ``y``, later parts of the
    horizon weighing up to twice the first; the best is fitted on ``y``, or on ``y`` and ``y_test``."""
    if metric not in ("mape", "mae", "rmse", "mse"):
        raise ValueError(f"unknown metric {metric!r}")
    if final_fit_data not in ("train", "train_val", "train_test", "train_val_test"):
        raise ValueError(f"unknown final_fit_data {final_fit_data!r}")
    others = [c for c in y.columns if c not in ("ds", "y")]
    names = others if regressors is None else list(regressors)
    if set(names) - set(others):
        raise ValueError(f"no columns {sorted(set(names) - set(others))}")
    columns = ["ds", "y", *names]
    train, test = (_complete(df, columns) for df in (y, y_test))
    first, last = train.agg(F.min("ds"), F.max("ds")).first()
    if first is None:
        raise ValueError("no rows to train on")
    if final_fit_data.endswith("test"):
        begins = test.agg(F.min("ds")).first()[0]
        if begins is not None and begins <= last:
            raise ValueError(f"final_fit_data={final_fit_data!r} needs y_test to start after y ends")
    step = infer_interval(train, "ds") / 1e6
    space = space or HyperparameterSpace.default("seasonal")
    span = (last - first).total_seconds()
    longest = max((period for _, period, _, least, most in SEASONS if span >= least * DAY and step < most * DAY), default=0.0)
    ends = [first + timedelta(seconds=x) for x in rolling_origins(span, horizon.total_seconds(), longest * DAY, step=step)]
    kept: list[dict] = [{} for _ in ends]
    sampler, trials = ParzenSampler(space, False, seed), []

    def build(params):
        return SeasonalModel(tuple(names), **{**params, "interval_width": interval_width})

    for _ in range(n_trials):
        params = sampler.ask()
        parts = None
        for end, sums in zip(ends, kept, strict=True):
            model = build(params).fit(train.where(F.col("ds") <= F.lit(end)), step, sums)
            ahead = train.where((F.col("ds") > F.lit(end)) & (F.col("ds") <= F.lit(end + horizon)))
            part = F.floor((micros(F.col("ds")) - F.lit((end - EPOCH) // timedelta(microseconds=1)) - 1) * HORIZON_PARTS / F.lit(horizon / timedelta(microseconds=1)))
            told = model.predict(ahead).select(part.alias("part"), "y", "yhat")
            parts = told if parts is None else parts.unionByName(told)
        e, size = F.col("yhat") - F.col("y"), F.greatest(F.abs("y"), F.lit(2.220446049250313e-16))
        score = {"mape": F.avg(F.abs(e) / size), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mse": F.avg(e * e)}[metric]
        rows = parts.groupBy("part").agg(score.alias("score")).collect()  # HORIZON_PARTS rows
        if rows:
            trials.append((params, weighted_score([r["score"] for r in sorted(rows, key=lambda r: r["part"])])))
            sampler.tell(*trials[-1])
    if not trials:
        raise ValueError("no trial could be scored")
    best = min(trials, key=lambda t: t[1])[0]
    final = build(best).fit(train.unionByName(test) if final_fit_data.endswith("test") else train, step)
    got = metrics.regression_metrics(final.predict(test), "y", "yhat").first().asDict()
    return TunedForecast(final, {**best, "interval_width": interval_width}, got, trials)
