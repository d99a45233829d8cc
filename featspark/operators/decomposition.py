"""Seasonal-trend decomposition by loess, for one or several periods, a series a task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local lines through equally spaced values: tricube weights over the ``span`` nearest."""
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    weights = np.ones(n) if weights is None else weights
    q = min(span, n)
    left = np.clip(np.ceil(at - (q - 1) / 2 - 0.5).astype(int), 0, n - q)
    idx = left[:, None] + np.arange(q)
    d = np.abs(idx - at[:, None])
    reach = d.max(axis=1) + (max(span - n, 0) // 2)
    u = d / np.maximum(reach, 1e-12)[:, None]
    w = np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0) * weights[idx]
    w = np.where(w.sum(axis=1, keepdims=True) > 0, w, 1.0)
    w /= w.sum(axis=1, keepdims=True)
    xm = (w * idx).sum(axis=1)
    var = (w * (idx - xm[:, None]) ** 2).sum(axis=1)
    ym = (w * y[idx]).sum(axis=1)
    slope = np.where(var > 1e-12, (w * (idx - xm[:, None]) * y[idx]).sum(axis=1) / np.maximum(var, 1e-12), 0.0)
    return ym + slope * (at - xm)


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + (n % 2 == 0)


def stl(y: np.ndarray, period: int, robust: bool = False, seasonal: int = 7, inner: int = 0, outer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal part, remainder)."""
    if len(y) < 2 * period:
        raise ValueError("at least two periods of values are needed")
    inner, outer = inner or (2 if robust else 5), outer or (15 if robust else 1)
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1e-9) if period % 2 else period + 1
    trend, weights = np.zeros(len(y)), np.ones(len(y))
    for turn in range(outer):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.empty(len(y) + 2 * period)
            for k in range(period):
                part = detrended[k::period]
                cycle[k::period] = loess(part, seasonal, weights[k::period], np.arange(-1, len(part) + 1, dtype=float))
            low = cycle
            for width in (period, period, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            season = cycle[period:-period] - loess(low, low_span)
            trend = loess(y - season, trend_span, weights)
        if turn + 1 < outer:
            apart = np.abs(y - trend - season)
            limit = 6 * np.median(apart)
            u = apart / limit if limit > 0 else np.zeros(len(y))
            weights = np.where(u < 1, (1 - np.minimum(u, 1) ** 2) ** 2, 0)
    return trend, season, y - trend - season


def mstl(y: np.ndarray, periods: Sequence[int], robust: bool = False, rounds: int = 2) -> dict[str, np.ndarray]:
    """trend, seasonal_{period} for each, remainder: shorter seasons first, each refined in turn."""
    periods = sorted(set(periods))
    if len(y) < 2 * periods[-1]:
        raise ValueError("at least two of the longest period are needed")
    seasons = {p: np.zeros(len(y)) for p in periods}
    rest = y.astype(float)
    for _ in range(rounds if len(periods) > 1 else 1):
        for i, p in enumerate(periods):
            rest = rest + seasons[p]
            trend, seasons[p], _ = stl(rest, p, robust, seasonal=7 + 4 * (i if len(periods) > 1 else 0))
            rest = rest - seasons[p]
    return {"trend": trend, **{f"seasonal_{p}": s for p, s in seasons.items()}, "remainder": rest - trend}


def decompose(df: DataFrame, periods: Sequence[int], ts: str = "ts", val: str = "val", keys: Sequence[str] = (), robust: bool = False) -> DataFrame:
    """[keys,] ts, val, trend, seasonal_{period}, remainder. Values are on a regular grid (``resample``).
    A series is decomposed in one task, as each local fit needs its neighbours on both sides."""
    names = ["trend", *[f"seasonal_{p}" for p in sorted(set(periods))], "remainder"]
    keyed = df.select(*keys, F.col(ts).alias("ts"), F.col(val).cast("double").alias("val"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="_series", errors="ignore").sort_values("ts")
        return part.assign(**mstl(part["val"].to_numpy(), periods, robust))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    grouped = keyed.groupBy(*keys) if keys else keyed.withColumn("_series", F.lit(0)).groupBy("_series")
    return grouped.applyInPandas(work, f"{fields}, {', '.join(f'{n} double' for n in names)}")
