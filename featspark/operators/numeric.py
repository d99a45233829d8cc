"""Fit/apply transforms of numeric columns: impute, clip, log, Yeo-Johnson, scale.

Each step is learned by one aggregate job on what the steps before it give, and applied as a
projection with literal parameters. NaN counts as missing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, numeric_columns, signed_log1p, yeo_johnson
from ..functions.quantiles import exact_quantiles

IMPUTERS = ("median", "mean", "zero")
SCALERS = ("standard", "minmax", "robust")
#: Skew over this asks for a log.
SKEWED = 1.0


def _row(df: DataFrame, made: dict[str, Column]) -> dict:
    return df.agg(*[c.alias(k) for k, c in made.items()]).first().asDict() if made else {}


class NumericFeatures:
    """Learned on one table, applied alike to any; every step takes ``suffix`` to add columns instead of replacing them."""

    def __init__(self):
        self.fills: dict[str, float] | None = None
        self.bounds: dict[str, tuple[float | None, float | None]] | None = None
        self.logs: dict[str, str] | None = None
        self.lambdas: dict[str, float] | None = None
        self.scales: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame, *, impute: dict[str, Sequence[str]] | None = None, clip: Sequence[str] | None = None, clip_quantiles: tuple[float, float] = (0.01, 0.99),
            auto_log: Sequence[str] | bool | None = None, power_transform: Sequence[str] | None = None, scale: dict[str, Sequence[str]] | None = None) -> NumericFeatures:
        """Learn the steps asked for. ``impute`` and ``scale`` map a method to columns; ``auto_log=True``
        takes every numeric column that is not power transformed."""
        low, high = clip_quantiles
        if not 0 <= low < high <= 1:
            raise ValueError("quantiles are between 0 and 1 and in order")
        if auto_log is True:
            auto_log = [c for c in numeric_columns(df) if c not in (power_transform or ())]
        elif auto_log and power_transform and (both := set(auto_log) & set(power_transform)):
            raise ValueError(f"{sorted(both)} are in both auto_log and power_transform")
        for name, allowed, given in (("impute", IMPUTERS, impute), ("scale", SCALERS, scale)):
            if unknown := set(given or ()) - set(allowed):
                raise ValueError(f"unknown {name} methods {sorted(unknown)}")
        used = dict.fromkeys(c for part in (*(impute or {}).values(), clip or (), auto_log or (), power_transform or (), *(scale or {}).values()) for c in part)
        if odd := [c for c in used if c not in numeric_columns(df)]:
            raise ValueError(f"{odd} are not numeric")
        now = df.select(*[as_double(c).alias(c) for c in used])
        if impute is not None:
            self.fills = self._learn_fills(now, impute)
            now = self.impute(now)
        if clip is not None:
            self.bounds = {c: tuple(q) for c, q in exact_quantiles(now, {c: (low, high) for c in clip}).items()}
            now = self.clip(now)
        if auto_log is not None:
            got = _row(now, {f"{k}{c}": f(c) for c in auto_log for k, f in (("s", F.skewness), ("m", F.min))})
            skew = {c: got[f"s{c}"] for c in auto_log}
            self.logs = {c: "signed" if got[f"m{c}"] < 0 else "log1p" for c, s in skew.items() if s is not None and s > SKEWED}
            now = self.auto_log(now)
        if power_transform is not None:
            self.lambdas = learn_lambdas(now, list(power_transform))
            now = self.power_transform(now)
        if scale is not None:
            self.scales = self._learn_scales(now, scale)
        return self

    def _learn_fills(self, df: DataFrame, impute) -> dict[str, float]:
        got = _row(df, {c: F.avg(c) for c in impute.get("mean", ())})
        got |= {c: q[0] for c, q in exact_quantiles(df, {c: (0.5,) for c in impute.get("median", ())}).items()}
        return {c: float(got[c]) if got.get(c) is not None else 0.0 for columns in impute.values() for c in columns}

    def _learn_scales(self, df: DataFrame, scale) -> dict[str, tuple[float, float]]:
        made = {c: F.array(F.avg(c), F.stddev_samp(c)) for c in scale.get("standard", ())}
        made |= {c: F.array(F.min(c), F.max(c) - F.min(c)) for c in scale.get("minmax", ())}
        got, out = _row(df, made), {}
        got |= exact_quantiles(df, {c: (0.5, 0.25, 0.75) for c in scale.get("robust", ())})
        for method, columns in scale.items():
            for c in columns:
                v = got[c] or [None, None, None]
                center, spread = v[0], v[1] if method != "robust" else None if v[1] is None else v[2] - v[1]
                out[c] = (center or 0.0, spread if spread and spread > 0 else 1.0)
        return out

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """All fitted steps in order."""
        columns = dict.fromkeys([c for part in (self.fills, self.bounds, self.logs, self.lambdas, self.scales) for c in part or ()])
        made = {c: as_double(c) for c in columns}
        for step in (self._impute, self._clip, self._log, self._power, self._scale):
            made = {c: step(c, x) for c, x in made.items()}
        return df.withColumns({c + suffix: x for c, x in made.items()})

    def _step(self, df: DataFrame, fitted, step, suffix: str) -> DataFrame:
        if fitted is None:
            raise RuntimeError("the step is not fitted")
        return df.withColumns({c + suffix: step(c, as_double(c)) for c in fitted})

    def impute(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Fill null and NaN."""
        return self._step(df, self.fills, self._impute, suffix)

    def clip(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Bound values; nulls stay."""
        return self._step(df, self.bounds, self._clip, suffix)

    def auto_log(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """log1p, signed where training values were negative, of the skewed columns. Below -1 log1p is null."""
        return self._step(df, self.logs, self._log, suffix)

    def power_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Yeo-Johnson with the learned lambdas."""
        return self._step(df, self.lambdas, self._power, suffix)

    def scale(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """(x - center) / spread."""
        return self._step(df, self.scales, self._scale, suffix)

    def _impute(self, c: str, x: Column) -> Column:
        return F.coalesce(x, F.lit(self.fills[c])) if c in (self.fills or {}) else x

    def _clip(self, c: str, x: Column) -> Column:
        low, high = (self.bounds or {}).get(c, (None, None))
        return x if low is None else F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)

    def _log(self, c: str, x: Column) -> Column:
        kind = (self.logs or {}).get(c)
        return signed_log1p(x) if kind == "signed" else F.log1p(x) if kind else x

    def _power(self, c: str, x: Column) -> Column:
        return yeo_johnson(x, self.lambdas[c]) if c in (self.lambdas or {}) else x

    def _scale(self, c: str, x: Column) -> Column:
        center, spread = (self.scales or {}).get(c, (0.0, 1.0))
        return (x - center) / F.lit(float(spread)) if c in (self.scales or {}) else x


#: Bytes of a table that a task reads about.
TASK_BYTES = 128 << 20


def _top(grid: list[float], fits: list[float], best: int) -> float:
    """Where the parabola through a point of even steps and its neighbours is highest; the point at an end."""
    if not 0 < best < len(grid) - 1 or not math.isfinite(fits[best - 1] + fits[best + 1]):
        return grid[best]
    bend = fits[best - 1] - 2 * fits[best] + fits[best + 1]
    return grid[best] + (grid[best + 1] - grid[best]) * (fits[best - 1] - fits[best + 1]) / (2 * bend) if bend < 0 else grid[best]


def learn_lambdas(df: DataFrame, columns: list[str], points: int = 11, passes: int = 4, reach: float = 5.0) -> dict[str, float]:
    """Maximum-likelihood Yeo-Johnson lambdas: a grid over [-reach, reach], then finer ones around the
    best, then the top of the parabola through the last best and its neighbours. One job a pass serves all columns: each value meets each grid point in the task that reads it,
    and variances are summed by column and point. One value or hardly any range gives lambda 1."""
    base = _row(df, {f"{k}{i}": f for i, c in enumerate(columns) for k, f in
                     (("n", F.count(c)), ("a", F.min(c)), ("b", F.max(c)), ("j", F.sum(F.signum(c) * F.log1p(F.abs(c)))))})
    out = {}
    for i, c in enumerate(columns):
        low, high = base[f"a{i}"], base[f"b{i}"]
        if base[f"n{i}"] <= 1 or high - low <= 1e-9 * max(1.0, abs(low), abs(high)):
            out[c] = 1.0
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < tasks * TASK_BYTES:
        df = df.repartition(tasks)  # a small table is few tasks, and each value is worth many logarithms
    todo = {i: (-reach, reach) for i, c in enumerate(columns) if c not in out}
    x, lam = F.col("x"), F.col("g.lam")
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(F.abs(lam) >= 1e-12, lam))
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / F.when(F.abs(lam - 2) >= 1e-12, 2 - lam))
    for _ in range(passes if todo else 0):
        grids = {i: [a + (b - a) * k / (points - 1) for k in range(points)] for i, (a, b) in todo.items()}
        cells = [F.struct(F.lit(i).alias("i"), F.col(f"`{columns[i]}`").alias("x"),
                          F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("lam")) for k, v in enumerate(grid)]).alias("grid")) for i, grid in grids.items()]
        rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.i", "c.x", F.explode("c.grid").alias("g")).where("x is not null")
        spread = {(r["i"], r["k"]): r["v"] for r in rows.groupBy("i", F.col("g.k").alias("k")).agg(F.var_pop(F.when(x >= 0, up).otherwise(down)).alias("v")).collect()}
        for i, grid in grids.items():
            def likely(k, i=i, grid=grid):
                v = spread.get((i, k))
                ok = v is not None and math.isfinite(v) and v > 0
                return -base[f"n{i}"] / 2 * math.log(v) + (grid[k] - 1) * base[f"j{i}"] if ok else -math.inf
            fits = [likely(k) for k in range(points)]
            best = max(range(points), key=fits.__getitem__)
            out[columns[i]] = _top(grid, fits, best)
            todo[i] = (grid[max(best - 1, 0)], grid[min(best + 1, points - 1)])
    return out
