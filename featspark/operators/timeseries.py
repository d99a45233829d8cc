"""Leak-safe time-series features over a time and a value column."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import SECONDS, Duration, approx_seconds, parse_duration
from ..functions.exprs import micros, without_nulls
from .holidays import holiday_calendar
from .windows import DAY, HOUR, STATS, asof_backward, ewm, range_lags, reach_of, rolling

UNITS = {"yearly": "y", "monthly": "mo", "weekly": "w", "daily": "d", "hourly": "h", "minutely": "m", "secondly": "s"}

CALENDAR = {
    "quarter": lambda t: F.quarter(t), "month": lambda t: F.month(t), "week": lambda t: F.weekofyear(t), "day": lambda t: F.day(t),
    "day_of_year": lambda t: F.dayofyear(t), "weekday": lambda t: F.weekday(t) + 1, "hour": lambda t: F.hour(t), "minute": lambda t: F.minute(t),
    "is_weekend": lambda t: F.weekday(t) >= 5, "is_month_start": lambda t: F.day(t) == 1,
    "is_month_end": lambda t: F.day(t) == F.day(F.last_day(t)), "days_in_month": lambda t: F.day(F.last_day(t)),
}
#: Position of a time in a cycle, and the cycle's length.
CYCLES = {
    "month": (lambda t: F.month(t), 12.0), "weekday": (lambda t: F.weekday(t) + 1, 7.0), "hour": (lambda t: F.hour(t), 24.0),
    "hour_of_week": (lambda t: F.weekday(t) * 24 + F.hour(t), 168.0), "day_of_year": (lambda t: F.dayofyear(t) - 1, 365.25),
    "day_of_month": (lambda t: (F.day(t) - 1) / F.day(F.last_day(t)), 1.0),
}


@dataclass(frozen=True)
class Failures:
    """Rows that break a rule; ``counts()`` runs one job."""

    rows: DataFrame
    rules: tuple[str, ...]

    def counts(self) -> dict[str, int]:
        """Failing rows by rule, rules without any left out."""
        got = self.rows.agg(*[F.count_if(~F.col(f"`{r}`")).alias(r) for r in self.rules]).first().asDict()
        return {k: v for k, v in got.items() if v}


class TimeseriesFeatures:
    """Features that at each row use only what was known ``horizon`` before it (None: strictly before it).

    ``keys`` splits the table into series; none means one series, as spread over tasks by time buckets.
    Times are zoneless. Except for ``prepare`` times are expected to be unique in a series.
    """

    def __init__(self, horizon: str | None = None, ts: str = "ts", val: str = "val", keys: Sequence[str] = (), bucket: str = "30d"):
        self.horizon = parse_duration(horizon) if horizon is not None else None
        self.ts, self.val, self.keys = ts, val, list(keys)
        self.bucket = parse_duration(bucket).micros or 30 * DAY
        self.min_year: int | None = None
        self.origin = None

    def prepare(self, df: DataFrame, unique: bool = True, sort: bool = True, order_col: str | None = None) -> tuple[DataFrame, Failures]:
        """Valid rows and failures. ``unique`` keeps the first row of each time, by ``order_col`` or else
        by the order rows are read in. A duplicated time fails all its rows; a series out of order fails
        wholly, which ``sort`` avoids."""
        ts, val = F.col(self.ts), F.col(self.val)
        rows = df.withColumn("_order", F.col(order_col) if order_col else F.monotonically_increasing_id())
        if unique:
            first = Window.partitionBy(*self.keys, self.ts).orderBy("_order")
            rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        number = val.cast("double")
        rules = {f"{self.ts}|nullability": ts.isNotNull(), f"{self.val}|nullability": number.isNotNull(),
                 f"{self.val}|nan": F.coalesce(~F.isnan(number), F.lit(True)), f"{self.val}|inf": F.coalesce(F.abs(number) != float("inf"), F.lit(True)),
                 f"{self.ts}|unique": F.count("*").over(Window.partitionBy(*self.keys, self.ts)) == 1}
        if not sort:
            back = F.lag(self.ts).over(Window.partitionBy(*self.keys).orderBy("_order"))
            rows = rows.withColumn("_up", F.coalesce(back <= ts, F.lit(True)))
            rules["is_sorted"] = F.bool_and("_up").over(Window.partitionBy(*self.keys))
        rows = rows.withColumns(rules)
        good = F.lit(True)
        for r in rules:
            good = good & F.col(f"`{r}`")
        valid = rows.where(good).select(*df.columns).withColumn(self.val, F.col(self.val).cast("double")).withColumn(self.ts, F.col(self.ts).cast("timestamp_ntz"))
        return valid, Failures(rows.where(~good).select(*df.columns, *[F.col(f"`{r}`") for r in rules]), tuple(rules))

    def fit(self, df: DataFrame) -> TimeseriesFeatures:
        """Learn the first time and year."""
        row = df.agg(F.min(self.ts).alias("o"), F.min(F.year(self.ts)).alias("y")).first()
        self.origin, self.min_year = row["o"], row["y"]
        return self

    def _lags(self, units: Mapping[str, Sequence[int] | int | None]) -> dict[str, Duration]:
        out = {}
        for word, unit in UNITS.items():
            steps = units.get(word) or []
            for n in [steps] if isinstance(steps, int) and not isinstance(steps, bool) else steps:
                if isinstance(n, bool) or not isinstance(n, int) or n < 1:
                    raise ValueError("lags are positive integers")
                if self.horizon and n * SECONDS[unit] < self.horizon.seconds:
                    raise ValueError(f"lag {n}{unit} is shorter than the horizon")
                out[f"lag_{n}{unit}"] = parse_duration(f"{n}{unit}")
        return out

    def _finish(self, df: DataFrame, drop_ts: bool, drop_nulls: bool) -> DataFrame:
        df = df.drop(self.ts) if drop_ts else df
        return without_nulls(df) if drop_nulls else df

    def lag(self, df: DataFrame, *, drop_ts: bool = False, drop_nulls: bool = False, **units) -> DataFrame:
        """``lag_{n}{unit}``: the value at exactly ts less n units of the calendar (``daily=[1, 7]``)."""
        unknown = set(units) - set(UNITS)
        if unknown:
            raise ValueError(f"unknown units {sorted(unknown)}")
        lags = self._lags(units)
        out = range_lags(df, self.ts, self.val, lags, self.keys, self.bucket) if lags else df
        return self._finish(out, drop_ts, drop_nulls)

    def lag_diff(self, df: DataFrame, **options) -> DataFrame:
        """``lag_{a}{u}_minus_lag_{b}{u}`` for pairs (a, b) by unit."""
        return self._pairs(df, "minus", lambda a, b: a - b, **options)

    def lag_ratios(self, df: DataFrame, **options) -> DataFrame:
        """``lag_{a}{u}_over_lag_{b}{u}``, null where lag b is 0."""
        return self._pairs(df, "over", lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0.0))), **options)

    def _pairs(self, df, word, make, *, lags_exist=False, keep_lags=False, drop_ts=False, drop_nulls=False, **units):
        wanted = [(f"lag_{a}{u}", f"lag_{b}{u}") for w, u in UNITS.items() for a, b in units.get(w) or []]
        lags = self._lags({w: list(dict.fromkeys(n for pair in units.get(w) or [] for n in pair)) for w in UNITS})
        if lags_exist:
            if missing := [n for n in lags if n not in df.columns]:
                raise ValueError(f"columns {missing} are missing")
            out, name_of = df, {n: n for n in lags}
        else:
            if keep_lags and (clash := [n for n in lags if n in df.columns]):
                raise ValueError(f"columns {clash} exist already")
            name_of = {n: n if keep_lags else f"_{n}" for n in lags}
            out = range_lags(df, self.ts, self.val, {name_of[n]: d for n, d in lags.items()}, self.keys, self.bucket) if lags else df
        out = out.withColumns({f"{a}_{word}_{b}": make(F.col(name_of[a]).cast("double"), F.col(name_of[b]).cast("double")) for a, b in wanted})
        if not lags_exist and not keep_lags:
            out = out.drop(*name_of.values())
        return self._finish(out, drop_ts, drop_nulls)

    def _cutoff(self) -> Column:
        return F.col(self.ts) - self.horizon.interval() if self.horizon else F.col(self.ts)

    def latest_available(self, df: DataFrame, known: DataFrame, values: Sequence[str], into: str = "_known", bucket: int | None = None) -> DataFrame:
        """``df`` with the latest row of ``known`` available at each time, as a struct with its time ``at``."""
        return asof_backward(df, known, self._cutoff(), self.ts, values, into, self.keys, strict=self.horizon is None, bucket=bucket or self.bucket)

    def _attach(self, df: DataFrame, made: DataFrame, names: list[str], drop_ts: bool, drop_nulls: bool, bucket: int | None = None) -> DataFrame:
        out = self.latest_available(df, made, names, bucket=bucket)
        out = out.withColumns({n: F.col("_known")[n] for n in names}).drop("_known")
        return self._finish(out, drop_ts, drop_nulls)

    def rolling(self, df: DataFrame, windows: Sequence[str], stats: Sequence[str] = ("mean", "std"), drop_ts: bool = False, drop_nulls: bool = False) -> DataFrame:
        """``roll_{stat}_{window}`` over the window that ends at the latest available observation."""
        if unknown := set(stats) - set(STATS):
            raise ValueError(f"unknown statistics {sorted(unknown)}")
        parsed = {w: parse_duration(w) for w in windows}
        if not parsed or not stats:
            return self._finish(df, drop_ts, drop_nulls)
        made = rolling(df, self.ts, self.val, parsed, stats, self.keys, self.bucket)
        held = max(HOUR, *map(reach_of, parsed.values()))  # a bucket of a window's rows, so that a dense series is cut finely
        return self._attach(df, made, [f"roll_{s}_{w}" for w in windows for s in stats], drop_ts, drop_nulls, min(self.bucket, held))

    def ewm(self, df: DataFrame, half_lives: Sequence[str], drop_ts: bool = False, drop_nulls: bool = False) -> DataFrame:
        """``ewm_{half-life}``: the exponential mean at the latest available observation."""
        if not half_lives:
            return self._finish(df, drop_ts, drop_nulls)
        parsed = {f"ewm_{h}": parse_duration(h) for h in half_lives}
        lives = {name: d.micros if d.fixed else round(d.seconds * 1e6) for name, d in parsed.items()}
        return self._attach(df, ewm(df, self.ts, self.val, lives, self.keys), list(lives), drop_ts, drop_nulls)

    def gap(self, df: DataFrame, drop_ts: bool = False, drop_nulls: bool = False) -> DataFrame:
        """``secs_since_last_obs``: whole seconds since the latest available observation."""
        out = self.latest_available(df, df.select(*self.keys, self.ts), [])
        since = F.expr(f"(unix_micros(cast(`{self.ts}` as timestamp)) - unix_micros(cast(_known.at as timestamp))) div 1000000")
        return self._finish(out.withColumn("secs_since_last_obs", since).drop("_known"), drop_ts, drop_nulls)

    def cyclical(self, df: DataFrame, features: Sequence[str] = ("month", "weekday", "hour"), harmonics: int = 1, drop_ts: bool = False) -> DataFrame:
        """``{f}_sin`` and ``{f}_cos``, harmonics from the second on with their number."""
        if harmonics < 1:
            raise ValueError("harmonics is at least 1")
        made = {}
        for f in features:
            place, period = CYCLES[f]
            for k in range(1, harmonics + 1):
                angle = place(F.col(self.ts)) * F.lit(2 * 3.141592653589793 * k / period)
                made |= {f"{f}_sin{k if k > 1 else ''}": F.sin(angle), f"{f}_cos{k if k > 1 else ''}": F.cos(angle)}
        return self._finish(df.withColumns(made), drop_ts, False)

    def calendar(self, df: DataFrame, features: Sequence[str] = ("quarter", "month", "day", "hour"), drop_ts: bool = False) -> DataFrame:
        """Calendar parts of the time; weekdays from Monday as 1, ISO weeks."""
        return self._finish(df.withColumns({f: CALENDAR[f](F.col(self.ts)) for f in features}), drop_ts, False)

    def holiday(self, df: DataFrame, country: str, subdiv: str | None = None, dates=None, drop_ts: bool = False) -> DataFrame:
        """``is_holiday``, ``days_to_holiday``, ``days_since_holiday`` and ``is_bridge_day``."""
        years = df.agg(F.min(F.year(self.ts)), F.max(F.year(self.ts))).first()
        table = holiday_calendar(df.sparkSession, years[0], years[1], country, subdiv, dates)
        out = df.join(F.broadcast(table), F.to_date(self.ts) == F.col("_day"), "left").drop("_day")
        return self._finish(out, drop_ts, False)

    def trend(self, df: DataFrame, unit: str = "h", drop_ts: bool = False) -> DataFrame:
        """``diff_from_min_year`` and ``t_{unit}``, time since the fitted origin."""
        if self.origin is None:
            raise RuntimeError("fit comes first")
        if unit not in ("s", "m", "h", "d"):
            raise ValueError(f"unknown unit {unit!r}")
        since = micros(F.col(self.ts)) - micros(F.lit(self.origin).cast("timestamp_ntz"))
        return self._finish(df.withColumns({"diff_from_min_year": F.year(self.ts) - self.min_year,
                                            f"t_{unit}": since / F.lit(SECONDS[unit] * 1e6)}), drop_ts, False)

    def exogenous(self, df: DataFrame, exog: DataFrame, known_in_advance: bool = True, tolerance: str | None = None, drop_ts: bool = False, drop_nulls: bool = False) -> DataFrame:
        """The latest columns of ``exog`` at each time, or at the latest available time if they are not
        known in advance; null if they are older than ``tolerance`` by then."""
        values = [c for c in exog.columns if c not in (self.ts, *self.keys)]
        cutoff = F.col(self.ts) if known_in_advance else self._cutoff()
        strict = not known_in_advance and self.horizon is None
        out = asof_backward(df, exog, cutoff, self.ts, values, "_known", self.keys, strict, self.bucket)
        fresh = F.lit(True)
        if tolerance is not None:
            fresh = micros(cutoff) - micros(F.col("_known.at")) <= round(approx_seconds(tolerance) * 1e6)
        return self._finish(out.withColumns({v: F.when(fresh, F.col("_known")[v]) for v in values}).drop("_known"), drop_ts, drop_nulls)


def is_duration(text: str) -> bool:
    """True if ``text`` spells a duration."""
    return bool(re.fullmatch(r"(?:[0-9]+(?:mo|y|q|w|d|h|m|s))+", text))
