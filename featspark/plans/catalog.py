"""Registered queries, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import signed_log1p, yeo_johnson
from ..images import pipeline as images
from ..images import steps
from ..operators import metrics, plotdata
from ..operators.encoding import EncodingFeatures
from ..operators.numeric import NumericFeatures
from ..operators.summary import summarize
from ..operators.timeseries import CALENDAR, CYCLES, TimeseriesFeatures
from ..operators.windows import STATS
from ..sources import tables
from ..streaming import features as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily series of order totals."""
    return read(spark, d, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("val"))


def roots(spark: SparkSession, d: str) -> DataFrame:
    """Square roots of the daily series: means of these have no ties that two engines might round apart."""
    return daily(spark, d).withColumn("val", F.sqrt("val"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("ts", F.col("value").alias("val"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("value"), 6).alias("val"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with missing prices: null every 11th order, NaN every 13th."""
    k = F.col("l_orderkey")
    x = F.when(k % 11 == 0, None).when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), F.col("l_quantity").alias("q"))


def valued(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("value") - 5).alias("s"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, d, "labels"), "doc_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a probability made from their length."""
    return labelled(spark, d).select("doc_id", F.col("quality").alias("y_true"), F.round(F.least(F.col("n_chars") / 8000.0, F.lit(1.0)), 6).alias("y_proba"),
                                     (F.col("n_chars") > 1500).cast("int").alias("y_pred"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 2000.0 + F.col("l_tax") * 1000.0).alias("y_pred"))


SD = "SELECT o_orderdate AS ts, round(sum(o_totalprice), 2) AS val FROM orders GROUP BY 1"
SR = f"SELECT ts, sqrt(val) AS val FROM ({SD})"
EV = "SELECT ts, value AS val FROM events"
SH = "SELECT date_trunc('hour', ts) AS ts, round(avg(value), 6) AS val FROM events GROUP BY 1"
LI = ("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS x, "
      "l_quantity AS q FROM lineitem")
VA = "SELECT event_id, value AS x, value - 5 AS s FROM events"
DL = "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d JOIN labels USING (doc_id)"
SC = f"SELECT doc_id, quality AS y_true, round(least(n_chars / 8000.0::DOUBLE, 1.0::DOUBLE), 6) AS y_proba, CAST(n_chars > 1500 AS INTEGER) AS y_pred FROM ({DL})"
PR = "SELECT l_extendedprice AS y_true, l_quantity * 2000.0::DOUBLE + l_tax * 1000.0::DOUBLE AS y_pred FROM lineitem"
UNIT_SQL = {"y": "YEAR", "mo": "MONTH", "w": "WEEK", "d": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND"}

# ---- time series -----------------------------------------------------------


def messy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 7 == 0, None).when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", F.when(k % 17 == 0, None).otherwise(F.date_trunc("minute", "ts").cast("timestamp_ntz")).alias("ts"), value.alias("val"))


ME = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS ts,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS val FROM events"""
FIRST = f"SELECT * FROM ({ME}) QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1"


@query(f"SELECT event_id, ts, val FROM ({FIRST}) WHERE ts IS NOT NULL AND val IS NOT NULL AND isfinite(val)")
def ts_prepare_valid(spark, d):
    return TimeseriesFeatures().prepare(messy(spark, d), order_col="event_id")[0]


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM ({ME}))
SELECT rule, n FROM (SELECT 'ts|nullability' AS rule, count(*) FILTER (ts IS NULL) AS n FROM r UNION ALL SELECT 'val|nullability', count(*) FILTER (val IS NULL) FROM r
UNION ALL SELECT 'val|nan', count(*) FILTER (isnan(val)) FROM r UNION ALL SELECT 'val|inf', count(*) FILTER (isinf(val)) FROM r UNION ALL SELECT 'ts|unique', count(*) FILTER (n > 1) FROM r)""")
def ts_prepare_failures(spark, d):
    failures = TimeseriesFeatures().prepare(messy(spark, d), unique=False, order_col="event_id")[1]
    return spark.createDataFrame(list(failures.counts().items()), "rule string, n long")


def lag_sql(*lags: tuple[int, str], base: str = SD) -> str:
    joins = " ".join(f"LEFT JOIN s l{i} ON l{i}.ts = s.ts - INTERVAL {n} {UNIT_SQL[u]}" for i, (n, u) in enumerate(lags))
    return f"WITH s AS ({base}) SELECT s.ts, s.val, {', '.join(f'l{i}.val AS lag_{n}{u}' for i, (n, u) in enumerate(lags))} FROM s {joins}"


@query(lag_sql((1, "y"), (1, "mo"), (2, "w"), (1, "d"), (7, "d")))
def ts_lag_units(spark, d):
    return TimeseriesFeatures().lag(daily(spark, d), yearly=[1], monthly=[1], weekly=[2], daily=[1, 7])


@query(lag_sql((1, "mo"), (3, "mo"), (12, "mo")))
def ts_lag_month_clamp(spark, d):
    return TimeseriesFeatures().lag(daily(spark, d), monthly=[1, 3, 12])


@query(lag_sql((1, "d"), (24, "h"), base=SH))
def ts_lag_hourly(spark, d):
    return TimeseriesFeatures("1h").lag(hourly(spark, d), daily=[1], hourly=[24])


@query("WITH l AS (" + lag_sql((1, "d"), (7, "d"), (1, "mo"), (2, "mo")) + ") SELECT ts, val, round(lag_1mo - lag_2mo, 6) AS lag_1mo_minus_lag_2mo, round(lag_1d - lag_7d, 6) AS lag_1d_minus_lag_7d FROM l")
def ts_lag_diff(spark, d):
    return rounded(TimeseriesFeatures().lag_diff(daily(spark, d), monthly=[(1, 2)], daily=[(1, 7)]), "lag_1mo_minus_lag_2mo", "lag_1d_minus_lag_7d")


@query("WITH l AS (" + lag_sql((1, "d"), (7, "d"), base=f"SELECT ts, CASE WHEN day(ts) = 5 THEN 0 ELSE val END AS val FROM ({SD})")
       + ") SELECT ts, val, round(CASE WHEN lag_7d <> 0 THEN lag_1d / lag_7d END, 6) AS lag_1d_over_lag_7d FROM l")
def ts_lag_ratios(spark, d):
    series = daily(spark, d).withColumn("val", F.when(F.day("ts") == 5, 0.0).otherwise(F.col("val")))
    return rounded(TimeseriesFeatures().lag_ratios(series, daily=[(1, 7)]), "lag_1d_over_lag_7d")


def rolling_sql(base: str, window: str, name: str, stats, op: str, cutoff: str) -> str:
    made = {"mean": "avg(val)", "std": "stddev_samp(val)", "min": "min(val)", "max": "max(val)", "median": "median(val)"}
    cols = [f"roll_{s}_{name}" for s in stats]
    r = ", ".join(f"round({made[s]} OVER w, 6) AS {c}" for s, c in zip(stats, cols, strict=True))
    return (f"WITH s AS ({base}), r AS (SELECT ts, {r} FROM s WINDOW w AS (ORDER BY ts RANGE BETWEEN {window} - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)), "
            f"l AS (SELECT *, ts{cutoff} AS c FROM s) SELECT l.ts, round(l.val, 6) AS val, {', '.join(f'r.{c}' for c in cols)} FROM l ASOF LEFT JOIN r ON l.c {op} r.ts")


def _rolled(spark, series: DataFrame, window: str, stats, horizon: str | None = None) -> DataFrame:
    return rounded(TimeseriesFeatures(horizon).rolling(series, [window], stats), "val", *[f"roll_{s}_{window}" for s in stats])


@query(rolling_sql(SR, "INTERVAL 7 DAY", "7d", ("mean", "std"), ">", ""))
def ts_rolling_mean_std(spark, d):
    return _rolled(spark, roots(spark, d), "7d", ("mean", "std"))


@query(rolling_sql(EV, "INTERVAL 3 HOUR", "3h", ("min", "max"), ">", ""))
def ts_rolling_min_max(spark, d):
    return _rolled(spark, events(spark, d), "3h", ("min", "max"))


@query(rolling_sql(SR, "INTERVAL 14 DAY", "14d", ("median",), ">", ""))
def ts_rolling_median(spark, d):
    return _rolled(spark, roots(spark, d), "14d", ("median",))


@query(rolling_sql(SR, "INTERVAL 30 DAY", "30d", STATS, ">=", " - INTERVAL 3 DAY"))
def ts_rolling_horizon(spark, d):
    return _rolled(spark, roots(spark, d), "30d", STATS, "3d")


@query(f"""WITH s AS ({SR}), r AS (SELECT a.ts, round(avg(b.val), 6) AS m, round(stddev_samp(b.val), 6) AS sd FROM s a JOIN s b ON b.ts <= a.ts AND b.ts > a.ts - INTERVAL 2 MONTH GROUP BY 1)
SELECT s.ts, round(s.val, 6) AS val, r.m AS roll_mean_2mo, r.sd AS roll_std_2mo FROM s ASOF LEFT JOIN r ON s.ts > r.ts""")
def ts_rolling_calendar(spark, d):
    return _rolled(spark, roots(spark, d), "2mo", ("mean", "std"))


@query(f"""WITH RECURSIVE s AS (SELECT ts, val, row_number() OVER (ORDER BY ts) AS i FROM ({SD})),
e AS (SELECT ts, val AS r, i FROM s WHERE i = 1 UNION ALL
  SELECT s.ts, e.r + (1 - pow(2.0::DOUBLE, -(epoch_us(s.ts) - epoch_us(e.ts)) / (3 * 86400000000.0::DOUBLE))) * (s.val - e.r), s.i FROM e JOIN s ON s.i = e.i + 1)
SELECT s.ts, s.val, round(e.r, 4) AS ewm_3d FROM s ASOF LEFT JOIN e ON s.ts > e.ts""")
def ts_ewm(spark, d):
    return rounded(TimeseriesFeatures().ewm(daily(spark, d), ["3d"]), "ewm_3d", digits=4)


def gap_sql(op: str, cutoff: str) -> str:
    return (f"WITH s AS ({EV}), l AS (SELECT *, ts{cutoff} AS c FROM s) SELECT l.ts, l.val, CAST((epoch_us(l.ts) - epoch_us(r.ts)) // 1000000 AS BIGINT) AS secs_since_last_obs "
            f"FROM l ASOF LEFT JOIN (SELECT ts FROM s) r ON l.c {op} r.ts")


@query(gap_sql(">", ""))
def ts_gap(spark, d):
    return TimeseriesFeatures().gap(events(spark, d))


@query(gap_sql(">=", " - INTERVAL 2 HOUR"))
def ts_gap_horizon(spark, d):
    return TimeseriesFeatures("2h").gap(events(spark, d))


CYCLE_SQL = {"month": "month(ts) / 12.0::DOUBLE", "weekday": "isodow(ts) / 7.0::DOUBLE", "hour": "hour(ts) / 24.0::DOUBLE", "hour_of_week": "((isodow(ts) - 1) * 24 + hour(ts)) / 168.0::DOUBLE",
             "day_of_year": "(dayofyear(ts) - 1) / 365.25::DOUBLE", "day_of_month": "(day(ts) - 1) / day(last_day(ts))::DOUBLE"}


@query(f"SELECT ts, val, {', '.join(f'round({g}(2 * pi() * {k} * {x}), 6) AS {f}_{g}{k if k > 1 else str()}' for f, x in CYCLE_SQL.items() for k in (1, 2) for g in ('sin', 'cos'))} FROM ({EV})")
def ts_cyclical(spark, d):
    out = TimeseriesFeatures().cyclical(events(spark, d), tuple(CYCLES), 2)
    return rounded(out, *[c for c in out.columns if c not in ("ts", "val")])


@query(f"""SELECT ts, val, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(month(ts) AS INTEGER) AS month, CAST(week(ts) AS INTEGER) AS week, CAST(day(ts) AS INTEGER) AS day,
  CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(isodow(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, isodow(ts) >= 6 AS is_weekend,
  day(ts) = 1 AS is_month_start, day(ts) = day(last_day(ts)) AS is_month_end, CAST(day(last_day(ts)) AS INTEGER) AS days_in_month FROM ({SD} UNION ALL {EV})""")
def ts_calendar(spark, d):
    return TimeseriesFeatures().calendar(daily(spark, d).unionByName(events(spark, d)), tuple(CALENDAR))


@query(f"""WITH y AS (SELECT unnest(range(1990, 2030)) AS y), f AS (
  SELECT make_date(y, m, dd) AS h FROM y, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) t(m, dd) UNION ALL SELECT make_date(y, 6, 19) FROM y WHERE y >= 2021),
n AS (SELECT make_date(y, m, 1) AS a, wd, k FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) t(m, wd, k)),
h AS (SELECT h FROM f UNION SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END FROM f UNION SELECT CAST(a + CAST(((wd - isodow(a) + 7) % 7) + 7 * (k - 1) AS INTEGER) AS DATE) FROM n
  UNION SELECT CAST(make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) AS DATE) FROM y),
s AS (SELECT *, CAST(ts AS DATE) AS dd FROM ({SD})),
j AS (SELECT s.*, p.h AS ph, x.h AS nh FROM s ASOF LEFT JOIN (SELECT h FROM h) p ON s.dd >= p.h ASOF LEFT JOIN (SELECT h FROM h) x ON s.dd <= x.h)
SELECT ts, val, ph = dd AS is_holiday, CAST(nh - dd AS INTEGER) AS days_to_holiday, CAST(dd - ph AS INTEGER) AS days_since_holiday,
  NOT (isodow(dd) >= 6 OR ph = dd) AND (isodow(dd - 1) >= 6 OR dd - 1 IN (SELECT h FROM h)) AND (isodow(dd + 1) >= 6 OR dd + 1 IN (SELECT h FROM h)) AS is_bridge_day FROM j""")
def ts_holiday_us(spark, d):
    return TimeseriesFeatures().holiday(daily(spark, d), "US")


@query(f"""WITH o AS (SELECT min(ts) AS a, min(year(ts)) AS y FROM ({EV}) WHERE ts < TIMESTAMP '2024-01-15')
SELECT ts, val, CAST(year(ts) - y AS INTEGER) AS diff_from_min_year, round((epoch_us(ts) - epoch_us(a)) / 3600000000.0::DOUBLE, 6) AS t_h FROM ({EV}), o""")
def ts_trend(spark, d):
    rows = events(spark, d)
    return rounded(TimeseriesFeatures().fit(rows.where("ts < timestamp_ntz'2024-01-15'")).trend(rows), "t_h")


def exog(spark, d):
    """A coarser series: means of three hours."""
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 10_800_000_000) * 10_800_000_000).cast("timestamp_ntz")
    return read(spark, d, "events").groupBy(at.alias("ts")).agg(F.round(F.avg("value"), 6).alias("level"))


EX = "SELECT to_timestamp(0)::TIMESTAMP + to_microseconds(epoch_us(ts) // 10800000000 * 10800000000) AS ts, round(avg(value), 6) AS level FROM events GROUP BY 1"


@query(f"SELECT l.ts, l.val, x.level FROM ({EV}) l ASOF LEFT JOIN ({EX}) x ON l.ts >= x.ts")
def ts_exogenous_known(spark, d):
    return TimeseriesFeatures().exogenous(events(spark, d), exog(spark, d))


@query(f"SELECT l.ts, l.val, CASE WHEN l.c - x.ts <= INTERVAL 90 MINUTE THEN x.level END AS level FROM (SELECT *, ts - INTERVAL 1 HOUR AS c FROM ({EV})) l ASOF LEFT JOIN ({EX}) x ON l.c >= x.ts")
def ts_exogenous_horizon_tol(spark, d):
    return TimeseriesFeatures("1h").exogenous(events(spark, d), exog(spark, d), known_in_advance=False, tolerance="1h30m")


@query("""WITH e AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id, date_trunc('day', ts)), v AS (SELECT user_id, ts, value FROM events)
SELECT e.user_id, e.ts, v.value AS val FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts > v.ts""")
def ts_asof_by_key(spark, d):
    rows = read(spark, d, "events")
    left = rows.groupBy("user_id", F.date_trunc("day", "ts")).agg(F.max("ts").alias("ts")).select("user_id", "ts")
    seen = rows.select("user_id", "ts", F.col("value").alias("val"))
    out = TimeseriesFeatures(keys=["user_id"]).latest_available(left, seen, ["val"])
    return out.select("user_id", "ts", F.col("_known.val").alias("val"))


# ---- numeric ----------------------------------------------------------------


def impute_sql(fill: str) -> str:
    return f"WITH t AS ({LI}), f AS (SELECT {fill} AS f FROM t) SELECT l_orderkey, l_linenumber, q, round(coalesce(x, f), 4) AS x FROM t, f"


def _imputed(spark, d, method):
    rows = lines(spark, d)
    return rounded(NumericFeatures().fit(rows, impute={method: ["x"]}).impute(rows), "x", digits=4)


@query(impute_sql("median(x)"))
def num_impute_median(spark, d):
    return _imputed(spark, d, "median")


@query(impute_sql("avg(x)"))
def num_impute_mean(spark, d):
    return _imputed(spark, d, "mean")


@query(f"SELECT l_orderkey, l_linenumber, q, round(coalesce(x, 0), 4) AS x FROM ({LI})")
def num_impute_zero(spark, d):
    return _imputed(spark, d, "zero")


@query(f"WITH t AS ({LI}), f AS (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM t) SELECT l_orderkey, l_linenumber, q, round(CASE WHEN x < a THEN a WHEN x > b THEN b ELSE x END, 4) AS x FROM t, f")
def num_clip(spark, d):
    rows = lines(spark, d)
    return rounded(NumericFeatures().fit(rows, clip=["x"]).clip(rows), "x", digits=4)


@query(f"""WITH t AS ({VA}), m AS (SELECT avg(x) AS mx, avg(s) AS ms, min(s) AS a FROM t), k AS (
  SELECT avg(pow(x - mx, 3)) / pow(avg(pow(x - mx, 2)), 1.5) AS gx, avg(pow(s - ms, 3)) / pow(avg(pow(s - ms, 2)), 1.5) AS gs FROM t, m)
SELECT event_id, round(CASE WHEN gx > 1 THEN ln(1 + x) ELSE x END, 6) AS x, round(CASE WHEN gs > 1 THEN sign(s) * ln(1 + abs(s)) ELSE s END, 6) AS s FROM t, k""")
def num_auto_log(spark, d):
    rows = valued(spark, d)
    return rounded(NumericFeatures().fit(rows, auto_log=["x", "s"]).auto_log(rows), "x", "s")


@query(f"SELECT event_id, round(sign(s) * ln(1 + abs(s)), 6) AS y FROM ({VA})")
def num_signed_log(spark, d):
    return valued(spark, d).select("event_id", F.round(signed_log1p("s"), 6).alias("y"))


LAMBDAS = (-1.5, 0.0, 0.5, 2.0)


def yj_sql(x: str, lam: float) -> str:
    up = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    down = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}::DOUBLE) - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


@query(f"SELECT event_id, {', '.join(f'round({yj_sql(chr(115), lam)}, 5) AS y{i}' for i, lam in enumerate(LAMBDAS))} FROM ({VA})")
def num_yeo_johnson(spark, d):
    step = NumericFeatures()
    rows = valued(spark, d).select("event_id", *[F.col("s").alias(f"y{i}") for i in range(len(LAMBDAS))])
    step.lambdas = {f"y{i}": lam for i, lam in enumerate(LAMBDAS)}
    return rounded(step.power_transform(rows), *step.lambdas, digits=5)


def scale_sql(center: str, spread: str) -> str:
    return f"WITH t AS ({LI}), f AS (SELECT {center} AS c, {spread} AS s FROM t) SELECT l_orderkey, l_linenumber, q, round((x - c) / s, 6) AS x FROM t, f"


def _scaled(spark, d, method):
    rows = lines(spark, d)
    return rounded(NumericFeatures().fit(rows, scale={method: ["x"]}).scale(rows), "x")


@query(scale_sql("avg(x)", "stddev_samp(x)"))
def num_scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query(scale_sql("min(x)", "max(x) - min(x)"))
def num_scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query(scale_sql("median(x)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"))
def num_scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query(f"""WITH t AS ({LI}), a AS (SELECT median(x) AS f FROM t), i AS (SELECT l_orderkey, l_linenumber, q, coalesce(x, f) AS x FROM t, a),
b AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM i), c AS (SELECT l_orderkey, l_linenumber, q, CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END AS x FROM i, b),
s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM c) SELECT l_orderkey, l_linenumber, q, round((x - m) / sd, 6) AS x FROM c, s""")
def num_pipeline(spark, d):
    rows = lines(spark, d)
    fitted = NumericFeatures().fit(rows, impute={"median": ["x"]}, clip=["x"], clip_quantiles=(0.05, 0.95), scale={"standard": ["x"]})
    return rounded(fitted.transform(rows), "x")


def power_fit_sql(column: str) -> str:
    """The best lambda of a grid of 101 points and of a finer one about it, and its mean log-likelihood."""
    def tried(grid: str) -> str:
        up = "CASE WHEN abs(lam) < 1e-12 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END"
        down = "CASE WHEN abs(lam - 2) < 1e-12 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END"
        return (f"(SELECT lam, -ln(var_pop(CASE WHEN x >= 0 THEN {up} ELSE {down} END)) / 2 + (lam - 1) * avg(sign(x) * ln(1 + abs(x))) AS fit "
                f"FROM (SELECT {column} AS x FROM ({VA})), ({grid}) GROUP BY lam ORDER BY fit DESC LIMIT 1)")

    coarse = tried("SELECT (i - 50) / 10.0::DOUBLE AS lam FROM range(101) r(i)")
    fine = tried(f"SELECT best.lam + (i - 100) / 1000.0::DOUBLE AS lam FROM range(201) r(i), {coarse} best")
    return f"SELECT '{column}' AS \"column\", round(lam, 1) AS lambda, round(fit, 5) AS fit FROM {fine}"


@query(f"{power_fit_sql('x')} UNION ALL {power_fit_sql('s')}")
def num_power_fit(spark, d):
    """Learned lambdas, found by search, with the mean log-likelihood that they reach."""
    df = valued(spark, d)
    lambdas = NumericFeatures().fit(df, power_transform=["x", "s"]).lambdas
    fits = df.agg(*[(-F.log(F.var_pop(yeo_johnson(F.col(c), lam))) / 2 + (lam - 1) * F.avg(signed_log1p(c))).alias(c) for c, lam in lambdas.items()]).first()
    return spark.createDataFrame([(c, round(lam, 1), round(fits[c], 5)) for c, lam in lambdas.items()], "column string, lambda double, fit double")


# ---- encoders ---------------------------------------------------------------

TRAIN, TEST = "doc_id % 5 <> 0", "doc_id % 5 = 0"


def _split(spark, d):
    rows = labelled(spark, d)
    return rows.where(TRAIN), rows


@query(f"WITH t AS ({DL}), c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k FROM (SELECT DISTINCT lang FROM t)) SELECT doc_id, source, n_chars, quality, toxic, CAST(k AS INTEGER) AS lang FROM t JOIN c USING (lang)")
def enc_enum(spark, d):
    rows = labelled(spark, d)
    return EncodingFeatures().fit(rows, to_enum=["lang"]).categorical_to_enum(rows)


@query(f"SELECT doc_id, source, n_chars, quality, toxic, {', '.join(f'CAST(lang = {chr(39)}{x}{chr(39)} AS INTEGER) AS lang_{x}' for x in ('de', 'en', 'es', 'fr'))} FROM ({DL})")
def enc_onehot(spark, d):
    train, rows = _split(spark, d)
    return EncodingFeatures().fit(train, to_onehot=["lang"]).categorical_to_onehot(rows)


@query(f"""WITH t AS ({DL}), e AS (SELECT list_distinct(quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8])) AS e FROM t WHERE {TRAIN})
SELECT doc_id, lang, source, quality, toxic, CAST(len(list_filter(e, lambda y: y < n_chars)) AS INTEGER) AS n_chars FROM t, e""")
def enc_bin(spark, d):
    train, rows = _split(spark, d)
    return EncodingFeatures().fit(train, to_bin={"n_chars": 5}).numeric_to_bin(rows)


@query(f"""WITH t AS ({DL}), p AS (SELECT avg(CAST(quality = 1 AS INTEGER)) AS p FROM t WHERE {TRAIN}), r AS (
  SELECT source, (count(*) FILTER (quality = 1) + 10 * any_value(p)) / (count(*) + 10) AS r FROM t, p WHERE {TRAIN} GROUP BY source)
SELECT doc_id, lang, source, n_chars, quality, toxic, round(coalesce(r, p), 6) AS source_te FROM t LEFT JOIN r USING (source), p""")
def enc_target(spark, d):
    train, rows = _split(spark, d)
    return rounded(EncodingFeatures().fit(train, target_encode=["source"], target="quality").target_encode(rows), "source_te")


def _multi_sql() -> str:
    langs = ("de", "en", "es", "fr")
    p = ", ".join(f"avg(CAST(lang = '{k}' AS INTEGER)) AS p_{k}" for k in langs)
    r = ", ".join(f"(count(*) FILTER (lang = '{k}') + 5 * any_value(p_{k})) / (count(*) + 5) AS r_{k}" for k in langs)
    out = ", ".join(f"round(coalesce(r_{k}, p_{k}), 6) AS source_te_{k}" for k in langs)
    return f"WITH t AS ({DL}), p AS (SELECT {p} FROM t WHERE {TRAIN}), r AS (SELECT source, {r} FROM t, p WHERE {TRAIN} GROUP BY source) SELECT doc_id, lang, source, n_chars, quality, toxic, {out} FROM t LEFT JOIN r USING (source), p"


@query(_multi_sql())
def enc_target_multiclass(spark, d):
    train, rows = _split(spark, d)
    out = EncodingFeatures().fit(train, target_encode=["source"], target="lang", smoothing=5.0).target_encode(rows)
    return rounded(out, *[c for c in out.columns if "_te_" in c])


@query(f"""WITH t AS (SELECT *, n_chars % 4 AS f FROM ({DL})), a AS (SELECT count(*) AS n, sum(CAST(quality = 1 AS DOUBLE)) AS h FROM t), b AS (SELECT f, count(*) AS n, sum(CAST(quality = 1 AS DOUBLE)) AS h FROM t GROUP BY f),
p AS (SELECT f, (a.h - b.h) / (a.n - b.n) AS p FROM a, b), c AS (SELECT source, count(*) AS n, sum(CAST(quality = 1 AS DOUBLE)) AS h FROM t GROUP BY 1), g AS (SELECT source, f, count(*) AS n, sum(CAST(quality = 1 AS DOUBLE)) AS h FROM t GROUP BY ALL)
SELECT doc_id, round((c.h - g.h + 10 * p) / (c.n - g.n + 10), 6) AS source_te FROM t JOIN c USING (source) JOIN g USING (source, f) JOIN p USING (f)""")
def enc_target_oof(spark, d):
    """Folds given by a column, so that SQL can follow."""
    rows = labelled(spark, d).withColumn("fold", F.col("n_chars") % 4)
    fitted = EncodingFeatures().fit(rows, target_encode=["source"], target="quality")
    return rounded(fitted.target_encode(rows, folds=4, fold_by="fold"), "source_te").select("doc_id", "source_te")


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source FROM ({DL})), n AS (SELECT source, count(*) / (SELECT count(*) FROM t WHERE {TRAIN})::DOUBLE AS s FROM t WHERE {TRAIN} GROUP BY 1) "
       "SELECT t.doc_id, t.source, round(coalesce(s, 0), 6) AS source_freq FROM t LEFT JOIN n ON t.source IS NOT DISTINCT FROM n.source")
def enc_frequency(spark, d):
    rows = labelled(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    return rounded(EncodingFeatures().fit(rows.where(TRAIN), frequency_encode=["source"]).frequency_encode(rows), "source_freq")


# ---- profiles and charts ----------------------------------------------------


def profile_sql(table: str, columns: dict[str, tuple[str, bool]]) -> str:
    parts = []
    for c, (kind, number) in columns.items():
        stats = (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, "
                 f"round(max({c}), 4) AS max, round((SELECT avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) FROM {table}, (SELECT avg({c}) AS m FROM {table})), 4) AS skew, round(100.0::DOUBLE * count(*) FILTER ({c} = 0) / count({c}), 4) AS zeros_pct"
                 if number else ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "p25", "median", "p75", "max", "skew", "zeros_pct")))
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count({c}) AS count, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 4) AS null_pct, "
                     f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS n_unique, {stats} FROM {table}")
    return " UNION ALL ".join(parts)


ORDER_COLUMNS = {"o_orderkey": ("bigint", True), "o_custkey": ("bigint", True), "o_orderstatus": ("string", False), "o_totalprice": ("double", True), "o_orderpriority": ("string", False)}


@query(profile_sql("orders", {k: (t, n) for k, (t, n) in ORDER_COLUMNS.items()}).replace("max(o_orderkey), 4)", "max(o_orderkey)::DOUBLE, 4)").replace("min(o_orderkey), 4)", "min(o_orderkey)::DOUBLE, 4)")
       .replace("max(o_custkey), 4)", "max(o_custkey)::DOUBLE, 4)").replace("min(o_custkey), 4)", "min(o_custkey)::DOUBLE, 4)"))
def summarize_orders(spark, d):
    out = summarize(read(spark, d, "orders"), list(ORDER_COLUMNS))
    return rounded(out, "null_pct", "mean", "std", "min", "p25", "median", "p75", "max", "skew", "zeros_pct", digits=4)


@query(f"WITH t AS ({LI}) SELECT 'l_orderkey' AS \"column\", 0.0::DOUBLE AS null_pct UNION ALL SELECT 'x', round(100.0::DOUBLE * count(*) FILTER (l_orderkey % 11 = 0) / count(*), 6) FROM t")
def missing_values(spark, d):
    return rounded(plotdata.missing_values(lines(spark, d).select("l_orderkey", "x")), "null_pct")


CORR_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def corr_sql(source: str) -> str:
    return f"WITH t AS ({source}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) AS corr FROM t" for a in CORR_COLUMNS for b in CORR_COLUMNS)


@query(corr_sql(f"SELECT {', '.join(CORR_COLUMNS)} FROM lineitem"))
def corr_pearson(spark, d):
    return plotdata.correlations(read(spark, d, "lineitem"), CORR_COLUMNS)


@query(corr_sql("SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in CORR_COLUMNS) + " FROM lineitem"))
def corr_spearman(spark, d):
    return plotdata.correlations(read(spark, d, "lineitem"), CORR_COLUMNS, "spearman")


@query("""WITH c AS (SELECT coalesce(source, '(null)') AS value, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS source FROM documents) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place FROM c), k AS (
  SELECT CASE WHEN place <= 5 THEN value ELSE 'other (' || (SELECT count(*) - 5 FROM c) || ')' END AS value, n, least(place, 6) AS place FROM r)
SELECT value, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM c), 6) AS share, place FROM k GROUP BY value, place""")
def category_counts(spark, d):
    rows = read(spark, d, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"))
    return rounded(plotdata.category_counts(rows, "source", 5), "share")


TARGET_STATS = "count(*) AS n, round(avg(y), 6) AS mean, round(coalesce(stddev_samp(y) / sqrt(count(*)), 0), 6) AS sem, round(avg(y) - 1.96 * coalesce(stddev_samp(y) / sqrt(count(*)), 0), 6) AS low, round(avg(y) + 1.96 * coalesce(stddev_samp(y) / sqrt(count(*)), 0), 6) AS high"


@query(f"""WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y FROM ({DL})), e AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM t)
SELECT CAST(len(list_filter(e, lambda v: v < x)) AS INTEGER) AS bin, median(x) AS x, {TARGET_STATS} FROM t, e GROUP BY 1""")
def feature_target_numeric(spark, d):
    return rounded(plotdata.feature_target(labelled(spark, d), "n_chars", "quality"), "mean", "sem", "low", "high")


@query(f"SELECT source AS value, {TARGET_STATS} FROM (SELECT source, CAST(quality AS DOUBLE) AS y FROM ({DL})) GROUP BY 1 ORDER BY n DESC, value LIMIT 7")
def feature_target_categorical(spark, d):
    return rounded(plotdata.feature_target(labelled(spark, d), "source", "quality", top_k=7), "mean", "sem", "low", "high")


@query("""WITH t AS (SELECT value AS x FROM events), b AS (SELECT min(x) AS a, (max(x) - min(x)) / 12 AS w FROM t), i AS (SELECT least(CAST(floor((x - a) / w) AS BIGINT), 11) AS i, a, w FROM t, b)
SELECT round(i * w + a, 6) AS low, round((i + 1) * w + a, 6) AS high, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM i GROUP BY i, a, w""")
def histogram(spark, d):
    return rounded(plotdata.histogram(read(spark, d, "events"), "value", 12), "low", "high", "share")


@query("SELECT CAST(p_size AS DOUBLE) AS low, CAST(p_size AS DOUBLE) AS high, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_size")
def histogram_integers(spark, d):
    return rounded(plotdata.histogram(read(spark, d, "part"), "p_size"), "share")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type AS "group", count(*) AS n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
  max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, m, q3""")
def boxplot_stats(spark, d):
    return rounded(plotdata.boxplot(read(spark, d, "events"), "value", "event_type"), "q1", "median", "q3")


@query("""WITH s AS (SELECT event_type AS "group", count(*) AS n, min(value) AS a, max(value) AS b, stddev_samp(value) * pow(count(*), -0.2::DOUBLE) AS h FROM events GROUP BY 1),
p AS (SELECT *, a + (b - a) * k / 199 AS x FROM s, range(200) r(k))
SELECT p."group", round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM p JOIN events e ON e.event_type = p."group" GROUP BY p."group", k, x""")
def kde(spark, d):
    return rounded(plotdata.kde(read(spark, d, "events"), "value", "event_type", cells=None), "x", "density")


STEPS = f"SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM ({SD}))"
STEP = f"(SELECT epoch_us(ts) - epoch_us(before) AS s FROM ({STEPS}) WHERE before IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT before AS start, ts, CAST(round((epoch_us(ts) - epoch_us(before)) / s::DOUBLE) - 1 AS BIGINT) AS missing FROM ({STEPS}), {STEP} WHERE epoch_us(ts) - epoch_us(before) > s")
def gaps(spark, d):
    return plotdata.gaps(daily(spark, d))


@query(f"SELECT s AS step FROM {STEP}")
def infer_interval(spark, d):
    return spark.createDataFrame([(plotdata.infer_interval(daily(spark, d)),)], "step long")


@query(f"SELECT CAST(isodow(ts) AS INTEGER) AS weekday, {', '.join(f'round(avg(val) FILTER (month(ts) = {m}), 4) AS m{m}' for m in range(1, 13))} FROM ({SD}) GROUP BY 1")
def seasonal_profile(spark, d):
    out = plotdata.seasonal_profile(daily(spark, d), "weekday", "month")
    return out.select("weekday", *[F.round(F.col(str(m)), 4).alias(f"m{m}") for m in range(1, 13)])


@query(f"SELECT CAST(hour(ts) AS INTEGER) AS hour, round(median(val), 6) AS center, "
       f"{', '.join(f'round(list_sort(list(val))[CAST(floor((count(*) - 1) * {q}::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1], 6) AS p{int(100 * q)}' for q in (0.25, 0.75))} FROM ({EV}) GROUP BY 1")
def seasonal_band(spark, d):
    return rounded(plotdata.seasonal_profile(events(spark, d), "hour", agg="median"), "center", "p25", "p75")


def acf_sql(lags: int, ask: str = "") -> str:
    shifted = ", ".join(f"lag(e, {k}) OVER (ORDER BY ts) AS l{k}" for k in range(1, lags + 1))
    sums = " UNION ALL ".join([f"SELECT 0 AS lag, 1.0::DOUBLE AS acf"] + [f"SELECT {k}, sum(e * l{k}) / sum(e * e) FROM x" for k in range(1, lags + 1)])
    return (f"WITH RECURSIVE s AS ({SD}), c AS (SELECT ts, val - avg(val) OVER () AS e FROM s), x AS (SELECT *, {shifted} FROM c), a AS ({sums})" + (ask or
            " SELECT CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(CASE WHEN lag > 0 THEN 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
            "/ (SELECT count(*) FROM s)) ELSE 0 END, 6) AS band FROM a"))


@query(acf_sql(20))
def acf(spark, d):
    return rounded(plotdata.autocorrelation(daily(spark, d), 20), "acf", "band")


LEVINSON = """, r AS (SELECT list(acf ORDER BY lag) AS a FROM a),
w AS (SELECT 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS rest, 1.0::DOUBLE AS now, a FROM r
  UNION ALL SELECT k + 1, list_append([phi[j] - t.new * phi[k + 1 - j] FOR j IN range(1, k + 1)], t.new), rest * (1 - t.new * t.new), t.new, a
  FROM (SELECT *, (a[k + 2] - coalesce(list_sum([phi[j] * a[k + 2 - j] FOR j IN range(1, k + 1)]), 0)) / rest AS new FROM w WHERE k < 20) t)
SELECT CAST(k AS INTEGER) AS lag, round(now, 6) AS pacf FROM w"""


@query(acf_sql(20, LEVINSON))
def pacf(spark, d):
    values = plotdata.partial_autocorrelation(daily(spark, d), 20)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "lag int, pacf double")


@query(f"""WITH s AS ({SD}), r AS (SELECT min(ts) AS a, max(ts) AS b FROM s), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM r)
SELECT g.ts, p.val IS NULL OR p.ts <> g.ts AS filled, round(CASE WHEN p.ts = g.ts THEN p.val ELSE p.val + (n.val - p.val) * (epoch_us(g.ts) - epoch_us(p.ts)) / (epoch_us(n.ts) - epoch_us(p.ts)) END, 4) AS val
FROM g ASOF LEFT JOIN s p ON g.ts >= p.ts ASOF LEFT JOIN s n ON g.ts <= n.ts""")
def resample_interpolate(spark, d):
    return rounded(plotdata.resample(daily(spark, d)), "val", digits=4)


@query(f"""WITH s AS ({SR}) SELECT ts, round(CASE WHEN ts >= (SELECT min(ts) FROM s) + INTERVAL 28 DAY THEN avg(val) OVER w END, 6) AS mean, round(CASE WHEN ts >= (SELECT min(ts) FROM s) + INTERVAL 28 DAY THEN stddev_samp(val) OVER w END, 6) AS std
FROM s WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 28 DAY - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)""")
def rolling_stats_warm(spark, d):
    return rounded(plotdata.rolling_stats(roots(spark, d), "28d"), "mean", "std")


@query("""SELECT user_id, ts, CASE WHEN count(*) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS mean, CASE WHEN count(*) OVER w = 5 THEN round(stddev_samp(value) OVER w, 6) END AS std
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_stats_rows(spark, d):
    return rounded(plotdata.rolling_stats(read(spark, d, "events"), 5, val="value", keys=["user_id"]), "mean", "std")


# ---- evaluation -------------------------------------------------------------


@query(f"SELECT y_true AS actual, y_pred AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y_true), 6) AS share FROM ({SC}) GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return rounded(metrics.confusion(scored(spark, d)), "share")


CURVE = f"""WITH g AS (SELECT y_proba AS threshold, sum(y_true) AS p, count(*) AS n FROM ({SC}) GROUP BY 1),
c AS (SELECT threshold, p, n, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () AS pos, sum(n - p) OVER () AS neg FROM g WINDOW w AS (ORDER BY threshold DESC))"""


@query(f"{CURVE} SELECT threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM c")
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(scored(spark, d)), "fpr", "tpr")


@query(f"{CURVE} SELECT round(sum(p * (neg - fp + (n - p) / 2.0::DOUBLE)) / any_value(pos * neg), 6) AS auc FROM c")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d)), "auc")


@query(f"{CURVE} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM c")
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(scored(spark, d)), "precision", "recall")


@query(f"{CURVE} SELECT round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return rounded(metrics.average_precision(scored(spark, d)), "average_precision")


@query(f"""WITH t AS ({SC}), e AS (SELECT list_distinct(quantile_cont(y_proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM t)
SELECT CAST(len(list_filter(e, lambda v: v < y_proba)) AS INTEGER) AS bin, count(*) AS n, round(avg(y_proba), 6) AS predicted, round(avg(y_true), 6) AS observed FROM t, e GROUP BY 1""")
def calibration(spark, d):
    return rounded(plotdata.calibration(scored(spark, d)), "predicted", "observed")


@query(f"SELECT least(CAST(floor(y_proba * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM ({SC}) GROUP BY 1")
def probability_histogram(spark, d):
    return plotdata.probability_histogram(scored(spark, d))


@query(f"""WITH t AS ({SC}), c AS (SELECT k, count(*) FILTER (y_true = k AND y_pred = k)::DOUBLE AS tp, count(*) FILTER (y_pred = k) AS told, count(*) FILTER (y_true = k) AS had FROM t, (VALUES (0), (1)) v(k) GROUP BY k),
s AS (SELECT coalesce(tp / nullif(told, 0), 0) AS p, coalesce(tp / nullif(had, 0), 0) AS r, coalesce(2 * tp / nullif(told + had, 0), 0) AS f FROM c)
SELECT round((SELECT avg(CAST(y_true = y_pred AS INTEGER)) FROM t), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM s""")
def classification_metrics(spark, d):
    return rounded(metrics.classification_metrics(scored(spark, d)), "accuracy", "precision", "recall", "f1")


@query(f"SELECT round(avg(-CASE WHEN y_true = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM (SELECT y_true, least(greatest(y_proba, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE) AS p FROM ({SC}))")
def log_loss(spark, d):
    return rounded(metrics.log_loss(scored(spark, d)), "log_loss")


@query(f"""WITH t AS ({PR}), m AS (SELECT avg(y_true) AS m FROM t) SELECT round(avg(abs(y_true - y_pred) / abs(y_true)), 6) AS mape, round(avg(abs(y_true - y_pred)), 4) AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 4) AS rmse,
  round(avg(pow(y_true - y_pred, 2)), 0) AS mse, round(1 - sum(pow(y_true - y_pred, 2)) / sum(pow(y_true - m, 2)), 6) AS r2 FROM t, m""")
def regression_metrics(spark, d):
    out = rounded(metrics.regression_metrics(predicted(spark, d)), "mape", "r2")
    return rounded(rounded(out, "mae", "rmse", digits=4), "mse", digits=0)


@query(f"""WITH t AS ({PR}), e AS (SELECT list_distinct(quantile_cont(y_pred, [x / 20.0 FOR x IN range(1, 20)])) AS e FROM t)
SELECT CAST(len(list_filter(e, lambda v: v < y_pred)) AS INTEGER) AS bin, count(*) AS n, round(avg(y_pred), 4) AS predicted, round(avg(y_true - y_pred), 4) AS residual FROM t, e GROUP BY 1""")
def residual_bins(spark, d):
    return rounded(plotdata.residual_bins(predicted(spark, d)), "predicted", "residual", digits=4)


@query(f"SELECT round(avg(y_true - y_pred), 4) AS mean, round(stddev_pop(y_true - y_pred), 4) AS std FROM ({PR})")
def residual_summary(spark, d):
    return rounded(plotdata.residual_summary(predicted(spark, d)), "mean", "std", digits=4)


@query(f"WITH s AS (SELECT ts, epoch_us(ts) - epoch_us(before) AS s FROM ({STEPS})) SELECT ts, coalesce(s > 2 * (SELECT median(s) FROM s), false) AS starts FROM s")
def forecast_gaps(spark, d):
    return plotdata.forecast_breaks(daily(spark, d))


@query("SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 < 8 UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey % 10 = 8 UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey % 10 = 9")
def final_fit_stack(spark, d):
    from ..tuning.search import stack

    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    return stack(rows.where("k % 10 < 8"), rows.where("k % 10 = 8"), rows.where("k % 10 = 9"))



@query(f"""WITH s AS ({SC}), c AS (SELECT unnest([0, 1]) AS class)
SELECT CAST(class AS INTEGER) AS class, round(coalesce(count(*) FILTER (y_true = class AND y_pred = class) / nullif(count(*) FILTER (y_pred = class), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (y_true = class AND y_pred = class) / nullif(count(*) FILTER (y_true = class), 0), 0), 6) AS recall,
round(coalesce(2.0 * count(*) FILTER (y_true = class AND y_pred = class) / nullif(count(*) FILTER (y_true = class) + count(*) FILTER (y_pred = class), 0), 0), 6) AS f1,
count(*) FILTER (y_true = class) AS support FROM s, c GROUP BY class""")
def class_scores(spark, d):
    out = rounded(metrics.class_scores(scored(spark, d)), "precision", "recall", "f1")
    return out.withColumns({"class": F.col("class").cast("int"), "support": F.col("support").cast("long")})


@query()
def decomposition_stl(spark, d):
    from ..operators.decomposition import decompose

    return rounded(decompose(plotdata.resample(daily(spark, d)), [7]), "trend", "seasonal_7", "remainder", digits=4)


@query()
def forecast_seasonal(spark, d):
    """The last 90 days of the daily series, forecast from those before."""
    from ..tuning.forecast import SeasonalModel

    series = roots(spark, d).select(F.col("ts").alias("ds"), F.col("val").alias("y"))
    last = series.agg(F.max("ds")).first()[0]
    cut = F.lit(last) - F.expr("INTERVAL 90 DAYS")
    model = SeasonalModel().fit(series.where(F.col("ds") <= cut))
    return rounded(model.predict(series.where(F.col("ds") > cut)), "y", "trend", "yhat", "yhat_lower", "yhat_upper", digits=3)


@query()
def tune_gbt(spark, d):
    """Trials of a small search for line prices, with their errors on the test rows."""
    from ..tuning.search import fit_gbt_regressor
    from ..tuning.space import CategoricalDimension, HyperparameterSpace

    lines_ = read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    train, val, test = (lines_.where(f"l_orderkey % 10 {c}") for c in ("< 8", "= 8", "= 9"))
    space = HyperparameterSpace("regressor", {"maxIter": CategoricalDimension((5,)), "maxDepth": CategoricalDimension((2, 4))})
    tuned = fit_gbt_regressor(train, test, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", val, space, n_trials=2)
    return spark.createDataFrame([(i, p["maxDepth"], round(s, 3)) for i, (p, s) in enumerate(tuned.trials)], "trial int, max_depth int, rmse double")


# ---- images, files, streams ---------------------------------------------------


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or 'file:///tmp/checkpoints/featspark').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def nation_images(spark: SparkSession, d: str) -> str:
    """A folder with a small gray picture for each nation."""
    def draw(parts):
        for part in parts:
            rows = []
            for key, region in zip(part["n_nationkey"], part["n_regionkey"], strict=True):
                a = ((np.arange(region + 3)[:, None] * 7 + np.arange(key + 4)[None, :] * 3 + key) % 256).astype(np.uint8)
                rows.append((f"/nation{key}.raw", list(a.shape), "uint8", a.tobytes(), None))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "data", "error"])

    folder = shared_folder(spark, "nation-images")
    images.write_images(read(spark, d, "nation").select("n_nationkey", "n_regionkey").mapInPandas(draw, images.PIXELS), folder)
    return folder


NATION_PIXELS = """(SELECT n_nationkey AS k, n_regionkey + 3 AS h, n_nationkey + 4 AS w, y, x, (y * 7 + x * 3 + n_nationkey) % 256 AS v
FROM nation, range(40) a(y), range(40) b(x) WHERE y < n_regionkey + 3 AND x < n_nationkey + 4)"""


def image_key():
    return F.regexp_extract("path", "nation([0-9]+)", 1).cast("int").alias("k")


@query(f"SELECT CAST(k AS INTEGER) AS k, true AS readable, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, round(w / h::DOUBLE, 6) AS aspect, 1 AS channels, round(avg(v), 6) AS brightness, "
       f"round(stddev_pop(v), 6) AS contrast FROM {NATION_PIXELS} GROUP BY k, w, h")
def image_summary(spark, d):
    made = images.summarize_images(spark, nation_images(spark, d))
    return rounded(made.select(image_key(), "readable", "width", "height", "aspect", "channels", "brightness", "contrast"), "aspect", "brightness", "contrast")


@query(f"SELECT CAST(k AS INTEGER) AS k, 2 AS height, 3 AS width, CAST(sum(v * (1 + i)) AS BIGINT) AS checksum FROM (SELECT k, v, (y - (h - 2) // 2) * 3 + ((w - 1 - x) - (w - 3) // 2) AS i "
       f"FROM {NATION_PIXELS} WHERE y - (h - 2) // 2 BETWEEN 0 AND 1 AND (w - 1 - x) - (w - 3) // 2 BETWEEN 0 AND 2) GROUP BY k")
def image_steps(spark, d):
    """The middle of each mirrored picture: every pixel counts with its place."""
    made = images.ImagePipeline([steps.Flip(), steps.CenterCrop((3, 2))]).load_many(spark, nation_images(spark, d), grayscale=True)
    pixel = F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long") * i)
    return made.select(image_key(), F.col("shape")[0].alias("height"), F.col("shape")[1].alias("width"), F.aggregate(pixel, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice, o_orderpriority FROM orders")
def source_csv(spark, d):
    """Orders written as CSV with American dates and read with the pattern of these."""
    path = shared_folder(spark, "orders-csv")
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "MM/dd/yyyy HH:mm").alias("ts")
    read(spark, d, "orders").select("o_orderkey", text, "o_totalprice", "o_orderpriority").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "o_orderkey bigint, ts string, o_totalprice double, o_orderpriority string", times={"ts": "MM/dd/yyyy HH:mm"})


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read to the end."""
    out = shared_folder(spark, "stream")
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events*.parquet")


@query("""WITH w AS (SELECT event_type, to_timestamp(0)::TIMESTAMP + to_microseconds((epoch_us(ts) // 10800000000 - k) * 10800000000) AS start, value FROM events, range(2) r(k))
SELECT event_type, start, start + INTERVAL 6 HOUR AS "end", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
FROM w GROUP BY ALL HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_rolling(spark, d):
    """Windows that are final once the whole table has streamed by."""
    out = drained(spark, streams.stream_rolling(event_stream(spark, d), "6 hours", "3 hours", "event_type", val="value", horizon="1 hour"))
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), "mean", "std")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, ts, CAST((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) // 1000000 AS BIGINT) AS secs_since_last_obs FROM events""")
def stream_gaps(spark, d):
    out = drained(spark, streams.stream_gaps(event_stream(spark, d), "user_id", forget_after="400 days"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - a) / (b - a), 0), 1), 6) AS l_extendedprice FROM lineitem, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)")
def stream_scaled(spark, d):
    """A fitted transform on a stream."""
    lines_ = read(spark, d, "lineitem")
    fitted = NumericFeatures().fit(lines_, scale={"minmax": ["l_extendedprice"]})
    stream = spark.readStream.schema(lines_.schema).parquet(f"{d}/lineitem*.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(drained(spark, streams.apply_fitted(stream, fitted)), "l_extendedprice")
