from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.functions.durations import parse_duration
from featspark.functions.exprs import exact_sample
from featspark.functions.quantiles import group_quantiles
from featspark.operators import metrics, plotdata
from featspark.operators.encoding import AggregationFeatures
from featspark.operators.holidays import holidays_of
from featspark.operators.numeric import _top
from featspark.operators.timeseries import TimeseriesFeatures
from featspark.operators.windows import rolling

RNG = np.random.default_rng(8)


def table(spark, n=400, groups=3):
    rows = [(i % groups if i % 7 else None, float(v) if i % 5 else None) for i, v in enumerate(RNG.normal(size=n))]
    return spark.createDataFrame(rows, "g int, x double")


@pytest.mark.parametrize("small", [0, 60, 10_000])
def test_group_quantiles(spark, small):
    df = table(spark)
    by = {}
    for r in df.where("x is not null").collect():
        by.setdefault(r["g"], []).append(r["x"])
    for nearest in (False, True):
        got = {r["g"]: (r["q"], r["n"]) for r in group_quantiles(df, "g", "x", [0.25, 0.5, 0.75], nearest, small).collect()}
        for g, values in by.items():
            v = np.sort(values)
            want = [v[int(np.floor((len(v) - 1) * q + 0.5))] for q in (0.25, 0.5, 0.75)] if nearest else np.quantile(v, [0.25, 0.5, 0.75])
            assert np.allclose(got[g][0], want) and got[g][1] == len(v)
        assert set(got) == set(by)
    assert group_quantiles(df.limit(0), "g", "x", [0.5]).count() == 0
    with pytest.raises(ValueError, match="groups"):
        group_quantiles(df, "g", "x", [0.5], most=2)


def test_numbered_rows(spark):
    df = spark.range(3000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (id * 7919) % 3000) AS t", "id % 2 AS k")
    for keys in ([], ["k"]):
        made = plotdata.numbered_rows(df, "t", "i", keys).collect()
        series = {}
        for r in made:
            series.setdefault(tuple(r[k] for k in keys), []).append((r["i"], r["t"]))
        for rows in series.values():
            rows.sort()
            assert [i for i, _ in rows] == list(range(1, len(rows) + 1)) and [t for _, t in rows] == sorted(t for _, t in rows)


def test_no_window_over_all_rows(spark):
    """What meets in one partition is a row a slice: rows of the table are dealt by series and slice."""
    df = spark.range(5000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "cast(id as double) AS val", "id % 3 AS y_true", "id / 5000 AS y_proba")
    for made in (plotdata.rolling_stats(df, 5), metrics.curve(df.withColumn("y_true", (F.col("y_true") > 0).cast("int")))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" in plan and "Python" not in plan
        for line in plan.splitlines():
            if "Window [" in line and "_s#" not in line and "_b#" not in line:
                raise AssertionError(line)


def test_no_broadcast_of_a_row_a_series(spark):
    df = spark.range(100).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "cast(id as double) AS val", "id % 3 AS k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (plotdata.rolling_stats(df, "1h", keys=["k"]), plotdata.autocorrelation(df, 3, keys=["k"])):
            assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rare_class_scores_are_spread(spark):
    df = spark.range(20_000).selectExpr("id / 2e9 AS y_proba", "cast(id % 97 = 0 as int) AS y_true")
    got = metrics.running(df.withColumn("one", F.lit(1)), "y_proba", ["one"])
    assert got.where("before_one <> round(y_proba * 2e9)").count() == 0 and got.where("all_one <> 20000").count() == 0


def test_macro_curve():
    assert metrics.area([(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]) == 0.75


def test_macro_roc(spark):
    a = spark.createDataFrame([(0.0, 0.5), (0.5, 1.0), (1.0, 1.0)], "fpr double, tpr double")
    b = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    got = dict(metrics.macro_roc([a, b], points=5))
    assert got == pytest.approx({0.0: 0.25, 0.25: 0.5, 0.5: 0.75, 0.75: 0.875, 1.0: 1.0})


def test_holidays_by_rule():
    assert date(2024, 7, 14) in holidays_of("FR", [2024]) and date(2024, 4, 1) in holidays_of("IT", [2024]) and date(2024, 5, 30) in holidays_of("AT", [2024])
    english = holidays_of("GB", [2021, 2022, 2023])
    assert {date(2021, 12, 27), date(2021, 12, 28), date(2022, 1, 3), date(2022, 12, 27), date(2023, 1, 2), date(2023, 5, 1), date(2023, 8, 28)} <= english
    assert date(2021, 12, 29) not in english
    with pytest.raises(ValueError, match="country"):
        holidays_of("XX", [2024])
    with pytest.raises(ValueError, match="subdivisions"):
        holidays_of("FR", [2024], "BY")


def test_aggregation_features(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, x double")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = {r["k"]: (r["mean_x_by_k"], r["count_x_by_k"]) for r in AggregationFeatures({"x": ["mean", "count"]}, ["k"]).fit_transform(train, df).collect()}
    assert got == {"a": (2.0, 2), "b": (None, None), None: (5.0, 1)}


def test_sample_of_a_large_table(spark):
    df = spark.range(30_000)
    want = df.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(50)
    assert sorted(exact_sample(df, 50).collect()) == sorted(want.collect()) and exact_sample(df, 40_000).count() == 30_000


def test_parabola():
    grid = [0.0, 0.1, 0.2]
    assert _top(grid, [-(x - 0.13) ** 2 for x in grid], 1) == pytest.approx(0.13) and _top(grid, [1.0, 0.0, 0.0], 0) == 0.0


def test_ends_of_windows_slide_no_frame(spark):
    """Frames that slide are read anew at each row: a dense series took time with the square of its rows."""
    df = spark.range(60_000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id / 100) AS ts", "cast((id * 7919) % 60000 AS double) AS val")
    made = TimeseriesFeatures().rolling(df, ["3h"], ("min", "max"))
    frames = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
    assert frames and all(line.count("specifiedwindowframe(") == line.count("Frame, unboundedpreceding") for line in frames)
    last = made.orderBy(F.desc("ts")).first()
    assert (last["roll_min_3h"], last["roll_max_3h"]) == (0.0, 59_999.0)


def test_ends_of_windows_hold_what_sliding_frames_hold(spark):
    """Ties, nulls, NaN, infinities, times before 1970 and at the edges of blocks, gaps of many blocks, several series."""
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = []
    for i in range(1500):
        step = int(rng.choice([-1, 0, 1, 2])) + 60_000_000 * int(rng.choice([-500_000, *range(-40, 40)]))
        rows.append((None if i % 97 == 0 else step, [None, "a", "b"][i % 3], odd[i % 4] if i % 5 == 0 else float(rng.integers(-50, 50))))
    df = spark.createDataFrame(rows, "us long, k string, val double").selectExpr("cast(timestamp_micros(us) as timestamp_ntz) AS ts", "k", "val", "us").cache()
    windows = {"1s": 1, "1m": 60, "7m": 420, "2h": 7200}
    for keys in ([], ["k"]):
        made = rolling(df, "ts", "val", {w: parse_duration(w) for w in windows}, ("max", "mean", "min"), keys)
        assert made.columns == [*keys, "ts", *[f"roll_{s}_{w}" for w in windows for s in ("max", "mean", "min")]]
        over = ", ".join(f"{s}(val) OVER (PARTITION BY {', '.join(keys) or '1'} ORDER BY us RANGE BETWEEN {n * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS roll_{s}_{w}" for w, n in windows.items() for s in ("max", "min"))
        want = spark.sql(f"SELECT {', '.join([*keys, 'ts'])}, {over} FROM {{df}} WHERE us IS NOT NULL", df=df)
        assert made.count() == want.count() > 1400 and made.select(want.columns).exceptAll(want).count() == 0
    with pytest.raises(ValueError, match="longer"):
        rolling(df, "ts", "val", {"0h": parse_duration("0h")}, ("min",))
