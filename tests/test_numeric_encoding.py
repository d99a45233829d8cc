import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from featspark import EncodingFeatures, NumericFeatures, signed_log1p, summarize
from featspark.functions.quantiles import exact_quantiles
from featspark.plans.inspect import unwanted


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def values(df, name="x"):
    return [r[name] for r in df.collect()]


def test_impute_counts_nan_as_missing(spark):
    df = column(spark, [1.0, 2.0, 6.0, float("nan"), None])
    for method, fill in (("median", 2.0), ("mean", 3.0), ("zero", 0.0)):
        assert sorted(values(NumericFeatures().fit(df, impute={method: ["x"]}).impute(df))) == sorted([1.0, 2.0, 6.0, fill, fill])
    empty = column(spark, [None, float("nan")])
    assert values(NumericFeatures().fit(empty, impute={"median": ["x"]}).impute(empty)) == [0.0, 0.0]


def test_clip_and_scale_match_numpy(spark):
    rng = random.Random(0)
    xs = [rng.uniform(-1e4, 1e4) for _ in range(51)]
    df = column(spark, [*xs, None])
    low, high = np.quantile(xs, [0.1, 0.9])
    got = values(NumericFeatures().fit(df, clip=["x"], clip_quantiles=(0.1, 0.9)).clip(df))
    assert got[-1] is None and np.allclose(got[:-1], np.clip(xs, low, high))
    q = np.quantile(xs, [0.25, 0.5, 0.75])
    for method, center, spread in (("standard", np.mean(xs), np.std(xs, ddof=1)), ("minmax", min(xs), max(xs) - min(xs)), ("robust", q[1], q[2] - q[0])):
        got = values(NumericFeatures().fit(df, scale={method: ["x"]}).scale(df, suffix="_s"), "x_s")
        assert got[-1] is None and np.allclose(got[:-1], (np.array(xs) - center) / spread)
    flat = column(spark, [3.0, 3.0, 3.0])
    assert values(NumericFeatures().fit(flat, scale={"standard": ["x"]}).scale(flat)) == [0.0, 0.0, 0.0]


def test_logs(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(b), float(-a)) for a, b in zip(rng.lognormal(size=2000), rng.normal(size=2000), strict=True)], "skewed double, symmetric double, left double")
    assert NumericFeatures().fit(df, auto_log=True).logs == {"skewed": "log1p"}
    signed = column(spark, [-5.0, 0, 0, 0, 1, 1, 2, 500])
    assert NumericFeatures().fit(signed, auto_log=["x"]).logs == {"x": "signed"}
    assert [r[0] for r in column(spark, [-1.0, 0.0, None, 1.0]).select(signed_log1p("x")).collect()] == [-math.log(2), 0.0, None, math.log(2)]


def yj(x, lam):
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else ((x[up] + 1) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-12 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_power_transform(spark):
    rng = np.random.default_rng(1)
    xs = rng.lognormal(size=800) - 0.7
    df = column(spark, [float(x) for x in xs])
    fitted = NumericFeatures().fit(df, power_transform=["x"])
    grid = np.linspace(-5, 5, 4001)
    jacobian = np.sum(np.sign(xs) * np.log1p(np.abs(xs)))
    best = grid[np.argmax([-len(xs) / 2 * np.log(np.var(yj(xs, g))) + (g - 1) * jacobian for g in grid])]
    assert abs(fitted.lambdas["x"] - best) < 5e-3
    assert np.allclose(values(fitted.power_transform(df)), yj(xs, fitted.lambdas["x"]))
    near = column(spark, [0.0, 0.0, 0.0, 0.0, 2.2e-308])
    assert NumericFeatures().fit(near, power_transform=["x"]).lambdas == {"x": 1.0}


def test_pipeline_and_errors(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(None if i % 10 == 0 else float(v),) for i, v in enumerate(rng.lognormal(10, 1, 3000))], "income double")
    fitted = NumericFeatures().fit(df, impute={"median": ["income"]}, clip=["income"], auto_log=["income"], scale={"standard": ["income"]})
    out = fitted.transform(df)
    got = np.array(values(out, "income"))
    assert abs(got.mean()) < 1e-9 and abs(got.std(ddof=1) - 1) < 1e-9 and unwanted(out) == []
    with pytest.raises(RuntimeError):
        NumericFeatures().clip(df)
    with pytest.raises(ValueError, match="in both"):
        NumericFeatures().fit(df, auto_log=["income"], power_transform=["income"])
    with pytest.raises(ValueError, match="quantiles"):
        NumericFeatures().fit(df, clip=["income"], clip_quantiles=(0.9, 0.1))
    with pytest.raises(ValueError, match="not numeric"):
        NumericFeatures().fit(spark.createDataFrame([("a",)], "s string"), clip=["s"])


def test_quantiles_of_large_columns(spark):
    rng = np.random.default_rng(7)
    for xs in (rng.normal(size=4000), np.exp(rng.normal(size=3000) * 20), np.repeat([1.0, 2.0, 5.0], 1000), np.r_[np.zeros(2000), rng.normal(size=1001)], [4.0]):
        df = column(spark, xs)
        qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
        got = exact_quantiles(df, {"x": qs}, small=0, left=50)["x"]
        assert np.allclose(got, np.quantile(xs, qs), rtol=1e-12)
    assert exact_quantiles(column(spark, [None]), {"x": [0.5]}, small=0) == {"x": [None]}


CITY = "i int, city string, y int"


def labelled(spark, seed=0, n=40):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, None])) for i in range(n)] + [(n, "a", 0), (n + 1, "b", 1)]
    return rows, spark.createDataFrame(rows, CITY)


def test_target_encoding_matches_python(spark):
    rows, df = labelled(spark)
    fitted = EncodingFeatures().fit(df, target_encode=["city"], target="y", smoothing=3.0)
    known = [(c, y) for _, c, y in rows if y is not None]
    prior = sum(y for _, y in known) / len(known)
    for r in fitted.target_encode(spark.createDataFrame([*rows, (99, "z", None)], CITY)).collect():
        ys = [y for c, y in known if c == r["city"]] if r["city"] is not None else []
        assert r["city_te"] == pytest.approx((sum(ys) + 3 * prior) / (len(ys) + 3))
    with pytest.raises(ValueError, match="needs target"):
        EncodingFeatures().fit(df, target_encode=["city"])
    with pytest.raises(ValueError, match="two classes"):
        EncodingFeatures().fit(df.where("y = 1"), target_encode=["city"], target="y")


def test_out_of_fold_rates_do_not_see_their_own_label(spark):
    rows, df = labelled(spark, 1)
    flipped = spark.createDataFrame([(i, c, None if y is None else 1 - y if i == 5 else y) for i, c, y in rows], CITY)
    def encoded(d):
        return {r["i"]: r["city_te"] for r in EncodingFeatures().fit(d, target_encode=["city"], target="y").target_encode(d, folds=4, fold_by=["i"]).collect()}
    a, b = encoded(df), encoded(flipped)
    assert a[5] == b[5] and len(a) == len(rows)
    with pytest.raises(ValueError, match="two folds"):
        EncodingFeatures().fit(df, target_encode=["city"], target="y").target_encode(df, folds=1)


def test_other_encoders(spark):
    rows, df = labelled(spark, 2)
    fitted = EncodingFeatures().fit(df, to_enum=["city"], frequency_encode=["city"])
    assert fitted.categories == {"city": ["a", "b", "c"]}
    codes = {(c, r["city"]) for (_, c, _), r in zip(rows, fitted.categorical_to_enum(df).orderBy("i").collect(), strict=True)}
    assert codes <= {("a", 0), ("b", 1), ("c", 2), (None, None)}
    with pytest.raises(PySparkException, match="unseen category"):
        fitted.categorical_to_enum(spark.createDataFrame([(1, "z", 1)], CITY)).collect()
    share = {c: sum(c == d for _, d, _ in rows) / len(rows) for c in ("a", "b", "c", None)}
    new = spark.createDataFrame([*rows, (99, "z", None)], CITY)
    assert all(r["city_freq"] == pytest.approx(share.get(r["city"], 0.0)) for r in fitted.frequency_encode(new).collect())
    hot = EncodingFeatures().fit(df, to_onehot=["city"]).categorical_to_onehot(new)
    assert hot.columns == ["i", "y", "city_a", "city_b", "city_c"] and hot.where("i = 99 and city_a + city_b + city_c = 0").count() == 1
    nums = column(spark, [float(i) for i in range(10)] + [None])
    bins = EncodingFeatures().fit(nums, to_bin={"x": 3})
    assert np.allclose(bins.edges["x"], [3.0, 6.0]) and values(bins.numeric_to_bin(nums)) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, None]


def test_multiclass_target(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "x"), ("c", "x")], "city string, y string")
    out = EncodingFeatures().fit(df, target_encode=["city"], target="y", smoothing=1.0).target_encode(df)
    assert out.columns == ["city", "y", "city_te_x", "city_te_y", "city_te_z"]
    assert all(r["city_te_x"] + r["city_te_y"] + r["city_te_z"] == pytest.approx(1.0) for r in out.collect())


def test_summarize(spark):
    df = spark.createDataFrame([(0.0, 1, None, None)] * 8 + [(1.0, 2, "a", None), (100.0, None, "b", None), (float("nan"), 3, "a", None)], "x double, n int, s string, e double")
    got = {r["column"]: r for r in summarize(df).collect()}
    assert got["x"]["zeros_pct"] == 80 and got["x"]["skew"] > 2 and got["x"]["count"] == 11
    assert got["s"]["n_unique"] == 3 and got["s"]["mean"] is None and got["n"]["null_pct"] == pytest.approx(100 / 11)
    assert got["e"]["count"] == 0 and got["e"]["mean"] is None and got["e"]["n_unique"] == 1
    assert summarize(df.limit(0)).where("null_pct = 0 and count = 0").count() == 4
