import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from featspark import ClassifierPlotter, EDAPlotter, RegressionPlotter, TimeSeriesPlotter
from featspark.operators import metrics, plotdata
from featspark.operators.decomposition import decompose, mstl, stl

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    rows = [(float(x), float(2 * x + e), float(math.exp(x)), int(k), "uvw"[k % 3] if k % 7 else None, bool(k % 2)) for x, e, k in zip(a, rng.normal(size=200) / 10, rng.poisson(3, 200), strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, k int, g string, f boolean")


@pytest.fixture(scope="module")
def sine(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(START + timedelta(hours=h), 100 + 10 * math.sin(2 * math.pi * h / 24) + float(rng.normal() / 5)) for h in range(672)], "ts timestamp_ntz, val double")


def test_eda(table):
    p = EDAPlotter(table)
    corr = {(r["a"], r["b"]): r["corr"] for r in p.corr_heatmap().collect()}
    assert corr["a", "a"] == 1.0 and corr["a", "b"] > 0.98 and len(corr) == 16
    assert {(r["a"], r["b"]): r["corr"] for r in p.corr_heatmap(["a", "c"], "spearman").collect()}["a", "c"] == 1.0
    counts = p.category_counts("g", 2).orderBy("place").collect()
    assert sum(r["n"] for r in counts) == 200 and counts[-1]["value"].startswith("other (")
    h = p.histogram("a").collect()
    assert sum(r["n"] for r in h) == 200 and abs(sum(r["share"] for r in h) - 1) < 1e-9
    assert {r["low"] for r in p.histogram("k").collect()} == {float(r["k"]) for r in table.select("k").distinct().collect()}
    box = {r["group"]: r for r in p.boxplot("b", by="g").collect()}
    assert set(box) == {"u", "v", "w"} and all(r["low"] <= r["q1"] <= r["median"] <= r["q3"] <= r["high"] for r in box.values())
    target = p.feature_target("a", "f", n_bins=5).collect()
    assert len(target) == 5 and sum(r["n"] for r in target) == 200
    with pytest.raises(ValueError, match="two numeric"):
        p.corr_heatmap(["a"])


def test_kde_matches_a_direct_sum(table):
    xs = np.array([r["b"] for r in table.collect()])
    h = xs.std(ddof=1) * len(xs) ** -0.2
    for r in plotdata.kde(table, "b", points=20).collect():
        assert r["density"] == pytest.approx(np.mean(np.exp(-0.5 * ((r["x"] - xs) / h) ** 2)) / h / math.sqrt(2 * math.pi), rel=1e-4)


def test_gaps(spark):
    rng = random.Random(0)
    gone = set(rng.sample(range(1, 99), 30))
    hours = [h for h in range(100) if h not in gone] + [0, 5]
    df = spark.createDataFrame([(START + timedelta(hours=h), 1.0) for h in hours], "ts timestamp_ntz, val double")
    found, totals = TimeSeriesPlotter(df).gaps(3_600_000_000)
    assert found.agg({"missing": "sum"}).first()[0] == 30
    row = totals.first()
    assert (row["duplicates"], row["missing"]) == (2 - (5 in gone) * 1, 30) and row["share"] == pytest.approx(0.3)
    steps = spark.createDataFrame([(START + timedelta(hours=h),) for h in [0, 1, 2, 4, 5, 5, 6]], "ts timestamp_ntz")
    assert plotdata.infer_interval(steps) == 3_600_000_000
    with pytest.raises(ValueError, match="two distinct"):
        plotdata.infer_interval(steps.limit(1))
    assert plotdata.default_period(3_600_000_000) == 24 and plotdata.default_period(86_400_000_000) == 7


def test_autocorrelation(sine):
    xs = np.array([r["val"] for r in sine.orderBy("ts").collect()])
    d = xs - xs.mean()
    want = [1.0] + [float((d[k:] * d[:-k]).sum() / (d * d).sum()) for k in range(1, 31)]
    got = plotdata.autocorrelation(sine, 30).orderBy("lag").collect()
    assert np.allclose([r["acf"] for r in got], want) and got[1]["band"] == pytest.approx(1.959964 / math.sqrt(672), rel=1e-5)
    pacf = plotdata.levinson_durbin(want)
    for k in (1, 2, 5):
        m = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(m, want[1:k + 1])[-1])


def test_resample_and_rolling(spark, sine):
    holes = sine.where("hour(ts) <> 3 or day(ts) = 1")
    full = plotdata.resample(holes, 3_600_000_000)
    assert full.count() == 672 and full.where("filled").count() == 672 - holes.count()
    r = plotdata.rolling_stats(sine, "1d").orderBy("ts").collect()
    assert [x["mean"] is None for x in r[:26]] == [True] * 24 + [False] * 2
    assert plotdata.rolling_stats(sine, 5, keys=[]).where("mean is null").count() == 4


def test_decomposition(sine):
    out = decompose(sine, [24]).orderBy("ts").collect()
    y, t, s, e = (np.array([r[k] for r in out]) for k in ("val", "trend", "seasonal_24", "remainder"))
    assert np.allclose(y, t + s + e) and np.abs(t[24:-24] - 100).max() < 0.5 and e.std() < 0.4 and 13 < s.max() - s.min() < 23
    i = np.arange(400)
    y = 0.05 * i + 5 * np.sin(2 * np.pi * i / 7) + 3 * np.sin(2 * np.pi * i / 30)
    y[50] += 60
    parts = mstl(y, [30, 7], robust=True)
    assert np.allclose(sum(parts.values()), y) and abs(parts["remainder"][50] - 60) < 6
    with pytest.raises(ValueError, match="two periods"):
        stl(y[:10], 7)


def test_scores(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y_true int, y_proba double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(auc)
    roc = metrics.roc_curve(df).orderBy("fpr", "tpr").collect()
    area, x, y = 0.0, 0.0, 0.0
    for r in roc:
        area, x, y = area + (r["fpr"] - x) * (r["tpr"] + y) / 2, r["fpr"], r["tpr"]
    assert area == pytest.approx(auc) and (x, y) == (1.0, 1.0)
    steps = sorted({p for _, p in rows}, reverse=True)
    ap, before = 0.0, 0.0
    for s in steps:
        tp = sum(p >= s for p in pos)
        ap, before = ap + (tp / len(pos) - before) * tp / sum(p >= s for _, p in rows), tp / len(pos)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(df.where("y_true = 1")).first()["auc"] is None
    assert sum(r["n"] for r in plotdata.calibration(df).collect()) == 400 == sum(r["n"] for r in plotdata.probability_histogram(df).collect())


def test_classifier_and_regression_charts(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        k = rng.randrange(3)
        w = [rng.random() + (i == k) for i in range(3)]
        rows.append((k, [x / sum(w) for x in w]))
    df = spark.createDataFrame(rows, "y_true int, proba array<double>")
    p = ClassifierPlotter(df, y_proba="proba")
    right = sum(max(range(3), key=lambda i: w[i]) == k for k, w in rows) / 300
    assert metrics.classification_metrics(p.df).first()["accuracy"] == pytest.approx(right)
    assert set(p.roc_curves()) == {0, 1, 2} and sum(r["n"] for r in p.confusion_matrix().collect()) == 300
    with pytest.raises(ValueError, match="needed"):
        ClassifierPlotter(df)
    pairs = [(50 + 10 * rng.gauss(0, 1),) for _ in range(300)]
    reg = spark.createDataFrame([(y, y + rng.gauss(0, 3)) for y, in pairs], "y_true double, y_pred double")
    d = RegressionPlotter(reg).diagnostics()
    assert d["bins"].count() == 12 and 0.8 < d["metrics"].first()["r2"] < 1
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y_true double, y_pred double")
    assert math.isnan(metrics.regression_metrics(flat).first()["r2"])
    assert plotdata.feature_importance({"a": 3.0, "b": 1.0, "c": 0.5, "d": 0.0}, 1) == [("a", 3 / 4.5), ("other (2)", pytest.approx(1.5 / 4.5))]
    with pytest.raises(ValueError, match="no splits"):
        plotdata.feature_importance({"a": 0.0})
