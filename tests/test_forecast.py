from datetime import datetime, timedelta

import numpy as np
import pytest

from featspark.tuning.forecast import SeasonalModel, fit_seasonal_model
from featspark.tuning.space import rolling_origins
from featspark.tuning.search import probability_score
from featspark.tuning.space import CategoricalDimension, FloatDimension, HyperparameterSpace, IntegerDimension, ParzenSampler

START = datetime(2024, 1, 1)
SCHEMA = "ds timestamp_ntz, y double, x double"


def series(n, kind="additive", start=0):
    rng, rows = np.random.default_rng(1), []
    noise, x = rng.normal(0, 0.3, 1000), rng.normal(0, 1, 1000)
    for i in range(start, start + n):
        trend, week = 50 + 0.1 * i, np.sin(2 * np.pi * i / 7)
        rows.append((START + timedelta(days=i), float((trend * (1 + 0.2 * week) if kind == "multiplicative" else trend + 5 * week + 2 * x[i]) + noise[i]), float(x[i])))
    return rows


def test_fit_equals_ridge_over_all_rows(spark):
    rows = series(120)
    odd = [(None, 1.0, 0.0), (START, None, 0.0), (START, float("nan"), 0.0), (START, 1.0, None)]
    model = SeasonalModel(("x",), n_changepoints=3).fit(spark.createDataFrame(rows + odd, SCHEMA).repartition(3))
    assert model.seasons == ((7.0, 3),)
    t = np.arange(120) / 119
    angle = 2 * np.pi * (np.array([(r[0] - datetime(1970, 1, 1)).days for r in rows])[:, None] / 7) * np.arange(1, 4)
    x = np.array([r[2] for r in rows])
    bends = np.maximum(t[:, None] - np.array([1, 2, 3]) / 3 * 0.8, 0)
    a = np.column_stack([np.ones(120), t, bends, np.sin(angle), np.cos(angle), (x - x.mean()) / x.std(ddof=1)])
    y = np.array([r[1] for r in rows])
    y = y / abs(y).max()
    prior = np.diag([1 / 25] * 2 + [0.05 ** -2] * 3 + [0.01] * 7)
    sigma2 = 0.25
    for _ in range(10):
        b = np.linalg.solve(a.T @ a + sigma2 * prior, a.T @ y)
        sigma2 = ((y - a @ b) ** 2).mean()
    assert np.allclose(model.coefficients, b, atol=1e-6) and abs(model.sigma - sigma2 ** 0.5) < 1e-6


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_forecasts(spark, mode):
    train, test = spark.createDataFrame(series(200, mode), SCHEMA), spark.createDataFrame(series(40, mode, 200), SCHEMA)
    names = ("x",) if mode == "additive" else ()
    got = SeasonalModel(names, seasonality_mode=mode).fit(train).predict(test).orderBy("ds").collect()
    assert max(abs(r["yhat"] - r["y"]) for r in got) < 2.5
    width = [r["yhat_upper"] - r["yhat_lower"] for r in got]
    assert width == sorted(width) and width[0] > 0
    none = SeasonalModel(names).fit(train).predict(spark.createDataFrame([(None, 1.0, 0.0), (START, 1.0, None)], SCHEMA)).collect()
    assert none[0]["yhat"] is None and (none[1]["yhat"] is None) == bool(names)


def test_search(spark):
    train, test = spark.createDataFrame(series(120), SCHEMA), spark.createDataFrame(series(20, start=120), SCHEMA)
    space = HyperparameterSpace("seasonal", {"seasonality_prior_scale": CategoricalDimension((0.001, 10.0)), "n_changepoints": CategoricalDimension((3,))})
    got = fit_seasonal_model(train, test, space=space, n_trials=4, horizon=timedelta(days=20), final_fit_data="train_test")
    assert len(got.trials) == 4 and got.params["seasonality_prior_scale"] == 10.0 and got.metrics["mape"] < 0.02
    assert got.model.span == 139 * 86400
    with pytest.raises(ValueError, match="needs y_test to start"):
        fit_seasonal_model(train, train, final_fit_data="train_test")
    with pytest.raises(ValueError, match="take a span"):
        fit_seasonal_model(train, test, n_trials=1)
    with pytest.raises(ValueError, match="no columns"):
        fit_seasonal_model(train, test, ["z"])
    with pytest.raises(ValueError, match="two instants"):
        SeasonalModel().fit(train.limit(0))


def test_rolling_origins():
    assert rolling_origins(100, 10, 7) == [30, 40, 50, 60, 70, 80, 90]
    assert rolling_origins(45 * 86400, 10 * 86400, 7 * 86400, step=86400) == [d * 86400 for d in (31, 33, 35)]
    assert rolling_origins(100, 10, 20, 3) == [30, 40, 50, 60, 70, 80, 90] and rolling_origins(40, 10, 7, 1) == [30]
    with pytest.raises(ValueError, match="span"):
        rolling_origins(39, 10, 7)


def test_probability_scores(spark):
    from pyspark.ml.linalg import Vectors

    two = spark.createDataFrame([(0, Vectors.dense(0.9, 0.1)), (1, Vectors.dense(0.4, 0.6)), (1, Vectors.dense(0.95, 0.05)), (0, Vectors.dense(0.5, 0.5))], ["c", "probability"])
    assert probability_score(two, "roc_auc", "c") == 0.5
    assert abs(probability_score(two, "log_loss", "c") + np.mean(np.log([0.9, 0.6, 0.05, 0.5]))) < 1e-12
    many = spark.createDataFrame([(i, Vectors.dense(*[0.8 if i == j else 0.1 for j in range(3)])) for i in range(3)] + [(5, Vectors.dense(0.2, 0.4, 0.4))], ["c", "probability"])
    assert probability_score(many, "roc_auc", "c") == 1.0 and probability_score(many, "log_loss", "c") > 5


def test_parzen_search_beats_chance():
    space = HyperparameterSpace("seasonal", {"a": FloatDimension(0.0, 1.0), "b": FloatDimension(1e-4, 1.0, log=True), "c": IntegerDimension(1, 41, 4),
                                             "d": CategoricalDimension(("p", "q", None)), "e": FloatDimension(0.0, 1.0, step=0.1), "f": IntegerDimension(3, 3)})

    def loss(v):
        return abs(v["a"] - 0.3) + abs(np.log10(v["b"]) + 2) + abs(v["c"] - 21) / 20 + (v["d"] != "q") + abs(v["e"] - 0.5)

    wins = 0
    for seed in range(20):
        best = {}
        for startup in (10, 80):
            sampler = ParzenSampler(space, False, seed, startup)
            for _ in range(80):
                params = sampler.ask()
                assert all(d.contains(params[k]) for k, d in space.dimensions.items())
                sampler.tell(params, loss(params))
            best[startup] = min(score for _, score in sampler.told)
        wins += best[10] < best[80]
    assert wins >= 15
    sampler = ParzenSampler(space, True, startup=1)
    sampler.tell(space.suggest(sampler.rng), float("nan"))
    assert sampler.ask()["f"] == 3
