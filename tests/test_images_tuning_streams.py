import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from featspark import NumericFeatures
from featspark.images import steps as st
from featspark.images.pipeline import ImagePipeline, from_row, image_histograms, image_sizes, image_totals, read_image, summarize_images, write_images
from featspark.sources.tables import date_range, read_csv, read_parquet, write_parquet
from featspark.streaming.features import apply_fitted, stream_gaps, stream_rolling
from featspark.tuning.search import fit_gbt_classifier, fit_gbt_regressor
from featspark.tuning.space import CategoricalDimension, FloatDimension, HyperparameterSpace, IntegerDimension, weighted_score

RNG = np.random.default_rng(0)


def picture(h, w, c=3):
    return RNG.integers(0, 256, (h, w, c) if c else (h, w)).astype(np.uint8)


def test_geometry():
    a = picture(10, 40)
    assert st.Resize((20, 20))(a).shape == (20, 20, 3) and (st.Resize((20, 20), pad_value=7)(a)[0] == 7).all()
    assert st.Resize((30, 20), "crop")(a).shape == st.Resize((30, 20), "stretch")(a).shape == (20, 30, 3)
    assert (st.Resize((40, 10), "stretch")(a) == a).all() and st.Resize(12)(a).shape == (12, 12, 3)
    wide = st.Resize((40, 40), pad_value=9)(a)
    assert (wide[15:25] == a).all() and (wide[:15] == 9).all() and (wide[25:] == 9).all() and st.Scale(0.01)(a).shape == (1, 1, 3)
    for k in range(4):
        assert (st.Rotate(90 * k)(a) == np.rot90(a, k)).all()
    assert (st.Rotate(360 - 30)(st.Rotate(30)(a)).shape[0]) > 10 and st.Rotate(30, expand=False)(a).shape == a.shape
    assert (st.Flip()(st.Flip()(a)) == a).all() and (st.Flip(False)(a) == a[::-1]).all()
    assert st.CenterCrop((6, 4))(a).shape == (4, 6, 3) and (st.CenterCrop((6, 4))(a) == a[3:7, 17:23]).all() and st.CenterCrop(4)(a).shape == (4, 4, 3)
    with pytest.raises(ValueError, match="crop"):
        st.CenterCrop((1, 11))(a)
    for bad in (0, (3, -1), (1, 2, 3), (2.5, 2)):
        with pytest.raises(ValueError, match="size"):
            st.Resize(bad)


def test_values():
    flat = np.full((9, 9, 3), 77, np.uint8)
    for step in (st.Smooth(1.5), st.Smooth(2, "median"), st.Sharpen(2.0), st.Resize((5, 5)), st.Rotate(45, expand=False, fill_value=77)):
        assert (step(flat) == 77).all()
    a = picture(16, 16)
    assert st.Sharpen(5.0)(a).dtype == np.uint8 and st.Smooth(2)(a).std() < a.std()
    gray = st.Grayscale()(a)
    assert gray.shape == (16, 16) and np.abs(gray - a @ st.LUMA).max() <= 0.5 and st.Grayscale(True)(a).shape == (16, 16, 3)
    assert np.abs(st.lab_to_rgb(st.rgb_to_lab(a)) - a).max() < 0.6
    dark = (picture(64, 64, 0) // 8 + 50).astype(np.uint8)
    assert st.Equalize(adaptive=False)(dark).std() > 3 * dark.std() and st.Equalize()(dark).std() > dark.std() and st.Equalize()(a).shape == a.shape
    with pytest.raises(ValueError, match="8-bit"):
        st.Equalize()(a.astype(np.uint16))
    f = st.ToFloat()(a)
    assert f.dtype == np.float32 and f.max() <= 1 and st.ToFloat()(a.astype(np.uint16)).max() < 0.01
    with pytest.raises(ValueError, match="floats"):
        st.Normalize()(a)
    assert st.ChannelsFirst()(st.Normalize()(f)).shape == (3, 16, 16) and st.ChannelsFirst()(gray).shape == (1, 16, 16)
    assert ImagePipeline([st.Flip(), ImagePipeline([lambda x: x + 0, st.Grayscale()])])(a).shape == (16, 16)


def test_image_tables(spark, tmp_path):
    a, g = picture(10, 40), picture(8, 8, 0)
    (tmp_path / "wide.png").write_bytes(st.png_bytes(a))
    (tmp_path / "gray.png").write_bytes(st.png_bytes(g))
    (tmp_path / "broken.png").write_bytes(b"no image")
    assert (read_image(spark, f"{tmp_path}/wide.png") == a).all() and (read_image(spark, f"{tmp_path}/gray.png", grayscale=True) == g).all()
    with pytest.raises(FileNotFoundError):
        read_image(spark, f"{tmp_path}/missing.png")
    with pytest.raises(ValueError, match="decoded"):
        read_image(spark, f"{tmp_path}/broken.png")
    out = ImagePipeline([st.Flip()]).load_many(spark, str(tmp_path))
    rows = {r["path"].rsplit("/")[-1]: r for r in out.collect()}
    assert (from_row(rows["wide.png"]) == a[:, ::-1]).all() and rows["broken.png"]["data"] is None
    assert write_images(out, f"file://{tmp_path}/out") == 2 and sorted(f.name for f in (tmp_path / "out").iterdir()) == ["gray.png", "wide.png"]
    assert (read_image(spark, f"{tmp_path}/out/wide.png") == a[:, ::-1]).all()
    with pytest.raises(ValueError, match="name"):
        write_images(out.unionAll(out), f"file://{tmp_path}/twice")
    paths = [f"{tmp_path}/{n}.png" for n in ("wide", "broken", "gray", "wide", "gray")]
    ordered = list(ImagePipeline([st.Flip()]).load_in_order(spark, paths, chunk=2))
    assert [r["path"].rsplit("/")[-1] for r in ordered] == ["wide.png", "broken.png", "gray.png", "wide.png", "gray.png"]
    assert (from_row(ordered[3]) == a[:, ::-1]).all() and ordered[1]["error"]
    got = {r["path"].rsplit("/")[-1]: r for r in summarize_images(spark, f"{tmp_path}/*.png").collect()}
    assert (got["wide.png"]["width"], got["wide.png"]["height"], got["gray.png"]["channels"]) == (40, 10, 1) and not got["broken.png"]["readable"]
    assert got["gray.png"]["brightness"] == pytest.approx(g.mean()) and got["gray.png"]["contrast"] == pytest.approx(g.std())
    s = summarize_images(spark, f"{tmp_path}/*.png")
    assert {r["feature"] for r in image_histograms(s, 4).collect()} == {"aspect", "brightness"}
    assert image_histograms(s, 4).groupBy("feature").agg({"n": "sum"}).first()[1] == 2
    assert image_sizes(s).count() == 2 and tuple(image_totals(s).first()) == (3, 1, 1, 0)


def test_spaces():
    rng = random.Random(0)
    for d in (IntegerDimension(1, 9, 2), IntegerDimension(1, 100, log=True), FloatDimension(0.0, 1.0), FloatDimension(0.0, 1.0, step=0.25), FloatDimension(0.01, 1, log=True), CategoricalDimension(("a", 1))):
        assert all(d.contains(d.suggest(rng)) for _ in range(50))
    assert IntegerDimension(1, 9, 2).values() == [1, 3, 5, 7, 9] and not IntegerDimension(0, 1).contains(True) and not FloatDimension(0, 1).contains(True)
    assert FloatDimension(1.0, np.e, log=True, n_points=3).values() == pytest.approx([0.0, 0.5, 1.0])
    space = HyperparameterSpace("regressor", {"max_depth": IntegerDimension(2, 3)}).with_defaults()
    assert space.with_defaults() == space and set(space.suggest(rng)) == set(space.value_spaces()) and "maxDepth" in space.dimensions
    assert weighted_score([1.0, 1.0, 1.0]) == 1.0
    with pytest.raises(ValueError, match="kind"):
        HyperparameterSpace.default("x")


def test_tuning(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(z), float(3 * x + rng.normal() / 10), int(x > 0), int(x > 0) + int(x > 1)) for x, z in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "x double, z double, y double, c int, m int")
    train, val, test = df.limit(200), df.limit(240).exceptAll(df.limit(200)), df.exceptAll(df.limit(240))
    space = HyperparameterSpace("regressor", {"max_depth": CategoricalDimension((1, 4)), "n_estimators": CategoricalDimension((3,))})
    tuned = fit_gbt_regressor(train, test, ["x", "z"], "y", val, space, n_trials=3, final_fit_data="train_val_test")
    assert len(tuned.trials) == 3 and tuned.score == min(s for _, s in tuned.trials) and tuned.importances(["x", "z"])["x"] > 0.8
    for label in ("c", "m"):
        got = fit_gbt_classifier(train, test, ["x", "z"], label, None, HyperparameterSpace("classifier", {"maxIter": CategoricalDimension((3,))}), n_trials=1)
        assert got.score > 0.7
    with pytest.raises(ValueError, match="space is for"):
        fit_gbt_classifier(train, test, ["x"], "c", space=space)
    with pytest.raises(ValueError, match="validation"):
        fit_gbt_regressor(train, test, ["x"], "y", final_fit_data="train_val")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,val\n01/31/2024 10:30,1.5\nbad,2\n")
    got = read_csv(spark, f"{tmp_path}/a.csv", times={"ts": "MM/dd/yyyy HH:mm"}).collect()
    assert got[0]["ts"] == datetime(2024, 1, 31, 10, 30) and got[1]["ts"] is None and got[0]["val"] == 1.5
    write_parquet(date_range(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "6 hours"), f"file://{tmp_path}/p")
    assert read_parquet(spark, f"file://{tmp_path}/p", ["ts"]).count() == 5


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=m), float(m)) for m in (0, 5, 7)] + [("b", start + timedelta(minutes=1), 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, val double")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    fitted = NumericFeatures().fit(df, scale={"minmax": ["val"]})
    jobs = {"scaled": (apply_fitted(stream, fitted), "append"), "gaps": (stream_gaps(stream, "k"), "append"), "rolled": (stream_rolling(stream, "10 minutes", "5 minutes", "k"), "complete")}
    for name, (out, mode) in jobs.items():
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        end = time.time() + 90
        while q.isActive and time.time() < end:
            time.sleep(0.2)
        q.stop()
        assert q.exception() is None
    assert spark.table("scaled").agg({"val": "max"}).first()[0] == 1.0
    assert sorted(((r["key"], r["secs_since_last_obs"]) for r in spark.table("gaps").collect()), key=str) == sorted([("a", None), ("a", 300), ("a", 120), ("b", None)], key=str)
    assert spark.table("rolled").where("k = 'a' and n = 3").count() == 1
