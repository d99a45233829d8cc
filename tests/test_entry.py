import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["ts_rolling_horizon", "ts_lag_units", "ts_holiday_us", "num_pipeline", "enc_target_oof", "summarize_orders", "acf", "roc_curve", "class_scores"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"select {listed} from ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    assert sorted(got, key=str) == sorted([tuple(plain(v) for v in r) for r in want], key=str)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_add_on(tmp_path):
    root = Path(entry.__file__).parent
    code = ("import sys; sys.modules['featspark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; assert 'ts_gap' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.oracle_sql())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_models_give_rows(spark):
    made = entry.queries()
    parts = made["decomposition_stl"](spark, SF).collect()
    assert parts and all(abs(r["val"] - r["trend"] - r["seasonal_7"] - r["remainder"]) < 1e-3 for r in parts)
    ahead = made["forecast_seasonal"](spark, SF).collect()
    assert ahead and all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] for r in ahead)
    assert [r["trial"] for r in made["tune_gbt"](spark, SF).orderBy("trial").collect()] == [0, 1]
