import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from featspark.llm import vector_search
from featspark.llm.vector_search import bounds, quantise, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, v string, asked int"


def brute(rows, step, k=5):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, a in sorted(fine):
        if q % step == 0 and q not in seen:
            seen.add(q)
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def check(df, step):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % step == 0).collect())) == brute(rows, step)


def test_table(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(df, 50)
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    monkeypatch.setattr(vector_search, "PAGE", 16)
    monkeypatch.setattr(vector_search, "SPAN", 2)
    check(df, 20)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0, "x", 1) for i in range(60)]
    rows += [(100, None, 0, "x", 1), (110, [], 0, "x", 1), (120, [1.0, None, 0.0, 0.0], 0, "x", 1), (130, [1.0, float("nan"), 0.0, 0.0], 0, "x", 1),
             (140, [1.0, float("inf"), 0.0, 0.0], 0, "x", 1), (None, [1.0, 1.0, 1.0, 1.0], 0, "x", 1), (150, [1.0, 2.0], 0, "x", 1), (160, [1.0, 2.0], 0, "x", 1),
             (170, [3.0], 0, "x", 1), rows[10], rows[11], rows[11], (180, [0.0] * 4, 0, "x", 1), (190, [1e6, 1e6, 0.0, -1e6], 0, "x", 1)]
    check(spark.createDataFrame(rows, SCHEMA), 10)
    ties = [(i, [1.0, 0.5], 0, "x", 1) for i in range(40)]
    check(spark.createDataFrame(ties, SCHEMA), 10)
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e30], 0, "x", 1), (1, [1e30], 0, "x", 1)], SCHEMA)
    with pytest.raises(PySparkException):
        top_k(big, F.col("vec_id") % 50 == 0).collect()


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1, 100, 10 ** 6):
        exact = np.floor(rng.normal(size=(500, 16)) * scale)
        queries = np.floor(rng.normal(size=(20, 16)) * scale)
        low, width, cells = quantise(exact)
        assert cells.nbytes * 8 == exact.nbytes
        middle, slack = bounds(queries, low, width, cells)
        assert (np.abs(middle - queries @ exact.T) <= slack[:, None]).all()
        assert np.allclose(slack, np.abs(queries) @ ((width - 1) / 2) + 0.5)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    read, plain = [], vector_search.exact_scores
    monkeypatch.setattr(vector_search, "exact_scores", lambda some, rows, asked: read.append(some.count()) or plain(some, rows, asked))
    asked = F.col("vec_id") % 50 == 0
    queries = df.where(asked).count()
    assert top_k(df, asked).count() == 5 * queries
    assert sum(read) < 0.05 * queries * df.count()


def test_huge_components_lose_no_row(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) * 2.0 ** 21 for x in rng.normal(size=8)], 0, "x", 1) for i in range(300)]
    rows += [(1000 + i, [v + float(rng.integers(-1, 2)) / 256 for v in rows[i % 3][1]], 0, "x", 1) for i in range(200)]
    check(spark.createDataFrame(rows, SCHEMA), 50)
