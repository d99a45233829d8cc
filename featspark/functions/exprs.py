"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: str | Column) -> Column:
    """Double, with NaN as null."""
    d = as_column(c).cast("double")
    return F.when(~F.isnan(d), d)


def signed_log1p(c: str | Column) -> Column:
    """sign(x) * log1p(|x|); nulls stay null."""
    c = as_column(c).cast("double")
    return F.signum(c) * F.log1p(F.abs(c))


def yeo_johnson(c: Column, lam: float) -> Column:
    """The Yeo-Johnson transform for one lambda."""
    up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def bin_code(c: Column, edges: list[float]) -> Column:
    """How many of the edges lie below the value: right-closed bins; null for null."""
    code = F.lit(0)
    for e in edges:
        code = code + F.when(c > e, 1).otherwise(0)
    return F.when(c.isNotNull(), code.cast("int"))


#: Slices of a column's values for ranking.
SLICES = 256


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` without nulls as ranks from 1, ties sharing their mean. Distinct values are counted,
    cut into slices at approximate quantiles and summed inside slices and over them: no task sorts a column."""
    cuts = df.agg(*[F.percentile_approx(c, [k / SLICES for k in range(1, SLICES)], 10_000).alias(c) for c in columns]).first()
    for c in columns:
        splits = [-float("inf"), *sorted(set(cuts[c] or [])), float("inf")]
        counted = df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
        sliced = Bucketizer(splits=splits, inputCol="_v", outputCol="_s").transform(counted) if len(splits) > 2 else counted.withColumn("_s", F.lit(0.0))
        totals = sliced.groupBy("_s").agg(F.sum("_n").alias("_t"))
        before = F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        totals = totals.select(F.col("_s").alias("_s2"), before.alias("_b"))
        inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = sliced.join(F.broadcast(totals), F.col("_s") == F.col("_s2"))  # SLICES rows
        ranks = ranks.select("_v", (F.col("_b") + inside + (F.col("_n") + 1) / F.lit(2.0)).alias("_rank"))
        df = df.join(ranks, F.col(c) == F.col("_v")).withColumn(c, F.col("_rank")).drop("_v", "_rank")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def exact_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of the lowest hash: the same rows for the same data and seed. Only rows whose hash
    lies in the lowest part that must hold them are ordered, and of these each task keeps ``n``."""
    hashed = df.withColumn("_draw", F.xxhash64(F.lit(seed), *df.columns))
    rows = df.count()
    if rows > 100 * n:
        hashed = hashed.where(F.col("_draw") < F.lit(-(1 << 63) + int((1 << 64) * (n + 10 * n ** 0.5 + 100) / rows)))
    out = hashed.orderBy("_draw", *df.columns).limit(n).drop("_draw")
    return out if rows <= 100 * n or out.count() == n else df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def without_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null; NaN stays."""
    for c in columns if columns is not None else df.columns:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df
