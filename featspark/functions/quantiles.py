"""Exact quantiles of columns of any size.

Small tables use the built-in exact percentile, which holds all distinct values in one task. Larger
ones bracket each quantile by an approximate percentile, count what lies below the bracket, split it
until few rows are left, and take the exact value among those. Memory stays bounded, results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which the built-in is used, rows left in a bracket when it ends, and parts of a split.
SMALL, LEFT, PARTS = 5_000_000, 1_000_000, 512


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], small: int = SMALL, left: int = LEFT) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of double columns, nulls left out; None for columns without values."""
    if not wanted:
        return {}
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(wanted)}
    out: dict[str, list[float | None]] = {c: [None] * len(q) for c, q in wanted.items()}
    direct = [c for c in wanted if 0 < sizes[c] <= small and wanted[c]]
    if direct:
        got = df.agg(*[F.percentile(F.col(f"`{c}`"), F.array(*map(F.lit, map(float, wanted[c])))).alias(f"q{i}") for i, c in enumerate(direct)]).first()
        out |= {c: list(got[f"q{i}"]) for i, c in enumerate(direct)}
    for c in wanted:
        if sizes[c] > small:
            values = df.select(F.col(f"`{c}`").alias("x")).where("x is not null")
            out[c] = [_refined(values, sizes[c], q, left) for q in map(float, wanted[c])]
    return out


def group_quantiles(df: DataFrame, key: str, column: str, quantiles: Sequence[float], nearest: bool = False, small: int = SMALL, most: int = 1000) -> DataFrame:
    """key, q (array of the quantiles) and n of each group of ``key``; values that are null are left out.
    ``nearest`` takes the value at the nearest place, half up, in place of interpolating.

    Groups of more than ``small`` rows go through ``exact_quantiles`` one after another; over ``most`` groups
    are an error, as the driver lists them.
    """
    rows = df.where(F.col(column).isNotNull())
    counts = {r["k"]: r["n"] for r in rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"{key} has more than {most} groups")

    def places(n: int) -> list[float]:
        return [min(1.0, math.floor((n - 1) * q + 0.5) / (n - 1)) if nearest and n > 1 else float(q) for q in quantiles]

    found = [(k, exact_quantiles(rows.where(F.col(key).eqNullSafe(F.lit(k))), {column: places(n)})[column], n) for k, n in counts.items() if n > small]
    usual = {k: n for k, n in counts.items() if n <= small}
    if nearest and usual:
        made = [F.percentile(F.when(F.col(key).eqNullSafe(F.lit(k)), F.col(column)), F.array(*map(F.lit, places(n)))).alias(f"g{i}") for i, (k, n) in enumerate(usual.items())]
        got = rows.agg(*made).first()
        found += [(k, list(got[f"g{i}"]), n) for i, (k, n) in enumerate(usual.items())]
        usual = {}
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    table = df.sparkSession.createDataFrame(found, schema)
    if usual:
        large = F.lit(False)
        for k, _, _ in found:
            large = large | F.col(key).eqNullSafe(F.lit(k))
        direct = rows.where(~large).groupBy(key).agg(F.percentile(column, F.array(*map(F.lit, map(float, quantiles)))).alias("q"), F.count("*").alias("n"))
        table = direct.unionByName(table) if found else direct
    return table


def _refined(values: DataFrame, n: int, q: float, left: int) -> float:
    place = q * (n - 1)
    first, last = math.floor(place), math.ceil(place)
    margin = 1 / 2000
    got = values.agg(F.min("x"), F.max("x"), F.percentile_approx("x", [max(0.0, q - margin), min(1.0, q + margin)], 10_000)).first()
    low, high = max(got[0], got[2][0]), min(got[1], got[2][1])
    below, inside = _counted(values, low, high)
    if not (below <= first and last < below + inside):
        low, high, below, inside = got[0], got[1], 0, n
    while inside > left and high > low:
        width = (high - low) / PARTS
        part = F.least(F.floor((F.col("x") - low) / width), F.lit(PARTS - 1)) if width > 0 else F.lit(0)
        held = values.where(F.col("x").between(low, high)).groupBy(part.alias("k")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("k").collect()
        at, keep, start = below, [], None
        for r in held:
            if at + r["n"] > first and at <= last:
                start = at if start is None else start
                keep.append(r)
            at += r["n"]
        new = (keep[0]["a"], keep[-1]["b"], start, sum(r["n"] for r in keep))
        if new[3] == inside:
            break  # the values are too close together to split further by width
        low, high, below, inside = new
    if high == low:
        return float(low)
    share = (place - below) / (inside - 1) if inside > 1 else 0.0
    return values.where(F.col("x").between(low, high)).agg(F.percentile("x", F.lit(min(1.0, max(0.0, share))))).first()[0]


def _counted(values: DataFrame, low: float, high: float) -> tuple[int, int]:
    r = values.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
    return r[0], r[1]
