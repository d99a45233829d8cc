"""Column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import as_double
from ..functions.quantiles import exact_quantiles

SCHEMA = ("column string, dtype string, count long, null_pct double, n_unique long, mean double, std double, min double, p25 double, "
          "median double, p75 double, max double, skew double, zeros_pct double")
#: Columns profiled in one job: wide aggregates outgrow compiled code.
AT_ONCE = 25


def summarize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row a column: type, non-null count, share of nulls, distinct values (null is one), and for
    numbers statistics over values that are neither null nor NaN."""
    names = list(columns if columns is not None else df.columns)
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    rows = []
    for i in range(0, len(names), AT_ONCE):
        part = names[i:i + AT_ONCE]
        made = [F.count("*").alias("rows")]
        for k, c in enumerate(part):
            col = F.col(f"`{c}`")
            made += [F.count(col).alias(f"n{k}")]
            if isinstance(df.schema[c].dataType, T.NumericType):
                x = as_double(col)
                made += [F.avg(x).alias(f"mean{k}"), F.stddev_samp(x).alias(f"std{k}"), F.skewness(x).alias(f"skew{k}"), F.min(x).alias(f"min{k}"), F.max(x).alias(f"max{k}"), F.count(x).alias(f"c{k}"), F.count_if(x == 0).alias(f"z{k}")]
        got = df.agg(*made).first()
        numbers = [c for c in part if isinstance(df.schema[c].dataType, T.NumericType)]
        middle = exact_quantiles(df.select(*[as_double(F.col(f"`{c}`")).alias(c) for c in numbers]), {c: (0.25, 0.5, 0.75) for c in numbers})
        # each count reads one column and keeps one set; several in one aggregate would copy every row for each
        each = [df.select(F.col(f"`{c}`").alias("v")).distinct().agg(F.count("*").alias("u")).select(F.lit(c).alias("c"), "u") for c in part]
        distinct = {r["c"]: r["u"] for r in reduce(DataFrame.unionAll, each).collect()}
        for k, c in enumerate(part):
            kind = df.schema[c].dataType
            total, n = got["rows"], got[f"n{k}"]
            row = [c, kind.simpleString(), n, 100.0 * (total - n) / total if total else 0.0, distinct[c]]
            if isinstance(kind, T.NumericType):
                q = middle[c]
                zeros = 100.0 * got[f"z{k}"] / got[f"c{k}"] if got[f"c{k}"] else None
                row += [got[f"mean{k}"], got[f"std{k}"], got[f"min{k}"], q[0], q[1], q[2], got[f"max{k}"], got[f"skew{k}"], zeros]
            else:
                row += [None] * 9
            rows.append(tuple(row))
    return df.sparkSession.createDataFrame(rows, SCHEMA)
