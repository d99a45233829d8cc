"""As-of joins, rolling statistics and lags that spread one long series over many tasks.

A series is cut into time buckets, so neither a global series nor a hot key ends up in one task. Rows
that a later bucket must see are copied into it (the halo), or, for as-of joins, only the last
observation of each bucket is carried over, by a window over one row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import Duration
from ..functions.exprs import micros

HOUR = 3_600_000_000
DAY = 24 * HOUR


def asof_backward(left: DataFrame, right: DataFrame, on: Column, right_on: str, values: Sequence[str], into: str,
                  keys: Sequence[str] = (), strict: bool = False, bucket: int = 30 * DAY) -> DataFrame:
    """``left`` with a struct ``into``: the ``values`` and time ``at`` of the latest right row whose
    ``right_on`` is not after ``on`` (``strict``: before it), null if there is none.

    Rows of ``right`` with a null time are ignored; of equal times the one whose values sort last wins. A
    null cutoff matches nothing. Keys compare null-safe.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    key_of = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    lefts = left.select(*key_of, micros(on).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
                        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.lit(None).alias("_seen"))
    seen = F.struct(F.col(right_on).alias("at"), *[F.col(v) for v in values])
    rights = right.where(F.col(right_on).isNotNull()).select(
        *key_of, micros(F.col(right_on)).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).alias("_row"), seen.alias("_seen"))
    lefts = lefts.withColumn("_seen", F.col("_seen").cast(rights.schema["_seen"].dataType))
    rights = rights.withColumn("_row", F.col("_row").cast(lefts.schema["_row"].dataType))
    both = lefts.unionAll(rights).withColumn("_b", F.floor(F.col("_t") / bucket))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = both.groupBy(*names, "_b").agg(F.max(F.when(F.col("_seen").isNotNull(), F.struct("_t", "_seen"))).alias("_last"))
    earlier = buckets.select(*[F.col(n).alias(f"_e{n}") for n in names], F.col("_b").alias("_eb"), F.last("_last", True).over(before)["_seen"].alias("_carry"))
    inside = Window.partitionBy(*names, "_b").orderBy("_t", "_side", "_seen").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_seen", True).over(inside)).where(F.col("_row").isNotNull())
    on_bucket = F.col("_b").eqNullSafe(F.col("_eb"))
    for n in names:
        on_bucket = on_bucket & F.col(n).eqNullSafe(F.col(f"_e{n}"))
    joined = found.join(earlier, on_bucket, "left")
    matched = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_carry"))
    return joined.select(*[F.col("_row")[c].alias(c) for c in left.columns], matched.alias(into))


def with_halo(df: DataFrame, t: str, reach: int, keys: Sequence[str], bucket: int) -> tuple[DataFrame, list[str]]:
    """Rows copied into each bucket that may look back at them; ``_own`` marks the one they belong to."""
    width = max(bucket, reach, 1)
    first = F.floor(F.col(t) / width)
    last = F.floor((F.col(t) + reach) / width)
    spread = df.withColumn("_b", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_b") == F.floor(F.col(t) / width))
    return spread, [*keys, "_b"]


def reach_of(d: Duration) -> int:
    """The longest the duration can be, in microseconds: months of 31 days."""
    return d.micros + d.months * 31 * DAY


STATS = ("mean", "std", "min", "max", "median")


def rolling(series: DataFrame, ts: str, val: str, windows: dict[str, Duration], stats: Sequence[str], keys: Sequence[str] = (), bucket: int = 30 * DAY) -> DataFrame:
    """``series`` keys, ts and ``roll_{stat}_{window}``: statistics over (t - w, t] at each row.

    Least and greatest values of fixed windows take time in proportion to the rows; the others to the rows
    times those of a window.
    """
    if not all(map(reach_of, windows.values())):
        raise ValueError("a window is longer than nothing")
    out = series.select(*keys, ts, val, micros(F.col(ts)).alias("_us")).where("_us is not null")
    ends = [s for s in stats if s in ("min", "max")]
    framed = {name: [s for s in stats if not (w.fixed and s in ends)] for name, w in windows.items()}
    if any(framed.values()):
        out = _framed(out, ts, val, {name: windows[name] for name, of in framed.items() if of}, framed, keys, bucket)
    for name, w in windows.items():
        if ends and w.fixed:
            out = _with_ends(out, val, w.micros, {f"roll_{s}_{name}": s for s in ends}, keys)
    return out.select(*keys, ts, *[f"roll_{s}_{name}" for name in windows for s in stats])


def _framed(df: DataFrame, ts: str, val: str, windows: dict[str, Duration], stats: dict[str, list[str]], keys: Sequence[str], bucket: int) -> DataFrame:
    """``df`` with the statistics of each window over sliding frames."""
    reach = max(reach_of(w) for w in windows.values())
    spread, part = with_halo(df, "_us", reach, keys, bucket)
    own, held, after = [], {}, []
    for i, (name, w) in enumerate(windows.items()):
        if w.fixed:
            over = Window.partitionBy(*part).orderBy("_us").rangeBetween(-(w.micros - 1), 0)
            made = {"mean": F.avg(val), "std": F.stddev_samp(val), "median": F.percentile(val, F.lit(0.5))}
            own += [made[s].over(over).alias(f"roll_{s}_{name}") for s in stats[name]]
        else:  # frames of months are closed on the left: gather the longest, keep what is inside
            spread = spread.withColumn(f"_start{i}", micros(F.col(ts) - w.interval()))
            over = Window.partitionBy(*part).orderBy("_us").rangeBetween(-reach_of(w), 0)
            own += [F.collect_list(F.struct(F.col("_us").alias("t"), F.col(val).alias("v"))).over(over).alias(f"_held{i}"), F.col(f"_start{i}")]
            held[f"_held{i}"] = F.transform(F.filter(f"_held{i}", _after(F.col(f"_start{i}"))), lambda s: s["v"])
            after += [(f"roll_{s}_{name}", s, f"_held{i}") for s in stats[name]]
    out = spread.select(*df.columns, "_own", *own).where("_own").drop("_own")
    out = out.withColumns(held) if held else out
    out = out.withColumns({name: _of_array(s, F.col(c)) for name, s, c in after}) if after else out
    return out.select(*df.columns, *[f"roll_{s}_{name}" for name in windows for s in stats[name]])


def _with_ends(df: DataFrame, val: str, width: int, made: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """``df`` with the least and greatest ``val`` of (t - width, t] at each row.

    Time is cut into blocks of one width, so a window is the end of the block before and the start of the
    row's own. Both are running values, of the block before from its last row back: no frame slides.
    """
    start = F.col("_us") - F.pmod("_us", F.lit(width))
    both = df.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_b", F.when(F.col("_own"), start).otherwise(start + width))
    both = both.withColumn("_from", F.when(F.col("_own"), F.col("_us") - (width - 1)).otherwise(F.col("_us")))
    block = Window.partitionBy(*keys, "_b")
    back = block.orderBy(F.desc("_from")).rangeBetween(Window.unboundedPreceding, 0)
    on = block.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    of = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    ended = both.select("*", *[of[s][0](F.when(~F.col("_own"), F.col(val))).over(back).alias(f"_before_{s}") for s in made.values()]).where("_own")
    return ended.select(*df.columns, *[of[s][1](of[s][0](val).over(on), F.col(f"_before_{s}")).alias(name) for name, s in made.items()])


def _after(start: Column):
    return lambda s: s["t"] > start


def _of_array(stat: str, a: Column) -> Column:
    n = F.size(a)
    if stat in ("min", "max"):
        return F.array_min(a) if stat == "min" else F.array_max(a)
    if stat == "median":
        s = F.array_sort(a)
        return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc, x):  # running mean and squared deviation
        n1 = acc["n"] + 1
        d = x - acc["mean"]
        mean = acc["mean"] + d / n1
        return F.struct(n1.alias("n"), mean.alias("mean"), (acc["m2"] + d * (x - mean)).alias("m2"))

    if stat == "mean":
        return F.aggregate(a, zero, step, lambda acc: F.when(acc["n"] > 0, acc["mean"]))
    return F.aggregate(a, zero, step, lambda acc: F.when(acc["n"] > 1, F.sqrt(acc["m2"] / F.nullif(acc["n"] - 1, F.lit(0.0)))))


def range_lags(df: DataFrame, ts: str, val: str, lags: dict[str, Duration], keys: Sequence[str] = (), bucket: int = 30 * DAY) -> DataFrame:
    """``df`` with, for each lag, the value at exactly ts less the lag, null if no row is there. Times
    are unique; rows with a null time have null lags. One shuffle and one sort serve all lags of up to
    two buckets; longer ones, whose halos would make few and large buckets, are joined by time."""
    far = {name: d for name, d in lags.items() if reach_of(d) > 2 * bucket}
    if far:
        near = {name: d for name, d in lags.items() if name not in far}
        out = range_lags(df, ts, val, near, keys, bucket) if near else df
        return _joined_lags(out, df, ts, val, far, keys).select(*[F.col(f"`{c}`") for c in df.columns], *lags)
    longest = max(map(reach_of, lags.values()))
    known = df.where(F.col(ts).isNotNull())
    spread, part = with_halo(known.withColumn("_us", micros(F.col(ts))), "_us", longest, keys, max(bucket, longest))
    over = ", ".join(f"`{p}`" for p in part)
    made = []
    for name, d in lags.items():
        if d.fixed:
            w = Window.partitionBy(*part).orderBy("_us").rangeBetween(-d.micros, -d.micros)
            made.append(F.first(val).over(w).alias(name))
        else:
            step = f"INTERVAL '{d.months}' MONTH PRECEDING"
            made.append(F.expr(f"first(`{val}`) OVER (PARTITION BY {over} ORDER BY `{ts}` RANGE BETWEEN {step} AND {step})").alias(name))
    out = spread.select(*[F.col(f"`{c}`") for c in df.columns], "_own", *made).where("_own").drop("_own")
    unknown = df.where(F.col(ts).isNull()).select("*", *[F.lit(None).cast(df.schema[val].dataType).alias(name) for name in lags])
    return out.unionByName(unknown)


def _joined_lags(out: DataFrame, df: DataFrame, ts: str, val: str, lags: dict[str, Duration], keys: Sequence[str]) -> DataFrame:
    values = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.first(val).alias("_value"))
    for name, d in lags.items():
        there = values.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_at"), F.col("_value").alias(name))
        on = (F.col(ts) - d.interval()) == F.col("_at")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(there, on, "left").drop("_at", *[f"_k{i}" for i in range(len(keys))])
    return out


#: Half-lives in a block of an exponential mean; what lies two blocks back weighs under 2**-400.
BLOCK_LIVES = 400


def ewm(series: DataFrame, ts: str, val: str, half_lives: dict[str, int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, ts and a column for each name of ``half_lives`` (microseconds): r = a x + (1 - a) r_before with
    a = 1 - 2^(-dt / half-life), from the first value.

    Blocks of time are summed by themselves; the total of the block before enters with its decay. All
    half-lives are columns of one frame, each with blocks of its own length.
    """
    df = series.select(*keys, ts, F.col(val).alias("_x"), micros(F.col(ts)).alias("_us"))
    for name, half_life in half_lives.items():
        df = _with_ewm(df, name, half_life, keys)
    return df.select(*keys, ts, *half_lives)


def _with_ewm(df: DataFrame, name: str, half_life: int, keys: Sequence[str]) -> DataFrame:
    columns = df.columns
    width = BLOCK_LIVES * half_life
    df = df.withColumn("_b", F.floor(F.col("_us") / width))
    part = [*keys, "_b"]
    by_block = Window.partitionBy(*keys).orderBy("_b")
    inside = Window.partitionBy(*part).orderBy("_us")
    ends = df.groupBy(*part).agg(F.max("_us").alias("_end"))
    df = _join(df, ends.select(*part, F.lag("_end").over(by_block).alias("_before")), part)
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(inside), F.col("_before"))
    weight = F.when(gap.isNull(), F.lit(1.0)).otherwise(1 - F.pow(F.lit(2.0), -gap / half_life))
    offset = (F.col("_us") - F.col("_b") * width) / half_life
    df = df.withColumn("_o", offset).withColumn("_w", weight * F.col("_x") * F.pow(F.lit(2.0), offset))
    totals = df.groupBy(*part).agg(F.sum("_w").alias("_sum"))
    adjacent = F.lag("_b").over(by_block) == F.col("_b") - 1
    totals = totals.select(*part, F.when(adjacent, F.lag("_sum").over(by_block)).alias("_total"))
    running = F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    old = F.coalesce(F.col("_total") * F.pow(F.lit(2.0), -(F.col("_o") + BLOCK_LIVES)), F.lit(0.0))
    return _join(df, totals, part).select(*columns, (running * F.pow(F.lit(2.0), -F.col("_o")) + old).alias(name))


def _join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    renamed = table.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(renamed, same).drop(*[f"_r_{c}" for c in on])
