"""The numbers behind charts, as small tables: nothing but aggregates leaves the cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import as_double, average_ranks, bin_code, exact_sample, micros, numeric_columns
from ..functions.quantiles import exact_quantiles, group_quantiles

MISSING = "(null)"


def missing_values(df: DataFrame) -> DataFrame:
    """column, null_pct, fewest first; NaN is not missing here."""
    got = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    rows = sorted(((c, 100.0 * got[f"n{i}"] / got["rows"] if got["rows"] else 0.0) for i, c in enumerate(df.columns)), key=lambda r: (r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "column string, null_pct double")


def correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """a, b, corr for every pair of numeric columns, to two places; null where a column is constant."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        raise ValueError("at least two numeric columns")
    rows = df.select(*[as_double(c).alias(c) for c in names])
    if method == "spearman":
        rows = average_ranks(rows.dropna(), names)
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]

    def corr(a, b):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))

    got = rows.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    out = []
    for i, (a, b) in enumerate(pairs):
        v = None if got[f"c{i}"] is None else round(got[f"c{i}"], 2)
        out += [(a, b, v)] + ([(b, a, v)] if a != b else [])
    return df.sparkSession.createDataFrame(out, "a string, b string, corr double")


def category_counts(df: DataFrame, column: str, top_k: int = 10) -> DataFrame:
    """value, n, share and place: the commonest values, then ``other (m)`` for the m that are left."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(top_k)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long"))
    sums = counts.agg(F.count("*").alias("m"), F.sum("n").alias("rows"))
    merged = ranked.agg(F.collect_list(F.struct("place", "value", "n")).alias("top"), F.sum("n").alias("_k"), F.count("*").alias("_m"))
    one = merged.withColumn("_one", F.lit(1)).join(F.broadcast(sums.withColumn("_one", F.lit(1))), "_one")
    rest = F.struct((F.col("_m") + 1).alias("place"), F.concat(F.lit("other ("), (F.col("m") - F.col("_m")).cast("string"), F.lit(")")).alias("value"), (F.col("rows") - F.col("_k")).alias("n"))
    rows = one.select("rows", F.explode(F.when(F.col("m") > F.col("_m"), F.concat("top", F.array(rest))).otherwise(F.col("top"))).alias("t"))
    return rows.select("t.value", "t.n", (F.col("t.n") / F.col("rows")).alias("share"), "t.place")


def quantile_edges(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Inner edges of bins that hold alike many rows; equal ones merged."""
    got = exact_quantiles(df.select(as_double(column).alias("x")), {"x": [k / n_bins for k in range(1, n_bins)]})
    return sorted({e for e in got["x"] if e is not None})


def feature_target(df: DataFrame, feature: str, target: str, n_bins: int = 10, top_k: int = 10) -> DataFrame:
    """Mean target along a feature: by quantile bin (bin, x median) or by common value (value), with n,
    mean, sem and a 95 % interval; boolean targets count as 0 and 1."""
    y = F.col(target).cast("int").cast("double") if isinstance(df.schema[target].dataType, T.BooleanType) else as_double(target)
    if isinstance(df.schema[feature].dataType, T.NumericType):
        rows = df.select(as_double(feature).alias("x"), y.alias("y")).where("x is not null and y is not null")
        binned = rows.withColumn("bin", bin_code(F.col("x"), quantile_edges(rows, "x", n_bins)))
        middle = group_quantiles(binned, "bin", "x", [0.5]).select("bin", F.col("q")[0].alias("x"))
        return _interval(binned.groupBy("bin").agg(*_mean_and_error()).join(middle, "bin").select("bin", "x", "n", "mean", "sem"))
    rows = df.select(F.coalesce(F.col(feature).cast("string"), F.lit(MISSING)).alias("value"), y.alias("y")).where("y is not null")
    return _interval(rows.groupBy("value").agg(*_mean_and_error()).orderBy(F.desc("n"), "value").limit(top_k))


def _mean_and_error() -> list[Column]:
    return [F.count("*").alias("n"), F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y") / F.sqrt(F.count("*")), F.lit(0.0)).alias("sem")]


def _interval(df: DataFrame) -> DataFrame:
    return df.withColumns({"low": F.col("mean") - 1.96 * F.col("sem"), "high": F.col("mean") + 1.96 * F.col("sem")})


def panel_values(df: DataFrame, column: str, by: str | None = None, log: bool = False, clip: tuple[float, float] | None = None, most_groups: int = 8,
                 sample: int | None = None) -> DataFrame:
    """x and, with ``by``, its group: values that are neither null nor NaN, positive under ``log``, inside
    the ``clip`` quantiles. Null groups go; more than ``most_groups`` are an error. ``sample`` draws that many
    rows first, if there are more."""
    df = exact_sample(df, sample) if sample is not None else df
    rows = df.select(as_double(column).alias("x"), *([F.col(by).cast("string").alias("group")] if by else [])).where("x is not null")
    if by:
        rows = rows.where("group is not null")
        if rows.select("group").distinct().limit(most_groups + 1).count() > most_groups:
            raise ValueError(f"{by} has more than {most_groups} groups")
    if log:
        rows = rows.where("x > 0")
    if clip:
        low, high = exact_quantiles(rows, {"x": clip})["x"]
        rows = rows.where(F.col("x").between(low, high)) if low is not None else rows
    return rows


def histogram(df: DataFrame, column: str, bins: int | str = "auto", by: str | None = None, log: bool = False, clip: tuple[float, float] | None = None, few: int = 50, sample: int | None = None) -> DataFrame:
    """[group,] low, high, n, share. Whole numbers of up to ``few`` values get a bar each; ``auto`` takes
    the narrower of the Freedman-Diaconis and Sturges bins; groups are normalised by themselves."""
    rows = panel_values(df, column, by, log, clip, sample=sample)
    keys = ["group"] if by else []
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    if whole and bins == "auto" and rows.select("x").distinct().limit(few + 1).count() <= few:
        n = rows.groupBy(*keys, F.col("x").alias("low")).agg(F.count("*").alias("n")).withColumn("high", F.col("low"))
    else:
        x = F.log10("x") if log else F.col("x")
        got = rows.agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).first()
        k = bins if isinstance(bins, int) else auto_bins(got["n"], got["a"], got["b"], *exact_quantiles(rows.select(x.alias("x")), {"x": [0.25, 0.75]})["x"])
        a, b = got["a"] or 0.0, got["b"] or 0.0
        w = (b - a) / k if b > a else 1.0
        place = F.least(F.floor((x - a) / w), F.lit(k - 1))
        n = rows.groupBy(*keys, place.alias("_i")).agg(F.count("*").alias("n"))
        edge = lambda i: F.pow(F.lit(10.0), i * w + a) if log else i * w + a
        n = n.select(*keys, "n", edge(F.col("_i")).alias("low"), edge(F.col("_i") + 1).alias("high"))
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return n.select(*keys, "low", "high", "n", (F.col("n") / total).alias("share"))


def auto_bins(n: int, low: float | None, high: float | None, q25: float | None, q75: float | None) -> int:
    """Number of bins from count, range and quartiles."""
    if not n or low is None or high <= low:
        return 1
    sturges = (high - low) / (math.log2(n) + 1)
    fd = 2 * (q75 - q25) / n ** (1 / 3)
    return max(1, math.ceil((high - low) / (min(sturges, fd) if fd > 0 else sturges)))


def kde(df: DataFrame, column: str, by: str | None = None, log: bool = False, clip: tuple[float, float] | None = None, points: int = 200, cells: int | None = 2000, sample: int | None = None) -> DataFrame:
    """[group,] x, density: a Gaussian kernel estimate with Scott's bandwidth, inside the data's range.
    Rows are first counted in ``cells`` cells a group, so the estimate costs cells times points; without
    cells each distinct value meets each point in the task that holds it, and sums are exact."""
    rows = panel_values(df, column, by, log, clip, sample=sample)
    rows = rows.withColumn("x", F.log10("x")) if log else rows
    rows = rows if by else rows.withColumn("group", F.lit(""))
    stats = {r["group"]: r for r in rows.groupBy("group").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.stddev_samp("x").alias("s")).collect()}
    out = []
    usable = {g: r for g, r in stats.items() if r["n"] > 1 and r["s"] and r["s"] > 0}
    if usable and cells is None:
        h = F.create_map(*[v for g, r in usable.items() for v in (F.lit(g), F.lit(r["s"] * r["n"] ** -0.2))])[F.col("group")]
        ends = [F.create_map(*[v for g, r in usable.items() for v in (F.lit(g), F.lit(float(r[k])))])[F.col("group")] for k in ("a", "b")]
        grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: ends[0] + (ends[1] - ends[0]) * k / (points - 1))
        counted = rows.where(F.col("group").isin(*usable)).groupBy("group", F.col("x").alias("v")).agg(F.count("*").alias("n"))
        near = counted.select("group", "v", "n", h.alias("h"), F.posexplode(grid).alias("k", "x"))
        sums = near.groupBy("group", "k", "x", "h").agg(F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2))).alias("t")).collect()  # a row a point
        out = [(r["group"], 10 ** r["x"] if log else r["x"], r["t"] / (usable[r["group"]]["n"] * r["h"] * math.sqrt(2 * math.pi))) for r in sorted(sums, key=lambda r: (r["group"], r["k"]))]
    elif usable:
        parts = {k: F.create_map(*[v for g, r in usable.items() for v in (F.lit(g), F.lit(float(r[k])))])[F.col("group")] for k in ("a", "b")}
        place = F.least(F.floor((F.col("x") - parts["a"]) / (parts["b"] - parts["a"]) * cells), F.lit(cells - 1))
        counted = rows.where(F.col("group").isin(*usable)).groupBy("group", place.alias("i")).agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()
        for g, r in sorted(usable.items()):
            h = r["s"] * r["n"] ** -0.2
            held = [(c["m"], c["n"]) for c in counted if c["group"] == g]
            for k in range(points):
                at = r["a"] + (r["b"] - r["a"]) * k / (points - 1)
                total = sum(n * math.exp(-0.5 * ((at - m) / h) ** 2) for m, n in held)
                out.append((g, 10 ** at if log else at, total / (r["n"] * h * math.sqrt(2 * math.pi))))
    table = df.sparkSession.createDataFrame(out, "group string, x double, density double")
    return table if by else table.drop("group")


def boxplot(df: DataFrame, column: str, by: str | None = None, log: bool = False, clip: tuple[float, float] | None = None) -> DataFrame:
    """[group,] n, q1, median, q3, whiskers inside 1.5 quartile ranges, number of values beyond."""
    rows = panel_values(df, column, by, log, clip).withColumn("_g", F.col("group") if by else F.lit(""))
    q = group_quantiles(rows, "_g", "x", [0.25, 0.5, 0.75]).select("_g", "q")  # some groups
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    near = F.col("x").between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    out = rows.join(F.broadcast(q), "_g").groupBy("_g", "q").agg(F.count("*").alias("n"), F.min(F.when(near, F.col("x"))).alias("low"), F.max(F.when(near, F.col("x"))).alias("high"), F.count_if(~near).alias("fliers"))
    return out.select(*([F.col("_g").alias("group")] if by else []), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high", "fliers")


def violin(df: DataFrame, column: str, by: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Density and box of each group."""
    return kde(df, column, by, **options), boxplot(df, column, by, **options)


def _steps(df: DataFrame, ts: str, slices: str = "month") -> DataFrame:
    """Distinct times with the one before; months are taken apart, each given the last time before it."""
    times = df.select(F.col(ts).alias("ts")).where("ts is not null").distinct().withColumn("_m", F.date_trunc(slices, F.col("ts")))
    ends = times.groupBy("_m").agg(F.max("ts").alias("_end"))
    ends = ends.select(F.col("_m").alias("_m2"), F.lag("_end").over(Window.orderBy("_m")).alias("_before"))
    inside = Window.partitionBy("_m").orderBy("ts")
    joined = times.join(ends, times["_m"] == ends["_m2"])
    return joined.select("ts", F.coalesce(F.lag("ts").over(inside), F.col("_before")).alias("before"))


def infer_interval(df: DataFrame, ts: str = "ts") -> int:
    """The commonest positive step between times in microseconds, the smallest of equals."""
    steps = _steps(df, ts).where("before is not null").groupBy((micros(F.col("ts")) - micros(F.col("before"))).alias("step")).count()
    row = steps.orderBy(F.desc("count"), "step").limit(1).collect()
    if not row:
        raise ValueError("at least two distinct times")
    return row[0]["step"]


def default_period(step: int) -> int:
    """Steps in the natural season of a step in microseconds."""
    day = 86_400_000_000
    for limit, period in ((day // 2, day // max(step, 1)), (day, 7), (7 * day, 52), (31 * day, 12), (92 * day, 4)):
        if step <= limit:
            return max(2, period)
    raise ValueError("steps longer than a quarter have no season")


def gaps(df: DataFrame, ts: str = "ts", interval: int | None = None) -> DataFrame:
    """start, ts, missing: where a step is longer than ``interval`` (microseconds; the commonest step)."""
    step = interval or infer_interval(df, ts)
    wide = (micros(F.col("ts")) - micros(F.col("before"))) / F.lit(step)
    return _steps(df, ts).where(wide > 1).select(F.col("before").alias("start"), "ts", (F.round(wide) - 1).cast("long").alias("missing"))


def gap_totals(df: DataFrame, ts: str = "ts", interval: int | None = None) -> DataFrame:
    """One row: duplicates, gaps, missing steps and their share of the steps expected."""
    step = interval or infer_interval(df, ts)
    times = df.where(F.col(ts).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(ts).alias("u"), F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    g = gaps(df, ts, step).agg(F.count("*").alias("gaps"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    expected = round((times["b"] - times["a"]).total_seconds() * 1e6 / step) + 1
    return g.select(F.lit(times["n"] - times["u"]).alias("duplicates"), "gaps", "missing", (F.col("missing") / F.lit(float(expected))).alias("share"))


SEASONS = {"hour": F.hour, "weekday": lambda t: F.weekday(t) + 1, "day": F.day, "week": F.weekofyear, "month": F.month, "quarter": F.quarter, "year": F.year}


def seasonal_profile(df: DataFrame, rows: str, columns: str | None = None, agg: str = "mean", ts: str = "ts", val: str = "val") -> DataFrame:
    """With ``columns`` a pivot of mean or median by two calendar parts; without, mean or median with the
    band of the values nearest to the quartiles by one."""
    made = {"mean": F.avg, "median": F.median}[agg]
    cells = df.select(SEASONS[rows](F.col(ts)).alias(rows), *([SEASONS[columns](F.col(ts)).alias(columns)] if columns else []), as_double(val).alias("v")).where(f"v is not null and {rows} is not null")
    if columns:
        return cells.groupBy(rows).pivot(columns).agg(made("v"))
    band = group_quantiles(cells, rows, "v", [0.25, 0.75], nearest=True).select(rows, F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"))
    center = cells.groupBy(rows).agg(F.avg("v").alias("center")) if agg == "mean" else group_quantiles(cells, rows, "v", [0.5]).select(rows, F.col("q")[0].alias("center"))
    return center.join(band, rows)


#: Slices of time for numbering rows.
TIME_SLICES = 1024


def numbered_rows(rows: DataFrame, ts: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their number from 1 by ``ts`` in each series: places inside slices of time, cut at
    approximate quantiles, after the rows of the slices before. Null times are left out."""
    known = rows.where(F.col(ts).isNotNull()).withColumn("_at", micros(F.col(ts)).cast("double"))
    cuts = known.agg(F.percentile_approx("_at", [k / TIME_SLICES for k in range(1, TIME_SLICES)], 10_000)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="_at", outputCol="_s").transform(known) if len(splits) > 2 else known.withColumn("_s", F.lit(0.0))
    per = sliced.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    placed = sliced.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(ts)))
    return placed.join(per.select(*keys, "_s", before), [*keys, "_s"]).withColumn(name, F.col("_place") + F.col("_base")).drop("_at", "_s", "_base", "_place")


def autocorrelation(df: DataFrame, lags: int = 50, ts: str = "ts", val: str = "val", keys: Sequence[str] = ()) -> DataFrame:
    """[keys,] lag, acf, band: correlation with the values ``lag`` rows before, and Bartlett's 95 % band.
    Rows are numbered by time through counts by slice, and blocks of rows see what lies before them."""
    rows = df.select(*keys, F.col(ts).alias("t"), as_double(val).alias("v")).where("v is not null")
    numbered = numbered_rows(rows, "t", "i", keys)
    stats = rows.groupBy(*keys).agg(F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("ss"), F.count("*").alias("n"))
    # a row a series: Spark broadcasts them if they are few
    spread = numbered.join(stats, list(keys)) if keys else numbered.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
    d = spread.select(*keys, "i", (F.col("v") - F.col("mean")).alias("d"), "ss", "n")
    # a block of rows sees itself and the rows that its longest lag reaches back to
    width = max(1024, 4 * lags)
    halo = d.withColumn("_b", F.explode(F.sequence(F.floor(F.col("i") / width), F.floor((F.col("i") + lags) / width))))
    w = Window.partitionBy(*keys, "_b").orderBy("i")
    shifted = halo.select(*keys, "ss", "n", (F.col("_b") == F.floor(F.col("i") / width)).alias("own"), "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = shifted.where("own").groupBy(*keys, "ss", "n").agg(*[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    table = sums.select(*keys, "n", F.posexplode(F.array(F.lit(1.0), *[F.when(F.col("ss") > 0, F.coalesce(f"s{k}", F.lit(0.0)) / F.nullif(F.col("ss"), F.lit(0.0))) for k in range(1, lags + 1)])).alias("lag", "acf")).where("lag < n")
    earlier = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(0.0)).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return table.select(*keys, "lag", "acf", F.when(F.col("lag") > 0, 1.959963984540054 * F.sqrt((1 + 2 * earlier) / F.col("n"))).otherwise(0.0).alias("band"))


def partial_autocorrelation(df: DataFrame, lags: int = 50, ts: str = "ts", val: str = "val") -> list[float]:
    """Partial autocorrelations from lag 0, by Yule-Walker (Levinson-Durbin) on the biased autocorrelations."""
    n = df.where(as_double(val).isNotNull()).count()
    lags = min(lags, n // 2 - 1)
    if lags < 1:
        raise ValueError("too few values")
    acf = [r["acf"] for r in autocorrelation(df, lags, ts, val).orderBy("lag").collect()]
    return levinson_durbin(acf)


def levinson_durbin(acf: Sequence[float]) -> list[float]:
    """Partial correlations of the autocorrelations from lag 0."""
    out, phi, left = [1.0], [], 1.0
    for k in range(1, len(acf)):
        new = (acf[k] - sum(p * acf[k - 1 - j] for j, p in enumerate(phi))) / left if left else 0.0
        phi = [p - new * phi[k - 2 - j] for j, p in enumerate(phi)] + [new]
        left *= 1 - new * new
        out.append(new)
    return out


def resample(df: DataFrame, step: int | None = None, ts: str = "ts", val: str = "val") -> DataFrame:
    """ts, val, filled: duplicates averaged, a regular grid of ``step`` microseconds, gaps interpolated
    between the known values around them. Each gap fills itself, so long series need no single sort."""
    step = step or infer_interval(df, ts)
    mean = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("ts")).agg(F.avg(as_double(val)).alias("val")).where("val is not null")
    first = mean.agg(F.min(micros(F.col("ts")))).first()[0]
    if first is None:
        return mean.withColumn("filled", F.lit(False))
    on_grid = (micros(F.col("ts")) - first) % step == 0
    known = mean.withColumn("_on", on_grid).where("_on").drop("_on")
    pairs = _steps(known, "ts").join(known, "ts").join(known.select(F.col("ts").alias("before"), F.col("val").alias("_v0")), "before", "left")
    a, b = micros(F.col("before")), micros(F.col("ts"))
    n = F.coalesce((b - a) / step, F.lit(1)).cast("long")
    k = pairs.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    at = F.timestamp_micros(micros(F.col("ts")) - (F.col("_n") - F.col("_k")) * step).cast("timestamp_ntz")
    value = F.when(F.col("_k") == F.col("_n"), F.col("val")).otherwise(F.col("_v0") + (F.col("val") - F.col("_v0")) * F.col("_k") / F.col("_n"))
    return k.select(at.alias("ts"), value.alias("val"), (F.col("_k") < F.col("_n")).alias("filled"))


def rolling_stats(df: DataFrame, window: int | str, ts: str = "ts", val: str = "val", keys: Sequence[str] = ()) -> DataFrame:
    """[keys,] ts, mean, std over the last rows (int) or time (duration), null until a full window has
    passed. Rows are numbered and taken in blocks that see what their windows reach back to; rows without
    a time are left out of windows of rows."""
    from ..functions.durations import parse_duration
    from .windows import rolling

    rows = df.select(*keys, F.col(ts).alias("ts"), as_double(val).alias("val"))
    if isinstance(window, int):
        width = max(1024, 4 * window)
        blocks = numbered_rows(rows, "ts", "_i", keys).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_i") / width), F.floor((F.col("_i") + window - 1) / width))))
        w = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(-(window - 1), 0)
        full = F.col("_i") >= window
        made = blocks.select(*keys, "ts", (F.col("_b") == F.floor(F.col("_i") / width)).alias("_own"), F.when(full, F.avg("val").over(w)).alias("mean"), F.when(full, F.stddev_samp("val").over(w)).alias("std"))
        return made.where("_own").drop("_own")
    d = parse_duration(window)
    made = rolling(rows, "ts", "val", {window: d}, ("mean", "std"), keys)
    start = rows.groupBy(*keys).agg(F.min("ts").alias("_first"))
    made = made.join(start, list(keys)) if keys else made.withColumn("_one", F.lit(1)).join(F.broadcast(start.withColumn("_one", F.lit(1))), "_one")
    full = F.col("ts") >= F.col("_first") + d.interval()
    return made.select(*keys, "ts", *[F.when(full, F.col(f"roll_{s}_{window}")).alias(s) for s in ("mean", "std")])


def calibration(df: DataFrame, y: str = "y_true", score: str = "y_proba", n_bins: int = 10) -> DataFrame:
    """bin, n, predicted, observed: mean probability and rate of quantile bins."""
    edges = quantile_edges(df, score, n_bins)
    return df.groupBy(bin_code(as_double(score), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def probability_histogram(df: DataFrame, score: str = "y_proba", bins: int = 20) -> DataFrame:
    """bin from 0, n over equal parts of [0, 1]."""
    return df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def residual_bins(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """bin, n, predicted, residual by quantile bins of the prediction, one for each 25 rows up to 20."""
    n_bins = max(1, min(20, df.count() // 25))
    return df.groupBy(bin_code(as_double(p), quantile_edges(df, p, n_bins)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y) - F.col(p)).alias("residual"))


def residual_summary(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One row: mean and population deviation of the residual."""
    return df.agg(F.avg(F.col(y) - F.col(p)).alias("mean"), F.stddev_pop(F.col(y) - F.col(p)).alias("std"))


def forecast_breaks(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts, starts: whether a line over time breaks before the point, its step being over twice the median."""
    steps = _steps(df, ts).withColumn("_s", micros(F.col("ts")) - micros(F.col("before")))
    middle = exact_quantiles(steps.select(F.col("_s").cast("double").alias("s")), {"s": [0.5]})["s"][0]
    return steps.select("ts", F.coalesce(F.col("_s") > 2 * F.lit(middle), F.lit(False)).alias("starts"))


def feature_importance(importance: dict[str, float], top_k: int = 10) -> list[tuple[str, float]]:
    """Shares of the total, largest first; the rest as ``other (m)``. No importance at all is an error."""
    total = sum(importance.values())
    if not total > 0:
        raise ValueError("the model has no splits")
    ranked = sorted(((v / total, k) for k, v in importance.items() if v > 0), key=lambda r: (-r[0], r[1]))
    out = [(k, v) for v, k in ranked[:top_k]]
    return out + [(f"other ({len(ranked) - top_k})", sum(v for v, _ in ranked[top_k:]))] if len(ranked) > top_k else out


def timeseries_grid(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts, column, value of all numeric columns, in order of time."""
    names = [c for c in numeric_columns(df) if c != ts]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in names]))
    return df.select(F.col(ts).alias("ts"), pairs.alias("p")).select("ts", "p.column", "p.value").orderBy("ts", "column")
