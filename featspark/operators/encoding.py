"""Fit/apply encoders of categories: codes, one-hot, quantile bins, target rates, frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, bin_code
from ..functions.quantiles import exact_quantiles

#: Up to this many categories a lookup is a literal map; larger tables are joined.
LITERAL = 1000
#: Most categories that become codes or columns: the driver lists them.
MOST_CATEGORIES = 100_000


def _text(c: str) -> Column:
    return F.col(c).cast("string")


class EncodingFeatures:
    """Categories, bin edges and rates learned on one table and applied alike to any."""

    def __init__(self):
        self.categories: dict[str, list[str]] = {}
        self.onehot: dict[str, list[str]] = {}
        self.edges: dict[str, list[float]] = {}
        self.shares: dict[str, DataFrame] = {}
        self.rates: dict[str, DataFrame] = {}
        self.priors: dict[str, float] = {}
        self.target: str | None = None
        self.classes: list[str] = []
        self.smoothing = 10.0
        self._null_share: dict[str, float] = {}
        self._sizes: dict[str, int] = {}

    def fit(self, df: DataFrame, *, to_enum: Sequence[str] = (), to_onehot: Sequence[str] = (), to_bin: dict[str, int | Sequence[float]] | None = None,
            target_encode: Sequence[str] = (), frequency_encode: Sequence[str] = (), target: str | None = None, smoothing: float = 10.0) -> EncodingFeatures:
        """Learn what is asked for. ``to_bin`` maps a column to a number of bins or to quantiles."""
        if target_encode and target is None:
            raise ValueError("target_encode needs target")
        self.target, self.smoothing = target, smoothing
        wanted = dict.fromkeys([*to_enum, *to_onehot])
        if wanted:
            pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.when(_known(df, c), _text(c)).alias("v")) for c in wanted])).alias("p"))
            found = pairs.select("p.c", "p.v").where("v is not null").distinct().limit(MOST_CATEGORIES + 1).collect()
            if len(found) > MOST_CATEGORIES:
                raise ValueError(f"more than {MOST_CATEGORIES} categories: use frequency or target rates")
            got = {c: sorted((r["v"] for r in found if r["c"] == c), key=str.encode) for c in wanted}
            self.categories = {c: got[c] for c in to_enum}
            self.onehot = {c: got[c] for c in to_onehot}
        if to_bin:
            self.edges = self._learn_edges(df, to_bin)
        if target_encode:
            self._learn_rates(df, target_encode)
        if frequency_encode:
            total = df.count()
            for c in frequency_encode:
                counted = df.groupBy(_text(c).alias("_cat")).agg((F.count("*") / F.lit(float(max(total, 1)))).alias("_share"))
                self.shares[c] = counted
        return self

    def _learn_edges(self, df: DataFrame, to_bin) -> dict[str, list[float]]:
        quantiles = {}
        for c, n in to_bin.items():
            if isinstance(n, int):
                if n < 2:
                    raise ValueError("at least two bins")
                quantiles[c] = [k / n for k in range(1, n)]
            else:
                quantiles[c] = [float(q) for q in n]
            if any(not 0 <= q <= 1 for q in quantiles[c]):
                raise ValueError("quantiles are between 0 and 1")
        got = exact_quantiles(df.select(*[as_double(c).alias(c) for c in quantiles]), quantiles)
        return {c: sorted({e for e in got[c] if e is not None}) for c in quantiles}

    def _learn_rates(self, df: DataFrame, columns: Sequence[str]) -> None:
        label = _text(self.target)
        self.classes = [r[0] for r in df.where(_known(df, self.target)).select(label).distinct().orderBy(F.col(df.select(label).columns[0])).collect()]
        if len(self.classes) < 2:
            raise ValueError("the target needs two classes")
        if df.schema[self.target].dataType.typeName() in ("integer", "long", "short", "byte", "double", "float"):
            self.classes.sort(key=float)
        labelled = df.where(_known(df, self.target))
        self.priors = labelled.agg(*[F.avg((label == k).cast("double")).alias(f"p{i}") for i, k in enumerate(self.encoded())]).first().asDict()
        for c in columns:
            counts = labelled.where(_known(df, c)).groupBy(_text(c).alias("_cat")).agg(
                F.count("*").alias("_n"), *[F.sum((label == k).cast("double")).alias(f"_h{i}") for i, k in enumerate(self.encoded())])
            rate = [((F.col(f"_h{i}") + self.smoothing * self.priors[f"p{i}"]) / (F.col("_n") + self.smoothing)).alias(f"_r{i}") for i in range(len(self.encoded()))]
            self.rates[c] = counts.select("_cat", *rate)

    def encoded(self) -> list[str]:
        """Classes with a column: the second of two, or all of more."""
        return self.classes[1:] if len(self.classes) == 2 else self.classes

    def _rate_name(self, c: str, k: str) -> str:
        return f"{c}_te" if len(self.classes) == 2 else f"{c}_te_{k}"

    def categorical_to_enum(self, df: DataFrame) -> DataFrame:
        """Place of each value among the sorted training categories; an unseen value fails the job."""
        made = {}
        for c, names in self.categories.items():
            codes = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.create_map().cast("map<string,int>")
            code = F.element_at(codes, _text(c))
            unseen = F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), _text(c))).cast("int")
            made[c] = F.when(~_known(df, c), F.lit(None)).when(code.isNull(), unseen).otherwise(code).cast("int")
        return df.withColumns(made)

    def categorical_to_onehot(self, df: DataFrame) -> DataFrame:
        """``{col}_{category}`` 0 or 1 for each training category; the column itself goes."""
        made = {f"{c}_{n}": F.coalesce(_text(c) == n, F.lit(False)).cast("int") for c, names in self.onehot.items() for n in names}
        return df.withColumns(made).drop(*self.onehot)

    def numeric_to_bin(self, df: DataFrame) -> DataFrame:
        """Place of the right-closed interval between the learned edges."""
        return df.withColumns({c: bin_code(as_double(c), e) for c, e in self.edges.items()})

    def target_encode(self, df: DataFrame, folds: int | None = None, seed: int = 0, fold_by: str | Sequence[str] | None = None) -> DataFrame:
        """Smoothed rate of each class. With ``folds`` the rows are training rows and each one's rate
        comes from the other folds; a row's fold is its hash (of the columns ``fold_by``, all by
        default), or the column ``fold_by`` itself, from 0, if that is a name. Unseen and null values get the prior."""
        if not self.rates:
            raise RuntimeError("fit with target_encode comes first")
        if folds is not None:
            return self._out_of_fold(df, folds, seed, fold_by)
        for c, table in self.rates.items():
            table = table.withColumnRenamed("_cat", f"_cat_{c}")
            key = F.when(_known(df, c), _text(c))
            joined = df.join(table, key == F.col(f"_cat_{c}"), "left")
            made = {self._rate_name(c, k): F.coalesce(F.col(f"_r{i}"), F.lit(self.priors[f"p{i}"])) for i, k in enumerate(self.encoded())}
            df = joined.withColumns(made).drop(f"_cat_{c}", *[f"_r{i}" for i in range(len(self.encoded()))])
        return df

    def _out_of_fold(self, df: DataFrame, folds: int, seed: int, fold_by) -> DataFrame:
        if folds < 2:
            raise ValueError("at least two folds")
        columns = df.columns
        by_hash = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in fold_by or columns]), F.lit(folds))
        rows = df.withColumn("_fold", F.col(fold_by).cast("long") if isinstance(fold_by, str) else by_hash)
        label = _text(self.target)
        seen = rows.where(_known(df, self.target))
        hits = [F.sum((label == k).cast("double")).alias(f"_h{i}") for i, k in enumerate(self.encoded())]
        by_fold = seen.groupBy("_fold").agg(F.count("*").alias("_n"), *hits).collect()
        n = sum(r["_n"] for r in by_fold)
        priors = {}
        for f in range(folds):
            mine = next((r for r in by_fold if r["_fold"] == f), None)
            left = n - (mine["_n"] if mine else 0)
            priors[f] = [(sum(r[f"_h{i}"] for r in by_fold) - (mine[f"_h{i}"] if mine else 0)) / left if left else None for i in range(len(self.encoded()))]
        prior_map = [F.element_at(F.create_map(*[x for f, p in priors.items() for x in (F.lit(f).cast("long"), F.lit(p[i]).cast("double"))]), F.col("_fold"))
                     for i in range(len(self.encoded()))]
        out = rows
        for c in self.rates:
            cell = seen.where(_known(df, c)).groupBy(_text(c).alias("_cat"), F.col("_fold").alias("_cf")).agg(F.count("*").alias("_n"), *hits)
            whole = cell.groupBy("_cat").agg(F.sum("_n").alias("_tn"), *[F.sum(f"_h{i}").alias(f"_t{i}") for i in range(len(self.encoded()))])
            key = F.when(_known(df, c), _text(c))
            out = out.join(whole, key == F.col("_cat"), "left").drop("_cat")
            out = out.join(cell, (key == F.col("_cat")) & (F.col("_fold") == F.col("_cf")), "left")
            count = F.coalesce("_tn", F.lit(0)) - F.coalesce("_n", F.lit(0))
            made = {}
            for i, k in enumerate(self.encoded()):
                hit = F.coalesce(f"_t{i}", F.lit(0.0)) - F.coalesce(f"_h{i}", F.lit(0.0))
                made[self._rate_name(c, k)] = F.try_divide(hit + self.smoothing * prior_map[i], (count + F.lit(self.smoothing)).cast("double"))
            out = out.withColumns(made).drop("_cat", "_cf", "_n", "_tn", *[f"_{p}{i}" for p in "th" for i in range(len(self.encoded()))])
        return out.drop("_fold")

    def frequency_encode(self, df: DataFrame) -> DataFrame:
        """``{col}_freq``: the value's share of all training rows, nulls too; 0 if unseen."""
        for c, table in self.shares.items():
            table = table.withColumnsRenamed({"_cat": f"_cat_{c}", "_share": f"_share_{c}"})
            joined = df.join(table, _text(c).eqNullSafe(F.col(f"_cat_{c}")), "left")
            df = joined.withColumn(f"{c}_freq", F.coalesce(f"_share_{c}", F.lit(0.0))).drop(f"_cat_{c}", f"_share_{c}")
        return df


def _known(df: DataFrame, c: str) -> Column:
    """Not null, not NaN."""
    if df.schema[c].dataType.typeName() in ("double", "float"):
        return F.col(c).isNotNull() & ~F.isnan(c)
    return F.col(c).isNotNull()


@dataclass(frozen=True)
class AggregationFeatures:
    """``{agg}_{column}_by_{over}``: aggregates of columns over groups, learned once and attached by group;
    groups that were not there have null."""

    agg: Mapping[str, Sequence[str]]
    over: Sequence[str]

    def fit_transform(self, train: DataFrame, df: DataFrame) -> DataFrame:
        makers = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}
        names = [f"_key{i}" for i in range(len(self.over))]
        made = [makers[a](c).alias(f"{a}_{c}_by_{'_'.join(self.over)}") for c, kinds in self.agg.items() for a in kinds]
        table = train.groupBy(*[F.col(k).alias(n) for k, n in zip(self.over, names, strict=True)]).agg(*made)
        same = F.lit(True)
        for k, n in zip(self.over, names, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(n))
        return df.join(table, same, "left").drop(*names)
