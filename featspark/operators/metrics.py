"""Scores of predictions, each one aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whether more is better.
REGRESSION = {"mape": False, "mae": False, "rmse": False, "mse": False, "r2": True}
CLASSIFICATION = {"accuracy": True, "precision": True, "recall": True, "f1": True, "roc_auc": True, "log_loss": False}


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One row: mape, mae, rmse, mse, r2 (NaN without variance)."""
    e = F.col(y).cast("double") - F.col(p).cast("double")
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    floor = F.lit(2.220446049250313e-16)
    got = rows.agg(F.avg(F.abs(e) / F.greatest(F.abs(F.col(y).cast("double")), floor)).alias("mape"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                   F.sum(e * e).alias("_res"), (F.var_pop(F.col(y).cast("double")) * F.count("*")).alias("_tot"))
    return got.select("mape", "mae", F.sqrt("mse").alias("rmse"), "mse", F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.nullif(F.col("_tot"), F.lit(0.0))).otherwise(float("nan")).alias("r2"))


def confusion(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """actual, predicted, n and the share of the actual class; missing pairs are left out."""
    n = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def class_scores(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """class, precision, recall, f1, support; what has no cases scores 0."""
    pairs = df.groupBy(F.col(y).alias("a"), F.col(p).alias("b")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.lit(1).alias("actual")), F.struct(F.col("b").alias("class"), F.lit(0).alias("actual")))).alias("s"), "a", "b", "n")
    sums = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.actual") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("s.actual") == 0, F.col("n")).otherwise(0)).alias("_told"),
        F.sum(F.when((F.col("s.actual") == 1) & (F.col("a") == F.col("b")), F.col("n")).otherwise(0)).alias("_hit"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)
    return sums.select("class", part("_hit", "_told").alias("precision"), part("_hit", "support").alias("recall"),
                       F.when(F.col("_told") + F.col("support") > 0, 2 * F.col("_hit") / F.nullif(F.col("_told") + F.col("support"), F.lit(0))).otherwise(0.0).alias("f1"), "support")


def classification_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", positive=None) -> DataFrame:
    """One row: accuracy, precision, recall, f1; of ``positive``, or the mean over classes."""
    wanted = F.col("class") == positive if positive is not None else F.lit(True)
    right = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return class_scores(df, y, p).agg(right.alias("accuracy"), *[F.avg(F.when(wanted, F.col(k))).alias(k) for k in ("precision", "recall", "f1")])


#: Slices of the scores, cut at approximate quantiles; each is summed by itself.
SLICES = 1024


def running(df: DataFrame, order: str, sums: Sequence[str], descending: bool = False, slices: int = SLICES) -> DataFrame:
    """``df`` with ``before_{c}``, the sum of ``c`` over rows that come earlier by the probability
    ``order``, and ``all_{c}``. Sums inside slices of about equal size and over slices: no task sorts all rows."""
    df = df.withColumn("_v", F.coalesce(F.col(order).cast("double"), F.lit(-float("inf"))))
    cuts = df.agg(F.percentile_approx("_v", [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    splits = [-float("inf"), *sorted({c for c in cuts if math.isfinite(c)}), float("inf")]
    df = Bucketizer(splits=splits, inputCol="_v", outputCol="_s").transform(df).drop("_v") if len(splits) > 2 else df.withColumn("_s", F.lit(0.0)).drop("_v")
    totals = df.groupBy("_s").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    by = Window.orderBy(F.desc("_s") if descending else F.asc("_s"))
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("_s", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy("_s").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(F.broadcast(totals), df["_s"].eqNullSafe(totals["_s"])).drop(totals["_s"])  # a row a slice
    made = {f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{c}") for c in sums}
    return out.withColumns(made).drop("_s", *[f"_b_{c}" for c in sums])


def curve(df: DataFrame, y: str = "y_true", score: str = "y_proba") -> DataFrame:
    """threshold, p and n (cases at it), tp, fp, positives, rows, by falling threshold; equal scores are one step."""
    steps = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))
    r = running(steps, "threshold", ["p", "n"], descending=True)
    tp = F.col("before_p") + F.col("p")
    return r.select("threshold", "p", "n", tp.alias("tp"), (F.col("before_n") + F.col("n") - tp).alias("fp"), F.col("all_p").alias("positives"), F.col("all_n").alias("rows"))


def roc_curve(df: DataFrame, y: str = "y_true", score: str = "y_proba") -> DataFrame:
    """threshold, fpr, tpr."""
    return curve(df, y, score).select("threshold", F.try_divide("fp", F.col("rows") - F.col("positives")).alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def roc_auc(df: DataFrame, y: str = "y_true", score: str = "y_proba") -> DataFrame:
    """One row: auc, the share of pairs in order, ties half; null with a single class."""
    negatives_below = F.col("rows") - F.col("positives") - F.col("fp")
    won = F.sum(F.col("p") * (negatives_below + (F.col("n") - F.col("p")) / F.lit(2.0)))
    return curve(df, y, score).agg(F.try_divide(won, (F.sum("p") * F.sum(F.col("n") - F.col("p"))).cast("double")).alias("auc"))


def macro_roc(curves: Sequence[DataFrame], points: int = 101) -> list[tuple[float, float]]:
    """(fpr, tpr) at even false positive rates: the mean over curves of the true positive rate, straight
    between the points of a curve. The area is that under these points."""
    grid = [k / (points - 1) for k in range(points)]
    lines = []
    for c in curves:
        at = F.struct("fpr", "tpr")
        got = c.where("fpr is not null and tpr is not null").agg(*[f(F.when(side, at)).alias(f"{n}{k}") for k, g in enumerate(grid)
                                                                 for n, f, side in (("a", F.max, F.col("fpr") <= g), ("b", F.min, F.col("fpr") >= g))]).first()
        line = []
        for k, g in enumerate(grid):
            (x0, y0), (x1, y1) = got[f"a{k}"] or (0.0, 0.0), got[f"b{k}"] or (1.0, 1.0)
            line.append(y0 if x1 <= x0 else y0 + (y1 - y0) * (g - x0) / (x1 - x0))
        lines.append(line)
    return [(g, sum(ys) / len(ys)) for g, ys in zip(grid, zip(*lines, strict=True), strict=True)]


def area(points: Sequence[tuple[float, float]]) -> float:
    """Area under a line of points, by trapezoids."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


def pr_curve(df: DataFrame, y: str = "y_true", score: str = "y_proba") -> DataFrame:
    """threshold, precision, recall."""
    return curve(df, y, score).select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def average_precision(df: DataFrame, y: str = "y_true", score: str = "y_proba") -> DataFrame:
    """One row: the sum over steps of precision times the gain in recall."""
    part = F.try_divide("p", "positives") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve(df, y, score).agg(F.sum(part).alias("average_precision"))


def log_loss(df: DataFrame, y: str = "y_true", score: str = "y_proba", floor: float = 2.220446049250313e-16) -> DataFrame:
    """One row: mean negative log-likelihood."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(floor)), F.lit(1 - floor))
    return df.agg(F.avg(-F.when(F.col(y).cast("int") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def argmax_class(proba: Column, classes: Sequence[str]) -> Column:
    """The class of the largest probability, the first of equals."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(proba, F.array_max(proba)).cast("int"))
