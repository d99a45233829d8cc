"""Connected components by alternating large-star and small-star rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """For every node of ``links`` (a, b: long) that is linked: node, component, the smallest node reachable.

    Each round is two grouped minima and joins back; it ends when no link changes. Links to itself and
    repeated links do no harm; null ends are dropped; no links give no rows. Tables are written to the
    shared folder between rounds, and the driver sees two sums a round.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = materialize(edges, "links")
    n = edges.count()
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = materialize(large, "large-star", 2 * n)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        edges = materialize(small.where("v <> u").distinct(), "small-star", 2 * n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
