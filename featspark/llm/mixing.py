"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree of domains, languages and sources by weight. A child that cannot use
its share leaves the rest to its siblings, and only what a whole family cannot use goes back up. Each
leaf then takes whole epochs of its documents and a token prefix of one more, in an order seeded by
epoch. The prefix's end is found from sums by hash bucket, then by bucket inside that bucket, so no leaf
is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import materialize, unused, word_count

LEVELS = ("domain", "lang", "source")
#: Bits of the order key that make a bucket, and how often the one at the prefix's end is cut again: a
#: leaf's sums have at most 4096 rows, and one part in 16 million of it is ordered.
BUCKET_BITS, BUCKET_LEVELS = 12, 2
#: Leaves up to this number are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 50_000
#: Most leaves: their budgets are worked out on the driver.
MOST_LEAVES = 1_000_000


@dataclass(frozen=True)
class Mix:
    """Weights by path from the root, () excluded; a path without one weighs ``default``."""

    weights: Mapping[tuple[str, ...], float]
    domains: Mapping[str, str]
    other: str = "other"
    default: float = 1.0
    max_epochs: int = 1
    seed: int = 42

    def weight(self, path: tuple[str, ...]) -> Fraction:
        """A path's weight among its siblings; ``("*", lang)`` stands for the language in every domain."""
        found = self.weights.get(path, self.weights.get(("*", *path[1:]), self.default))
        return Fraction(str(found))


def share_out(budget: int, weights: list[Fraction], room: list[int]) -> list[int]:
    """Whole tokens for each child: by weight, never over its room, what one lacks room for to the others."""
    out = [0] * len(room)
    open_ = [i for i in range(len(room)) if room[i] > 0 and weights[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while left and open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= room[i] - out[i]]
        if full:
            for i in full:
                left -= room[i] - out[i]
                out[i] = room[i]
            open_ = [i for i in open_ if i not in full]
            continue
        shares = [left * weights[i] / total for i in open_]
        parts = [int(s) for s in shares]
        for k in sorted(range(len(parts)), key=lambda k: (parts[k] - shares[k], k))[:left - sum(parts)]:
            parts[k] += 1
        for i, p in zip(open_, parts, strict=True):
            out[i] += p
        left = 0
    return out


def leaf_budgets(totals: Mapping[tuple[str, ...], int], budget: int, mix: Mix) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf, given the tokens that one epoch of it has. Leaves below a weight of zero
    get none, and what they hold is no room of the family."""
    out: dict[tuple[str, ...], int] = {}

    def usable(leaf: tuple[str, ...], depth: int) -> bool:
        return all(mix.weight(leaf[:d]) > 0 for d in range(depth + 1, len(leaf) + 1))

    def down(path: tuple[str, ...], leaves: dict[tuple[str, ...], int], given: int) -> None:
        if path in leaves:
            out[path] = given
            return
        families: dict[str, dict] = {}
        for leaf, n in sorted(leaves.items()):
            families.setdefault(leaf[len(path)], {})[leaf] = n
        paths = [(*path, name) for name in families]
        room = [sum(n for leaf, n in f.items() if usable(leaf, len(path) + 1)) * mix.max_epochs for f in families.values()]
        for child, family, part in zip(paths, families.values(), share_out(given, [mix.weight(p) for p in paths], room), strict=True):
            down(child, family, part)

    if totals:
        down((), dict(totals), budget)
    return out


def with_leaf(docs: DataFrame, mix: Mix) -> dict[str, Column]:
    """The columns of a document's leaf; null language and source count as empty."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.lit(mix.other)
    for name, where in mix.domains.items():
        domain = F.when(source == name, where).otherwise(domain)
    return {"domain": domain, "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def plan_mix(docs: DataFrame, mix: Mix, budget: int | None, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(tokens, plan): a row a document with leaf and word count, and a row a leaf with whole epochs and
    the end of the prefix. ``budget`` None: ``share`` of the corpus. One row a leaf meets the driver; over
    ``MOST_LEAVES`` of them are an error."""
    spark = docs.sparkSession
    tokens = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in with_leaf(docs, mix).items()],
                                     word_count(F.col("text")).alias("n_tokens")), "mix-tokens")
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves: group the sources")
    totals = {tuple(r[k] for k in LEVELS): r["n"] for r in leaves}
    whole = int(sum(totals.values()) * Fraction(str(share))) if budget is None else budget
    rows = [(*leaf, *(divmod(given, totals[leaf]) if totals[leaf] else (0, 0)), given) for leaf, given in leaf_budgets(totals, whole, mix).items()]
    schema = pa.schema([*((k, pa.string()) for k in LEVELS), *((k, pa.int64()) for k in ("epochs", "rest", "budget"))])
    plan = spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema))  # a list would start Python workers of another kind, which stay
    keyed = tokens.join(_small(plan.where("rest > 0"), len(rows)), list(LEVELS)).withColumn("key", order_key(mix))
    by_key = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    near = keyed.withColumn("base", F.lit(0).cast("long"))
    for level in range(1, BUCKET_LEVELS + 1):  # the bucket in which the prefix ends, then the one inside it
        bucket = F.shiftright("key", 64 - level * BUCKET_BITS).alias("bucket")
        sums = near.groupBy(*LEVELS, "rest", "base", bucket).agg(F.sum("n_tokens").alias("n"))
        edge = sums.withColumn("to", F.col("base") + F.sum("n").over(by_key)).where("to >= rest and to - n < rest").select(
            *LEVELS, "bucket", (F.col("to") - F.col("n")).alias("base"))
        near = keyed.withColumn("bucket", F.shiftright("key", 64 - level * BUCKET_BITS)).join(_small(materialize(edge, "mix-edges"), len(rows)), [*LEVELS, "bucket"])
    inside = near.groupBy(*LEVELS, "rest", "base", "key", "doc_id").agg(F.sum("n_tokens").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("to", F.col("base") + so_far).where("to >= rest and to - n < rest").select(
        *LEVELS, F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("to") + F.col("n")).alias("cut_tokens"))
    cuts = materialize(cut, "mix-cuts")
    return tokens, materialize(plan.join(_small(cuts, len(rows)), list(LEVELS), "left"), "mix-plan")


def _small(df: DataFrame, leaves: int) -> DataFrame:
    return F.broadcast(df) if leaves <= BROADCAST_LEAVES else df


def order_key(mix: Mix) -> Column:
    """Place of a document in its leaf's next epoch; needs columns doc_id and epochs."""
    return F.xxhash64(F.lit(mix.seed), F.col("epochs"), F.col("doc_id"))


def _taken(mix: Mix) -> tuple[Column, Column]:
    """(times a document is taken, tokens taken), for rows joined with the plan."""
    key, at = order_key(mix), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    edge = F.coalesce(F.col("cut_id"), F.lit(-(1 << 63)))
    on_edge = (key == F.col("cut_key")) & (at == edge)
    before = (key < F.col("cut_key")) | (key == F.col("cut_key")) & (at < edge)
    part = F.when(F.col("cut_key").isNull(), 0).when(before, F.col("n_tokens")).when(on_edge, F.least("cut_tokens", "n_tokens")).otherwise(0)
    more = F.when(F.col("cut_key").isNull(), 0).when(before | on_edge, 1).otherwise(0)
    return (F.col("epochs") + more).cast("long"), (F.col("epochs") * F.col("n_tokens") + part).cast("long")


def mix_documents(docs: DataFrame, mix: Mix, budget: int | None = None, share: float = 1.0) -> DataFrame:
    """A row for each document taken: doc_id, domain, lang, source, n_tokens, times, tokens_taken.

    Tokens are words between ASCII white space; null texts have none. ``times`` counts the epochs that
    reach the document, ``tokens_taken`` sums its tokens in them: all but for the document at the end of
    its leaf's prefix. Rows repeated with one id stand at one place of the order together. Other columns
    are ignored; an empty table or a budget of 0 gives no rows.
    """
    tokens, plan = plan_mix(docs, mix, budget, share)
    times, taken = _taken(mix)
    joined = tokens.join(F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan, list(LEVELS))
    return joined.withColumns({"times": times, "tokens_taken": taken}).where("times > 0").select(
        "doc_id", *LEVELS, "n_tokens", "times", "tokens_taken")


def keep_mixed(docs: DataFrame, mix: Mix, budget: int | None = None, share: float = 1.0) -> DataFrame:
    """The documents taken, whole and with all columns, once for each time they are taken.

    The document at the end of a leaf's prefix stays whole here, where ``mix_documents`` takes a part of it.
    Null texts have no tokens, null languages and sources are leaves of their own; rows repeated with one
    id are taken together; an empty table gives an empty one.
    """
    _, plan = plan_mix(docs, mix, budget, share)
    leaf = list(unused(docs, *LEVELS))
    leaf_columns = with_leaf(docs, mix)
    marked = docs.withColumns({name: leaf_columns[level] for name, level in zip(leaf, LEVELS, strict=True)})
    epochs, cut_key, cut_id, times = unused(marked, "epochs", "cut_key", "cut_id", "times")
    cuts = plan.select(*[F.col(level).alias(name) for name, level in zip(leaf, LEVELS, strict=True)], F.col("epochs").alias(epochs),
                       F.col("cut_key").alias(cut_key), F.col("cut_id").alias(cut_id))
    joined = marked.join(F.broadcast(cuts) if plan.count() <= BROADCAST_LEAVES else cuts, leaf)
    at, edge = (F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))) for c in ("doc_id", cut_id))
    key = F.xxhash64(F.lit(mix.seed), F.col(epochs), F.col("doc_id").cast("long"))
    reached = (key < F.col(cut_key)) | (key == F.col(cut_key)) & (at <= edge)
    often = (F.col(epochs) + F.when(F.coalesce(reached, F.lit(False)), 1).otherwise(0)).cast("int")
    joined = joined.withColumn(times, often).where(F.col(times) > 0)
    if mix.max_epochs > 1:
        joined = joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
