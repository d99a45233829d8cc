"""Exact top-k search by inner product with a vector-approximation file.

The file is written once: rows in pages, each page with the range of every component and one byte of
quantised cell a component. Blocks of queries meet the pages in one job and read cells alone: a cell
bounds its component from both sides, so it bounds every score. What the kth lower bound of a query rules
out is left behind. Exact vectors are then read in order of the bounds: first the most promising
candidates, whose kth score settles which others can still count, then those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Cells of a component; rows of a page; most queries of a block; most pages that a task scans for a block; bounds held at once.
CELLS, PAGE, BLOCK, SPAN, HELD = 256, 4096, 8192, 64, 1 << 20


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for a null vector or one with a null,
    non-finite or missing component."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.floor(v * scale).cast("double"))
    fine = F.forall(vector.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), x)


def quantise(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells): component j of a row lies in [low + width * cell, low + width * (cell + 1) - 1]."""
    low, high = exact.min(axis=0), exact.max(axis=0)
    width = np.maximum(np.ceil((high - low + 1) / CELLS), 1.0)
    return low, width, np.minimum((exact - low) // width, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, slack): each query's score with each row is within ``slack`` of ``middle``."""
    half = (width - 1) / 2
    middle = (queries * width) @ cells.T.astype(np.float64) + (queries @ (low + half))[:, None]
    size = np.abs(queries)
    rounding = (size @ (np.abs(low) + CELLS * width)) * (len(low) * 2.0 ** -49)  # far under 0.5 unless components are huge
    return middle, size @ half + rounding + 0.5


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat components and where each vector begins, with the end."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _by_size(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, places in the batch, vectors) for runs of at most ``most`` rows of one size; vectors are the last column."""
    flat, offsets = _vectors(batch.column(batch.num_columns - 1))
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == size)
        for i in range(0, len(pick), most):
            yield size, pick[i:i + most], flat[offsets[:-1][pick[i:i + most]][:, None] + np.arange(size)]


def approximation_file(rows: DataFrame) -> DataFrame:
    """A row a page of at most ``PAGE`` rows of one size: page, size, rows and ids (longs), low, width, cells."""
    names = ["size", "rows", "ids", "low", "width", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def page(size: int) -> pa.RecordBatch:
            row, ids, exact = map(np.concatenate, zip(*held.pop(size), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (row, ids, *quantise(exact)))], names)

        for batch in batches:
            row, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for size, some, exact in _by_size(batch, PAGE):
                if sum(len(x[0]) for x in held.get(size, ())) + len(some) > PAGE:
                    yield page(size)
                held.setdefault(size, []).append((row[some], ids[some], exact))
        for size in list(held):
            yield page(size)

    return rows.select("row", "vec_id", "v").mapInArrow(run, "size int, rows binary, ids binary, low binary, width binary, cells binary").withColumn(
        "page", F.monotonically_increasing_id())


def query_blocks(asked: DataFrame) -> DataFrame:
    """A row a block of at most ``BLOCK`` queries of one size: block, size, ids, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for size, some, exact in _by_size(batch, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([exact.tobytes()], pa.binary())],
                                                 ["size", "ids", "vectors"])

    return asked.select("vec_id", "v").mapInArrow(run, "size int, ids binary, vectors binary").withColumn("block", F.monotonically_increasing_id())


def candidates(pages: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, row, low, high: what the cells cannot rule out, with the bounds of its score.

    Pages are dealt to spans and blocks of queries to every span, so a task holds one span and one block;
    the file is shuffled once for each block, the queries once for each span.
    """
    names = ["query_id", "row", "low", "high"]

    def best(table: pa.Table, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        sure = np.full((len(queries), k), -np.inf)  # largest lower bounds so far
        found = []
        for row, ids, low, width, cells in zip(*(table.column(c) for c in ("rows", "ids", "low", "width", "cells")), strict=True):
            row, ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (row, ids))
            low, width = (np.frombuffer(x.as_buffer(), np.float64) for x in (low, width))
            middle, slack = bounds(queries, low, width, np.frombuffer(cells.as_buffer(), np.uint8).reshape(len(ids), -1))
            middle[query_ids[:, None] == ids[None, :]] = -np.inf
            lower, upper = middle - slack[:, None], middle + slack[:, None]
            top = np.partition(lower, -k, axis=1)[:, -k:] if len(ids) > k else lower
            sure = np.partition(np.concatenate([sure, top], axis=1), -k, axis=1)[:, -k:]
            q, r = np.nonzero((upper >= sure.min(axis=1)[:, None]) & (middle > -np.inf))
            found.append((q, row[r], lower[q, r], upper[q, r]))
        q, row, lower, upper = (np.concatenate(c) for c in zip(*found, strict=True))
        stay = upper >= sure.min(axis=1)[q]
        return query_ids[q[stay]], row[stay], lower[stay], upper[stay]

    def scan(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for ids, vectors in zip(asked.column("ids"), asked.column("vectors"), strict=True) if table.num_rows else ():
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            queries = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(ids), -1)
            step = max(1, HELD // PAGE)
            out += [best(table, ids[i:i + step], queries[i:i + step]) for i in range(0, len(ids), step)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64)]
        return pa.table(dict(zip(names, columns, strict=True)))

    n = pages.count()
    spans = max(1, -(-n // max(1, min(SPAN, n // 64))))
    left = pages.withColumn("span", F.pmod(F.xxhash64("page"), F.lit(spans))).join(materialize(blocks.select("size", "block"), "block-numbers"), "size")
    right = blocks.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))))
    keys = ["size", "span", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, row long, low double, high double")


def exact_scores(some: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, vec_id, score of the candidates ``some``: only their vectors are read from ``rows``."""
    both = some.select("query_id", "row").join(rows.select("row", "vec_id", "v"), "row").join(
        asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    whole = "decimal(38,0)"
    sum_of = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    most = F.array_max(F.transform("v", F.abs)) * F.array_max(F.transform("q", F.abs)) * F.size("v")
    wide = F.aggregate(F.zip_with("v", "q", lambda a, b: (a.cast(whole) * b.cast(whole)).cast(whole)), F.lit(0).cast(whole), lambda acc, x: (acc + x).cast(whole))
    return both.select("query_id", "vec_id", F.when(most < float(1 << 53), sum_of.cast("long")).otherwise(wide.cast("long")).alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's k best rows of other ids, ties to the
    smaller id; all of them if there are fewer.

    Null ids, null vectors and vectors with null or non-finite components take no part. Vectors of
    unlike length have no score with each other. Repeated rows of one id are candidates each by itself;
    a repeated query is asked once, with its first vector in order. A score beyond 64 bits fails. Other
    columns are ignored; no queries or no rows give no result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"), is_query.alias("asked"))
    rows = materialize(rows.where("vec_id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = materialize(rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    blocks = materialize(query_blocks(asked.repartition(-(-max(1, asked.count()) // BLOCK))), "query-blocks")
    found = materialize(candidates(materialize(approximation_file(rows), "cells"), blocks, k), "candidates")

    by = Window.partitionBy("query_id")
    kth = F.max(F.when(F.col("place") == k, F.col("low"))).over(by)
    alive = found.withColumn("place", F.row_number().over(by.orderBy(F.desc("low")))).withColumn("sure", kth).where("sure is null or high >= sure")
    alive = materialize(alive.select("query_id", "row", "high", F.row_number().over(by.orderBy(F.desc("high"), "row")).alias("place")), "in-order")
    first = materialize(exact_scores(alive.where(F.col("place") <= 2 * k), rows, asked), "first-scores")
    settled = first.withColumn("place", F.row_number().over(by.orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    rest = alive.where(F.col("place") > 2 * k).join(settled, "query_id").where(F.col("high") >= F.col("least"))
    scores = first.unionByName(exact_scores(rest, rows, asked))
    ranked = scores.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
