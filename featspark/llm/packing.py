"""Best-fit packing of token pieces into sequences of bounded length.

A piece is a vector: tokens, one document, attention cost (its length squared). Pieces of one length
are alike, so best fit runs on the driver over counts by length, at most as many as the token limit,
whatever the corpus; it yields patterns of lengths with how often each is used. Pieces then find their
place from their number among those of their length, which comes from counts by task and length: no
task sees more than its own pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .tokens import END_ID, TOKENIZER, load_encoder


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most; the weights of the three parts in the choice of a bin."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def pack_counts(counts: Mapping[int, int], limits: Limits = Limits()) -> list[tuple[int, list[int]]]:
    """(how many sequences, their lengths in order), best fit from the longest length down.

    Rule ``norm`` takes the bin whose weighted residual is shortest after the piece, ``dot`` the one
    whose residual has the largest weighted product with it; both only bins where every limit holds.
    Pieces of one length go to the chosen bins as often as they fit. A length over a limit is an error.
    """
    whole = np.array([limits.tokens, limits.documents, limits.cost], float)
    weights = np.array(limits.weights)
    left = np.empty((0, 3))
    many: list[int] = []
    held: list[list[int]] = []
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        item, todo = np.array([length, 1, length * length], float), counts[length]
        if (item > whole).any():
            raise ValueError(f"a piece of {length} tokens is over the limits")
        while todo:
            fits = (left >= item).all(axis=1) & (np.array(many, float) > 0)
            if fits.any():
                rest = (left - item) / whole
                worth = -(weights * rest * rest).sum(axis=1) if limits.rule == "norm" else (weights * (left / whole) * (item / whole)).sum(axis=1)
                k = int(np.argmax(np.where(fits, worth, -np.inf)))
            else:
                k, left = len(many), np.vstack([left, whole])
                many.append(todo)
                held.append([])
            each = int(min(left[k] // item))
            used = min(many[k], todo // each)
            if not used:
                used, each = 1, todo
            many[k] -= used
            left = np.vstack([left, left[k] - each * item])
            many.append(used)
            held.append(held[k] + [length] * each)
            todo -= used * each
            if many[k] == 0 or not held[k]:
                many[k] = 0
        alive = [i for i, m in enumerate(many) if m > 0]
        left, many, held = left[alive], [many[i] for i in alive], [held[i] for i in alive]
    return list(zip(many, held, strict=True))


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of places by length: sorted by (length, first number), with first sequence and offset."""
    rows, seen, base = [], {}, 0
    for many, lengths in patterns:
        at = 0
        for n in lengths:
            first = seen.get(n, 0)
            rows.append((n, first, base, at))
            seen[n] = first + many
            at += n
        base += many
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def cut_pieces(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole document: doc_id, piece, start, length, ids_crc32. A document is its ids
    and the end id; longer ones are cut into full pieces, the first may be shorter. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = load_encoder(tokenizer), limits.tokens
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(END_ID)
                start, end, piece = 0, len(ids) % size or min(size, len(ids)), 0
                while start < len(ids):
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: those of ``cut_pieces``, sequence_id and offset, gapless from 0.

    Empty and null texts are a piece of the end id alone; repeated rows are packed each by itself; other
    columns are ignored; an empty table gives no pieces.
    """
    pieces = materialize(cut_pieces(docs, limits, tokenizer, id_col, text_col).withColumn("task", F.spark_partition_id()), "pieces")
    by_task = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limits.tokens rows
    places = docs.sparkSession.sparkContext.broadcast(slots(pack_counts(counts, limits)))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bases = by_task.select("task", "length", earlier.alias("base"))
    number = F.row_number().over(Window.partitionBy("task", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = pieces.withColumn("number", number).join(bases, ["task", "length"]).withColumn("number", F.col("number") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = places.value
        stride = int(runs["first"].max(initial=0)) + 1 if len(runs["first"]) else 1
        key = runs["length"].astype(object) * stride + runs["first"] if limits.tokens * stride >= 1 << 62 else runs["length"] * stride + runs["first"]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(key, length * stride + np.minimum(number, stride - 1), side="right") - 1
            sequence = runs["sequence"][k] + number - runs["first"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(runs["offset"][k])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").cast("long").alias("number")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
