"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of signed changes is summed by key, written aside and committed by renaming it to its batch id,
which fails if that id is there: a batch sent again, even by two writers at once, counts once. ``fold``
adds committed deltas to a base of totals that keeps the ids it holds, so totals read the base and the
deltas since, however many batches there were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize
from .tokens import TOKENIZER, load_encoder

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, name: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row for each row of ``docs``: doc_id, the columns ``keep`` as strings, n_tokens of the whole
    text (null and empty: 0). Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(name)
        for batch in batches:
            counts = [len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], ["doc_id", *keep, "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(k).cast("string").alias(k) for k in keep],
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{k} string' for k in keep)}, n_tokens long")


class TokenRollup:
    """Totals kept under ``path``, a folder that all executors share.

    ``commit(batch_id, changes)`` takes columns source, lang, tokenizer, op, n_tokens and old_tokens,
    where op is insert (adds a document and n_tokens), delete (takes both away) or revise (adds
    n_tokens - old_tokens); any other op fails the batch. Null keys are a key of their own, null counts
    are 0, repeated rows are repeated changes, an empty batch commits and changes nothing.

    The folder's file system must rename a folder at once or not at all, as HDFS and local disks do.
    Bases are numbered; the last one that is whole holds. Only one ``fold`` runs at a time, besides any
    commits: it takes in the deltas it finds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, aside: str, path: str) -> bool:
        """Rename a folder to ``path``; False, and the folder is gone, if that is there already."""
        context = self._hadoop.FileContext.getFileContext(self._at(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        context.mkdir(self._at(path).getParent(), self._hadoop.permission.FsPermission.getDirDefault(), True)
        how = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._at(aside), self._at(path), how)
            return True
        except Py4JJavaError:
            if not context.util().exists(self._at(path)):
                raise
            context.delete(self._at(aside), True)
            return False

    def _base(self) -> str | None:
        bases = self._names("base")
        return f"{self.path}/base/{bases[-1]}" if bases else None

    def _folded(self) -> DataFrame:
        base = self._base()
        return self.spark.read.parquet(f"{base}/ids") if base else self.spark.createDataFrame([], "batch_id string")

    def committed(self) -> list[str]:
        """Ids of all batches committed so far."""
        return sorted({*(r["batch_id"] for r in self._folded().collect()), *self._names("deltas")})

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if batch_id in self._names("deltas") or self._folded().where(F.col("batch_id") == batch_id).limit(1).count():
            return False
        sign = (F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
                .otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(F.col("op"), F.lit("null"))))))
        new, old = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
        tokens = F.when(F.col("op") == "revise", new - old).when(F.col("op") == "delete", -new).otherwise(new)
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens")).write.parquet(aside)
        return self._publish(aside, f"{self.path}/deltas/{batch_id}")

    def _sums(self, base: str | None, deltas: list[str]) -> DataFrame:
        paths = [*([f"{base}/totals"] if base else []), *(f"{self.path}/deltas/{d}" for d in deltas)]
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def _open(self) -> tuple[str | None, list[str]]:
        """The base, and the deltas it does not hold: a delta may outlive its fold until it is removed."""
        base, deltas = self._base(), self._names("deltas")
        held = {r["batch_id"] for r in self._folded().where(F.col("batch_id").isin(deltas)).collect()} if deltas else set()
        return base, [d for d in deltas if d not in held]

    def fold(self) -> None:
        """Make a base of the last one and the deltas since, and remove these."""
        base, deltas = self._open()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self._sums(base, deltas).where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{aside}/totals")
        ids = self.spark.createDataFrame([(d,) for d in deltas], "batch_id string")
        self._folded().unionByName(ids).coalesce(1).write.parquet(f"{aside}/ids")
        if not self._publish(aside, f"{self.path}/base/{len(self._names('base')):09d}"):
            raise RuntimeError("another fold ran")
        for d in deltas:
            at = self._at(f"{self.path}/deltas/{d}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def totals(self) -> DataFrame:
        """Sums over committed batches; keys whose documents are all gone are left out."""
        return self._sums(*self._open()).where("n_docs <> 0 or n_tokens <> 0")


def estimated_then_exact(docs: DataFrame, rollup: TokenRollup, name: str = TOKENIZER) -> DataFrame:
    """Totals of ``docs``: inserted with a quarter of their bytes as an estimate, revised to exact counts,
    texts without tokens deleted and inserted again. Every batch is sent again, as after a lost reply,
    the first ones when they are in the base already. Every row of ``docs`` counts as a document."""
    guessed = docs.select("doc_id", "source", "lang", "text", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) / 4).cast("long").alias("guess"))
    exact = materialize(count_tokens(guessed, name, keep=("source", "lang", "guess")), "token-counts")
    rows = exact.select("source", "lang", F.lit(name).alias("tokenizer"), F.col("guess").cast("long").alias("guess"), F.col("n_tokens").alias("exact"))
    zero, none = F.lit(0).cast("long"), rows.where("exact = 0")

    def changes(some: DataFrame, op: str, new, old) -> DataFrame:
        return some.select(*KEYS, F.lit(op).alias("op"), new.alias("n_tokens"), old.alias("old_tokens"))

    load, revise = changes(rows, "insert", F.col("guess"), zero), changes(rows, "revise", F.col("exact"), F.col("guess"))
    rollup.commit("0-load", load)
    rollup.commit("1-revise", revise)
    rollup.fold()
    rollup.commit("2-withdraw", changes(none, "delete", zero, zero))
    rollup.commit("3-restore", changes(none, "insert", zero, zero))
    for batch_id, again in (("0-load", load), ("1-revise", revise), ("3-restore", changes(none, "insert", zero, zero))):
        rollup.commit(batch_id, again)
    return rollup.totals()
