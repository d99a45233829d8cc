"""Shared pieces: scratch tables in the cluster's shared folder, ASCII lower case, special words."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set only where a session on one machine names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/featspark"

#: Fixed value: the separators between words.
SPACE = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_SCRATCH
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Most rows and bytes of a batch between the JVM and Python while a table is written: documents can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH``; afterwards the session has its own settings again."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for key, most in BATCH.items():
            if not 0 < int(before[key].rstrip("b") if before[key].rstrip("b").isdigit() else 0) <= most:
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: Rows of narrow tables that make a file, where their number is known.
FILE_ROWS = 250_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and losing
    an executor later costs no recomputation. ``rows``, if it is known that there are hardly more and
    that what they come from is as small, keeps a small table to few files."""
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what Python has freed to the machine: workers outlive their tasks and keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    """Number of words, runs free of ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
