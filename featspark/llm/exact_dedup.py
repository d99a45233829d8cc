"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row a digest before the
shuffle, loses what the index has by a sort-merge anti-join, and the rest is appended. Only SQL
functions run; texts are read once and never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, materialize, unused

#: Digests holding more than this share of a batch join by broadcast: at most 1/share of them exist.
HOT_SHARE = 1 / 1000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Digests of every text seen, with the document that stands for each.

    ``ingest`` decides a batch. Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and empty texts are equal to each other. Of equal texts in one batch the row with the
    largest id stays (null ids lose to any other; of rows repeated with one id a single row stays); a
    digest of an earlier batch makes every new row a copy of the earlier one. Extra columns of the
    batch are ignored, an empty batch gives an empty result.

    The bucketing saves the index's shuffle in every anti-join. Its sort order holds inside a file, and
    each batch adds files, so joins sort buckets anew until ``compact`` has made one file of each; Spark
    relies on the order of such files under ``spark.sql.legacy.bucketedTableScan.outputOrdering``.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def _append(self, df: DataFrame, table: str | None = None) -> None:
        (df.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .saveAsTable(table or self.table))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

        ``batch`` names the rows; sent again under its name, after a lost job or reply, a batch adds
        nothing and gets the answer of the first time. Without a name a batch is a new one.
        """
        batch = batch or uuid.uuid4().hex
        rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"),
                                       F.monotonically_increasing_id().alias("row")), "digests")
        groups = materialize(rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("largest"), F.count("*").alias("n_rows")), "digest-groups")
        new = groups.hint("merge").join(self.spark.table(self.table), "digest", "left_anti")
        self._append(new.select("digest", F.col("largest.doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
        return self._decide(rows, groups, batch)

    def _decide(self, rows: DataFrame, groups: DataFrame, batch: str) -> DataFrame:
        index = self.spark.table(self.table).select("digest", "keep_id", "batch")
        known = materialize(groups.hint("merge").join(index, "digest"), "known-digests")
        most = max(1.0, rows.count() * HOT_SHARE)
        hot, cold = known.where(F.col("n_rows") > most), known.where(F.col("n_rows") <= most)
        by_hot = rows.join(F.broadcast(hot), "digest")  # under 1/HOT_SHARE rows
        by_cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").hint("merge").join(cold, "digest")
        kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("largest.row"))
        return by_hot.unionByName(by_cold).select(
            "doc_id", "keep_id", F.col("n_rows").alias("group_size"), kept.alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self) -> None:
        """Rewrite the index with one sorted file a bucket, under a new table that takes its name."""
        fresh = f"{self.table}_{uuid.uuid4().hex[:8]}"
        self._append(self.spark.table(self.table).repartition(self.buckets, "digest"), fresh)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def first_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ingest`` into an empty index of the warehouse that is dropped again."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    try:
        return materialize(index.ingest(docs, id_col, text_col), "decisions")
    finally:
        index.drop()


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with one id and equal
    texts any one stays. An empty table gives an empty one."""
    decided = first_decisions(docs, id_col, text_col)
    keep, digest = unused(docs, "keep", "digest")
    own = decided.select(F.col("doc_id").alias(keep), F.unhex("text_sha256").alias(digest), "kept")
    marked = docs.withColumn(digest, text_digest(F.col(text_col))).withColumn(keep, F.col(id_col).cast("long"))

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, rows[keep].eqNullSafe(some[keep]) & (rows[digest] == some[digest]), how)

    out = among(marked, own.where("kept").drop("kept"), "left_semi")
    if decided.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([keep, digest])
    return out.drop(keep, digest)
