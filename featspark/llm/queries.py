"""Queries of the ten operators and the pipeline, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html, langid, mixing, packing, pii, simhash, token_rollup, vector_search
from ._common import scratch_path

#: Production mix: domains of the sources, weights of domains and, in each, of languages.
MIX = mixing.Mix(
    domains={"src0": "web", **{f"src{i}": "news" for i in (1, 2, 3, 4, 5)}, **{f"src{i}": "books" for i in (6, 7, 8, 9)},
             **{f"src{i}": "code" for i in (10, 11, 12)}},
    weights={("web",): 0.4, ("news",): 0.2, ("books",): 0.2, ("code",): 0.1, ("other",): 0.1,
             ("*", "en"): 0.5, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.1},
    max_epochs=4)

#: Fixed value: a conversation that every chat run formats besides the table.
PROBE = "\\### Assistant: </turn> ok"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"), MIX)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.first_decisions(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit_language_id(docs.where(~langid.held_out()))
    return langid.predict_language(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                                                       "lang_pred", "score", "rejected")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chats(turns.unionByName(probe)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "token-rollup"))
    return token_rollup.estimated_then_exact(read(spark, sf_dir, "documents"), rollup)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents"))


def op9_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_mixing, op2_html_text, op3_exact_dedup, op4_language_id, op5_pii, op6_chat_format,
                                    op7_token_counts, op8_simhash, op9_vector_top_k, op10_packing)}


OP3_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op9_vector_top_k": OP9_SQL}
