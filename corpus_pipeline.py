"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. Extra columns pass through whatever
their names, null ids are rows like any other, repeated rows are copies of each other, texts of any
length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from featspark.llm import exact_dedup, langid, mixing, packing, similar_copies
from featspark.llm._common import materialize
from featspark.llm.queries import MIX

#: Part of the words left by the earlier stages that the mix takes, each document once at most.
MIX_SHARE = 0.75


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; those of null, empty or letterless text or of a narrow margin go."""
    return langid.keep_identified(docs, langid.fit_language_id(docs.where(~langid.held_out())))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z), the document of the largest id; null ids lose to any other."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more of 5-word shingles), the document of the smallest
    id; null ids lose to any other. SimHash links the nearest ones, an exact filter the rest."""
    return similar_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the target weights, whole and once at most: ``MIX_SHARE`` of the words, each leaf
    to the end of the document that its prefix ends in. Null languages and sources are leaves of their own."""
    return mixing.keep_mixed(docs, replace(MIX, max_epochs=1), share=MIX_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences; an empty text is a piece of the end id."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express compression, hashing by XXH64 or a tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
