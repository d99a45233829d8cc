from collections import Counter

import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featspark.llm._common import scratch_path
from featspark.llm.token_rollup import TokenRollup, estimated_then_exact
from featspark.llm.tokens import load_encoder

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CHANGES = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"


def slow(text):
    return SLOW.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_json_tokenizer(documents):
    encode = load_encoder()
    texts = [r["text"] for r in documents.select("text").collect()]
    texts += ["", " ", "a\x1cb\x85c\xa0 d　\n\n\n", "½²Ⅷ١٢ é 𝔘😀👩‍👩‍👧", "x<|endoftext|>y", "it's I'LL we've'd ''s", "\r\n\t \x0b z  ", "中文字 한국어 हिन्दी"]
    for t in texts:
        assert encode(t) == slow(t), t[:50]


def totals_of(docs):
    n, docs_n = Counter(), Counter()
    for r in docs.select("source", "lang", "text").collect():
        count = len(slow(r["text"])) if r["text"] else 0
        n[r["source"], r["lang"]] += count
        docs_n[r["source"], r["lang"]] += 1
    return {k: (docs_n[k], n[k]) for k in n}


def test_totals(spark, documents, awkward, no_docs):
    for docs in (documents, awkward, no_docs):
        got = estimated_then_exact(docs, TokenRollup(spark, scratch_path(spark, "rollup"))).collect()
        assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in got} == totals_of(docs)


def test_signed_changes_and_replays(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0 and rollup.committed() == []
    def make(*rows):
        return spark.createDataFrame(list(rows), CHANGES)
    assert rollup.commit("a", make(("s", "en", "v1", "insert", 10, None), ("s", "en", "v1", "insert", 5, 0), (None, None, None, "insert", None, None)))
    assert not rollup.commit("a", make(("s", "en", "v1", "insert", 10, None)))
    assert rollup.commit("b", make(("s", "en", "v1", "delete", 10, 0), ("s", "en", "v1", "revise", 7, 5), (None, None, None, "delete", 0, 0)))
    assert rollup.commit("c", make())
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v1", 1, 7)]
    with pytest.raises(PySparkException):
        rollup.commit("d", make(("s", "en", "v1", "upsert", 1, 0)))
    assert rollup.committed() == ["a", "b", "c"]


def test_folded_batches_are_remembered(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.fold()
    one = spark.createDataFrame([("s", "en", "v1", "insert", 10, None)], CHANGES)
    gone = spark.createDataFrame([("s", "en", "v1", "delete", 10, None)], CHANGES)
    for k in range(4):
        assert rollup.commit(f"b{k}", one)
        if k % 2:
            rollup.fold()
            assert rollup._names("deltas") == []
    assert not rollup.commit("b0", one) and not rollup.commit("b3", one)
    assert rollup.commit("c", gone)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v1", 3, 30)]
    assert rollup.committed() == ["b0", "b1", "b2", "b3", "c"]


def test_two_writers_of_one_batch(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    one = spark.createDataFrame([("s", "en", "v1", "insert", 10, None)], CHANGES)
    for k in range(2):
        one.groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{rollup.path}/aside/w{k}")
    assert [rollup._publish(f"{rollup.path}/aside/w{k}", f"{rollup.path}/deltas/a") for k in range(2)] == [True, False]
    assert rollup._names("aside") == [] and [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v1", 1, 10)]
