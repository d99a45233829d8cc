import zlib

from pyspark.sql import functions as F

from featspark.llm.langid import fit_language_id, held_out, keep_identified, predict_language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_id(docs.where(~held_out()))
    assert sorted(model.dictionaries) == ["de", "en", "es", "fr"]
    rows = predict_language(docs, model).join(docs.select("doc_id", "lang", held_out().alias("held")), "doc_id").where("held").collect()
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000))
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, documents, awkward, no_docs):
    model = fit_language_id(documents)
    rows = predict_language(awkward, model).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        lettered = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not lettered)
        assert lettered or (r["score"] == 0 and r["rejected"])
    assert predict_language(awkward, model).count() == awkward.count()
    assert predict_language(no_docs, model).count() == 0
    kept = keep_identified(awkward, model)
    assert kept.columns == awkward.columns and 0 < kept.count() < awkward.count()


def test_nothing_to_learn_from(spark, awkward, no_docs):
    for labelled in (no_docs, awkward.withColumn("lang", F.lit(None).cast("string"))):
        model = fit_language_id(labelled)
        assert {r["lang_pred"] for r in predict_language(awkward, model).collect()} == {"und"}


def test_only_text_is_used(documents):
    model = fit_language_id(documents)
    same = documents.withColumns({"lang": F.lit("en"), "source": F.lit("x"), "doc_id": F.col("doc_id") + 1})
    a = [(r["lang_pred"], r["score"]) for r in predict_language(documents, model).orderBy("doc_id").collect()]
    assert a == [(r["lang_pred"], r["score"]) for r in predict_language(same, model).orderBy("doc_id").collect()]


def test_sample_stays_bounded_and_copies_count_once(spark):
    def docs(ids):
        return spark.range(3000).selectExpr(f"{ids} as doc_id", "concat('word', id, ' and other words') as text", "'en' as lang")

    for ids in ("cast(null as bigint)", "id"):
        said = fit_language_id(docs(ids), sample_docs=20).dictionaries["en"].decode()
        assert 1 <= said.count("and other words") <= 40
    once, often = docs("id").limit(50), docs("id").limit(50)
    assert fit_language_id(often.unionAll(once)) == fit_language_id(once)
