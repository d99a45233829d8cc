import zlib

import corpus_pipeline
from featspark.llm.langid import classifier, fit_language_id, held_out
from featspark.llm.queries import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    sizes = [n for n, _ in corpus_pipeline.STAGES]
    assert sizes == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(docs)
        if len(kept) < 5:
            assert docs.columns == documents.columns
            assert 0 < docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0
    say = classifier(fit_language_id(documents.where(~held_out())))
    accepted = {r["doc_id"] for r in documents.collect() if (f := say(r["text"]))[0] != "und" and f[1] >= 0.002}
    assert {r["doc_id"] for r in kept[0].collect()} == accepted and len(accepted) >= 0.97 * documents.count()
    largest = {}
    for r in kept[0].collect():
        key = r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        largest[key] = max(largest.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in kept[1].collect()} == set(largest.values())
    assert {r["doc_id"] for r in kept[4].collect()} == {r["doc_id"] for r in kept[3].collect()}
    again = corpus_pipeline.run(spark, SF)
    assert again.count() == kept[4].count()


def test_one_query_for_each_operator(spark):
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert zlib.crc32(b"12") % 4 == spark.range(1).select(F.crc32(F.lit(12).cast("string")) % 4).first()[0]


def test_stages_on_odd_tables(spark, documents, awkward, no_docs):
    for docs in (awkward.unionByName(documents.select("doc_id", "text", "lang", "source"), allowMissingColumns=True), awkward, no_docs):
        columns, rows = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            before, docs = docs, spark.createDataFrame(out.collect(), out.schema)
            if stage is not corpus_pipeline.pack_sequences:
                assert docs.columns == columns and docs.count() <= rows and docs.exceptAll(before).count() == 0
                rows = docs.count()
        assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_language_stage_keeps_rows_as_they_are(spark, documents, awkward, no_docs):
    from featspark.llm.langid import keep_identified

    model = fit_language_id(documents)
    say = classifier(model)
    want = sorted(str(r) for r in awkward.collect() if (f := say(r["text"]))[0] != "und" and f[1] >= 0.002)
    assert sorted(map(str, keep_identified(awkward, model).collect())) == want and want
    assert keep_identified(no_docs, model).count() == 0 and keep_identified(awkward, fit_language_id(no_docs)).count() == 0


def test_stages_leave_executors_little_to_hold(spark, documents, monkeypatch):
    """Whole texts go to Python in small batches, whatever writes the stage; the mix starts no Python workers for its plan."""
    first = corpus_pipeline.identify_language(spark, documents, SF)
    assert "MapInArrow" not in first._jdf.queryExecution().toString() and first.count() > 0.9 * documents.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert corpus_pipeline.mix_sources(spark, first, SF).count() > 0


def test_hashing_takes_little_memory():
    import tracemalloc

    import numpy as np
    from featspark.llm.similar_copies import _word_hashes

    data = np.frombuffer(b"seven77 " * (1 << 18), np.uint8)
    tracemalloc.start()
    hashes, text = _word_hashes(data, np.array([0, 1 << 20]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 1 and text.tolist() == [0] * (1 << 17) + [1] * (1 << 17)
    assert peak < 20 * len(data)
