import uuid
from collections import defaultdict
from hashlib import sha256

from featspark.llm.exact_dedup import DigestIndex, drop_exact_copies, first_decisions

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(LOWER)


def new_index(spark):
    return DigestIndex(spark, f"index_{uuid.uuid4().hex}")


def check(spark, docs):
    groups = defaultdict(list)
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    got = first_decisions(docs).collect()
    assert len(got) == len(rows)
    by = {sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r["text_sha256"]]
        largest = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (largest, len(ids))
        assert not r["kept"] or r["doc_id"] == largest
    assert sum(r["kept"] for r in got) == len(groups)


def test_against_brute_force(spark, documents, awkward, no_docs):
    for docs in (documents, awkward, no_docs):
        check(spark, docs)


def test_later_batches_lose_what_the_index_has(spark):
    index = new_index(spark)
    first = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    again = spark.createDataFrame([(9, "B"), (8, "c"), (7, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(first).collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(again).collect()) == [(7, 8, False), (8, 8, True), (9, 3, False)]
    assert spark.table(index.table).count() == 3


def test_hot_group_and_kept_rows(spark, awkward, no_docs):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same text', concat('t', cast(id as string))) as text", "id as kept")
    out = drop_exact_copies(docs)
    assert out.columns == ["doc_id", "text", "kept"]
    assert out.count() == 4001 and out.where("text = 'Same text'").first()["doc_id"] == 5997
    assert drop_exact_copies(awkward).count() == len({norm(r["text"]) for r in awkward.select("text").collect()})
    assert drop_exact_copies(no_docs).count() == 0


def test_a_batch_sent_again_gets_the_same_answer(spark):
    index = new_index(spark)
    rows = [(1, "A"), (2, "a"), (2, "a"), (3, "b"), (None, None)]
    first = spark.createDataFrame(rows, "doc_id long, text string")
    told = sorted(map(str, index.ingest(first, batch="one").collect()))
    index.ingest(spark.createDataFrame([(9, "new")], "doc_id long, text string"), batch="two").collect()
    again = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    assert sorted(map(str, index.ingest(again, batch="one").collect())) == told
    assert spark.table(index.table).count() == 4
    index.compact()
    assert sorted(map(str, index.ingest(first, batch="one").collect())) == told
    assert not any(r["kept"] for r in index.ingest(first, batch="three").collect())
    index.drop()


def test_equal_but_for_case_under_one_id(spark):
    docs = spark.createDataFrame([(5, "Same Text here"), (5, "same text here"), (5, "other"), (None, "x"), (None, "X")], "doc_id long, text string")
    assert sorted(norm(r["text"]) for r in drop_exact_copies(docs).collect()) == ["other", "same text here", "x"]


def test_no_table_stays_behind(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    drop_exact_copies(documents).count()
    first_decisions(documents).count()
    assert {t.name for t in spark.catalog.listTables()} == before
