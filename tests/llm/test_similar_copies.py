import random

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from featspark.llm import similar_copies
from featspark.llm.similar_copies import drop_near_copies, sharing_rows, shingle_tokens

SHINGLE = 5


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def brute(rows):
    """Kept (doc_id, text) pairs: the smallest id of each group of similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, (doc, text) in enumerate(rows):
        key = (doc is None, doc or 0)
        if root(i) not in best or key < best[root(i)][0]:
            best[root(i)] = key, shingles(text)
    return sorted(k for k, _ in best.values()), best


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, _ = brute(rows)
    out = drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == want


def test_tables(documents, awkward, no_docs):
    for docs in (documents, awkward, no_docs):
        check(docs)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_every_pair_of_edited_texts(spark):
    rng = random.Random(4)
    footer = " ".join(f"legal{i}" for i in range(25))
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(4, 260))]
        rows += [" ".join(base) + " " + footer * rng.randrange(2)] + [edited(rng, base, rng.randrange(1, 9)) for _ in range(4)]
    rows += [edited(rng, ["same"] * 3 + [f"x{i}" for i in range(200)], rng.randrange(0, 3)) for _ in range(60)]  # a large group
    rng.shuffle(rows)
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def test_pipeline_stage_drops_copies_beyond_two_bits(spark):
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "other", *words[61:]]  # 111 of 121 shingles, similarity 0.92
    far = [*words[:20], "a", *words[21:50], "b", *words[51:80], "c", *words[81:]]  # under 0.8
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_rows_count_by_themselves(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text), (2, "a clean text of its own"), (None, text), (None, "another clean text of its own"), (None, "another clean text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in drop_near_copies(docs).collect())
    assert got == sorted([(1, text), (2, "a clean text of its own"), (-1, "another clean text of its own")])


def test_hashes_stand_for_shingles(monkeypatch):
    rng = random.Random(9)
    texts = [None, "", " a", "b c d e f g", "é É x  y", "A B C D E F G", "z" * 200, "a b c d e", "a\tb\x0bc\nd\re", "\x1c a", *[" ".join(rng.choice("abc") + str(rng.randrange(9)) for _ in range(rng.randrange(60))) for _ in range(60)]]
    for chunk in (1 << 21, 50):
        monkeypatch.setattr(similar_copies, "CHUNK_BYTES", chunk)
        for column, rows in ((pa.array(texts), texts), (pa.array(texts).slice(3, 20), texts[3:23])):
            got, names = {}, {}
            for first, _, owner, token in shingle_tokens(column, SHINGLE):
                for i, t in zip(owner.tolist(), token.tolist(), strict=True):
                    got.setdefault(first + i, set()).add(t)
            for i, text in enumerate(rows):
                assert len(got[i]) == len(shingles(text))
                names.setdefault(frozenset(shingles(text)), got[i])
                assert names[frozenset(shingles(text))] == got[i]


def test_texts_that_share_enough_are_all_found(spark, documents, awkward, no_docs):
    for docs in (documents, awkward):
        rows = docs.select(F.monotonically_increasing_id().alias("row"), "text")
        rows = spark.createDataFrame(rows.collect(), "row long, text string")
        sets = {r["row"]: shingles(r["text"]) for r in rows.collect()}
        times = {}
        for have in sets.values():
            for x in have:
                times[x] = times.get(x, 0) + 1
        want = {r for r, have in sets.items() if 5 * sum(times[x] > 1 for x in have) >= 4 * len(have)}
        assert {r["row"] for r in sharing_rows(rows, SHINGLE, 0.8).collect()} == want
    assert sharing_rows(no_docs.select(F.lit(0).cast("long").alias("row"), "text"), SHINGLE, 0.8).count() == 0


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(0, 6))) for i in range(300)]
    pairs, plain = [], similar_copies._confirmed
    monkeypatch.setattr(similar_copies, "_confirmed", lambda some, *rest: pairs.append(some.count()) or plain(some, *rest))
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(pairs) < 300 * 60
