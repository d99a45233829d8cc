from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featspark.llm.mixing import Mix, keep_mixed, leaf_budgets, mix_documents, share_out
from featspark.llm.queries import MIX

SMALL = Mix(domains={"src0": "web"}, weights={("web",): 3, ("other",): 1, ("*", "en"): 2}, max_epochs=3)


@given(st.integers(0, 10_000), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3000)), max_size=6))
def test_share_out(budget, children):
    from fractions import Fraction

    weights, room = [Fraction(w) for w, _ in children], [r for _, r in children]
    out = share_out(budget, weights, room)
    usable = sum(r for w, r in children if w)
    assert sum(out) == min(budget, usable) and all(0 <= o <= r for o, r in zip(out, room, strict=True))
    open_ = [(o / float(w)) for o, r, w in zip(out, room, weights, strict=True) if w and o < r]
    assert all(abs(a - b) <= 1 for a in open_ for b in open_)


def test_shortage_goes_to_siblings_first():
    mix = Mix(weights={("a",): 1, ("b",): 1}, domains={})
    totals = {("a", "en", "x"): 10, ("a", "de", "y"): 500, ("b", "en", "z"): 500}
    assert leaf_budgets(totals, 400, mix) == {("a", "en", "x"): 10, ("a", "de", "y"): 190, ("b", "en", "z"): 200}
    totals[("a", "de", "y")] = 100
    assert leaf_budgets(totals, 400, mix) == {("a", "en", "x"): 10, ("a", "de", "y"): 100, ("b", "en", "z"): 290}


def test_zero_weight_below_is_no_room_above():
    totals = {("a", "en", "x"): 100, ("a", "de", "y"): 900, ("b", "en", "z"): 1000}
    mix = Mix(weights={("a", "de"): 0}, domains={})
    assert leaf_budgets(totals, 600, mix) == {("a", "en", "x"): 100, ("a", "de", "y"): 0, ("b", "en", "z"): 500}
    mix = Mix(weights={("a", "de", "y"): 0}, domains={})
    assert leaf_budgets(totals, 600, mix) == {("a", "en", "x"): 100, ("a", "de", "y"): 0, ("b", "en", "z"): 500}
    assert leaf_budgets(totals, 5000, mix) == {("a", "en", "x"): 100, ("a", "de", "y"): 0, ("b", "en", "z"): 1000}


def check(docs, mix, budget=None, share=1.0):
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").collect()
    leaves = defaultdict(list)
    for r in rows:
        n = len((r["text"] or "").encode().split())
        leaves[(mix.domains.get(r["source"], mix.other), r["lang"], r["source"])].append((r["doc_id"], n))
    totals = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = leaf_budgets(totals, int(sum(totals.values()) * share) if budget is None else budget, mix)
    got = defaultdict(list)
    for r in mix_documents(docs, mix, budget, share).collect():
        got[(r["domain"], r["lang"], r["source"])].append(r)
    for leaf, given_ in budgets.items():
        assert sum(r["tokens_taken"] for r in got[leaf]) == given_
        epochs = given_ // totals[leaf] if totals[leaf] else 0
        assert all(epochs <= r["times"] <= epochs + 1 for r in got[leaf])
        assert sum(0 < r["tokens_taken"] - epochs * r["n_tokens"] < r["n_tokens"] for r in got[leaf]) <= 1 or docs.groupBy("doc_id").count().where("count > 1").count()


def test_budgets_are_met_to_the_token(documents, awkward, no_docs):
    check(documents, MIX)
    check(documents, SMALL, share=0.3)
    check(documents, SMALL, budget=0)
    check(awkward, SMALL, share=1.7)
    check(no_docs, SMALL)


def test_prefix_is_in_seeded_order(spark, documents):
    mix = Mix(domains={}, weights={}, max_epochs=1, seed=9)
    docs = documents.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    half = {r["doc_id"]: r["tokens_taken"] for r in mix_documents(docs, mix, share=0.5).collect()}
    order = docs.orderBy(F.xxhash64(F.lit(9), F.lit(0).cast("long"), F.col("doc_id")), "doc_id").select("doc_id", "text").collect()
    left = int(sum(len((r["text"] or "").split()) for r in order) * 0.5)
    want = {}
    for r in order:
        n = len((r["text"] or "").encode().split())
        if left > 0:
            want[r["doc_id"]] = min(n, left)
        left -= n
    assert half == want


def test_kept_documents_are_whole(documents, awkward, no_docs):
    mix = Mix(domains={"src0": "web"}, weights={("web",): 3}, max_epochs=2)
    taken = {r["doc_id"]: r["times"] for r in mix_documents(documents, mix, share=1.3).collect()}
    out = keep_mixed(documents, mix, share=1.3)
    assert out.columns == documents.columns
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == taken
    assert out.select("doc_id", "text").distinct().exceptAll(documents.select("doc_id", "text")).count() == 0
    assert keep_mixed(awkward, SMALL, share=0.5).columns == awkward.columns
    assert keep_mixed(awkward, SMALL, share=0.5).count() > 0 and keep_mixed(no_docs, SMALL).count() == 0
