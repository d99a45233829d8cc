import random

import numpy as np
import xxhash

from featspark.llm.components import connected_components
from featspark.llm.simhash import GrayIndex, fingerprint, fingerprint_links, near_duplicate_groups


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def least_reachable(ids, prints, distance=2):
    prints = np.array(prints, np.uint64)
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance):
            up[max(root(i), root(int(j)))] = min(root(i), root(int(j)))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(ids))]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, f"{p:016x}", c) for r, p, c in zip(rows, prints, least_reachable([r["doc_id"] for r in rows], prints), strict=True))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in near_duplicate_groups(docs).collect())
    assert got == want


def test_fingerprint():
    rng = random.Random(2)
    for text in [None, "", " \n", "a", "a B", "A b\x0bc", "é É ß", *[" ".join(rng.choices(["x", "Y", "zz", "é"], k=n)) for n in (3, 4, 50, 400)]]:
        assert fingerprint(text) == brute_fingerprint(text)


def test_tables(documents, awkward, no_docs):
    for docs in (documents, awkward, no_docs):
        check(docs)


def test_index_finds_every_pair():
    rng = np.random.default_rng(0)
    for n, spread in ((1, 64), (17, 64), (700, 12), (2000, 64)):
        words = np.unique(rng.integers(0, 1 << min(spread, 63), n, dtype=np.uint64) | np.uint64(1 << 63))
        words = np.unique(np.concatenate([words, words[:300] ^ (np.uint64(1) << rng.integers(0, 64, len(words[:300])).astype(np.uint64))]))
        index = GrayIndex.of_words(words)
        got = {(int(a), int(index.order[b])) for q, node in index.search(words, 2) for a, b in zip(q, node, strict=True)}
        apart = np.bitwise_count(words[:, None] ^ words[None, :])
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= 2), strict=True)}


def test_links_across_blocks(spark):
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 1 << 11, 600, dtype=np.uint64) << np.uint64(20)  # a cloud about one word
    spread = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    words = np.unique(np.concatenate([dense, spread, spread[:200] ^ np.uint64(1 << 63 | 1), spread[200:300] ^ np.uint64(3 << 40)]))
    rows = spark.createDataFrame([(int(w),) for w in words.view(np.int64)], "fp long")
    for visitors in (1 << 17, 50):
        links = fingerprint_links(rows, block=40, visitors=visitors)
        named = {r["node"]: r["component"] for r in connected_components(links).collect()}
        places = {int(w): i for i, w in enumerate(words.view(np.int64))}
        want = least_reachable(list(range(len(words))), words)
        ours = [named.get(int(w), int(w)) for w in words.view(np.int64)]
        assert len(set(zip(ours, want, strict=True))) == len(set(ours)) == len(set(want))
        assert all(a["a"] in places and a["b"] in places for a in links.collect())


def test_components(spark):
    rng = random.Random(3)
    for links in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 3)]):
        up = {}
        for a, b in links:
            if a is not None and a != b:
                la, lb = up.get(a, {a}), up.get(b, {b})
                both = la | lb
                for x in both:
                    up[x] = both
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: min(s) for x, s in up.items()}
