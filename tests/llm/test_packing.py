import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featspark.llm.packing import Limits, pack_counts, pack_documents

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs, limits=Limits()):
    got = pack_documents(docs, limits).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = SLOW.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= limits.tokens else len(ids) % limits.tokens or limits.tokens
        cuts = [0, *range(first, len(ids) + 1, limits.tokens)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(held) <= limits.documents and sum(n * n for _, n in held) <= limits.cost
    return len(bins), sum(k[3] * c for k, c in want.items())


def test_tables(documents, awkward, no_docs):
    bins, tokens = check(documents)
    assert bins <= math.ceil(tokens / 1024) * 1.02 + 1
    check(awkward)
    check(awkward, Limits(tokens=64, documents=3, cost=64 * 64))
    assert check(no_docs) == (0, 0)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_counts_are_used_up_within_limits(rule):
    rng = random.Random(6)
    for _ in range(20):
        limits = Limits(100, rng.choice([3, 100]), rng.choice([5000, 10_000]), rule=rule)
        top = math.isqrt(limits.cost)
        counts = {n: rng.randrange(0, 300) for n in rng.sample(range(1, min(top, 100) + 1), 20)}
        patterns = pack_counts(counts, limits)
        used = Counter()
        for many, lengths in patterns:
            assert many > 0 and sum(lengths) <= 100 and len(lengths) <= limits.documents and sum(n * n for n in lengths) <= limits.cost
            for n in lengths:
                used[n] += many
        assert used == Counter({n: c for n, c in counts.items() if c})
        assert len(patterns) <= 3 * len(counts)


def test_equals_best_fit_one_by_one():
    rng = random.Random(7)
    sizes = sorted((rng.randrange(1, 1025) for _ in range(800)), reverse=True)
    bins = []
    for s in sizes:
        fit = [b for b in bins if b >= s]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - s)
        else:
            bins.append(1024 - s)
    patterns = pack_counts(Counter(sizes), Limits(weights=(1.0, 0.0, 0.0)))
    assert sorted(1024 - sum(lengths) for many, lengths in patterns for _ in range(many)) == sorted(bins)


def test_over_the_limits():
    with pytest.raises(ValueError, match="over the limits"):
        pack_counts({11: 1}, Limits(10))
