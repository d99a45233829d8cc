"""Near copies by Jaccard similarity of word shingles, every pair found.

A text can only have a near copy if most of its shingles stand in other texts too, so first every text
learns how many of its shingles it shares: shingle hashes are dealt to buckets in packed blobs, a blob a
batch of texts and bucket, and the buckets answer with the texts whose shingles come from two batches.
Few texts are left. Those get SimHash fingerprints, and the Gray-order index links the nearest of them,
which joins the closest of a group without its pairs. Links beyond the index's reach come from a prefix
filter: shingles get one order, rare ones first, and texts whose similarity reaches the bound share one
of the first of both. Of the texts with such a shingle some are held against the others, and only those
that are in different groups after that make pairs. A pair counts once the shingles themselves, not
their hashes, reach the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, give_back, materialize, unused
from .components import connected_components
from .simhash import fingerprint_links, fingerprints

#: Shingles that a bucket holds about, up to four million buckets, and bytes of text in a run of texts.
BUCKET_TOKENS, CHUNK_BYTES = 1 << 21, 1 << 21
#: Bytes of text hashed at once: each takes some 27 bytes of memory meanwhile.
HASH_BYTES = 1 << 18
#: Rounds that hold the rows of a shingle against some of them, and these in a round, before rows of different groups make pairs.
STAR_ROUNDS, HEADS = 2, 8
#: Bits of a text's parities: each shingle that one of two texts lacks turns one of them.
BITS = 512
#: Most rows of a broadcast table.
BROADCAST_ROWS = 1 << 20
#: In place of a text's number in a blob: its batch holds the shingle in several texts.
SEVERAL = 0xFFFF
_FACTOR, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def shingle_set(text: str | None, shingle: int = 5) -> set[tuple]:
    """The text's word shingles; a shorter text is one shingle, a wordless one the empty shingle."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return (np.r_[0, cuts], np.r_[cuts, len(x)]) if len(x) else (cuts, cuts)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts that begin at ``starts`` in the bytes ``data``."""
    gap = (data == 32) | (data - np.uint8(9) <= 4)
    first = ~gap
    first[1:] &= gap[:-1]
    at = starts[starts < len(data)]
    first[at] = ~gap[at]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = ~gap
    last[:-1] &= gap[1:] | first[1:]
    end = np.flatnonzero(last)
    hashes = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + min(CHUNK_BYTES, HASH_BYTES))))
        base = int(begin[i])
        part = data[base:int(end[j - 1]) + 1]
        part = part + ((part - np.uint8(65) < 26).astype(np.uint8) << 5)
        sums = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, len(part)), dtype=np.uint64)
        b, e = begin[i:j] - base, end[i:j] - base
        inside = sums[e] - np.where(b > 0, sums[b - 1], np.uint64(0))
        hashes[i:j] = _mix(inside * _powers(_INVERSE, len(part))[b] + (e - b).astype(np.uint64))
        i = j
    return hashes, np.searchsorted(starts, begin, side="right") - 1


def shingle_tokens(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, how many, and (text within the run, hash) of each word shingle.
    A text of fewer words has one, and so has one without words."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        hashes, text = _word_hashes(data[offsets[i]:offsets[j]], offsets[i:j] - offsets[i])
        words = np.bincount(text, minlength=j - i)
        place = np.concatenate([[0], np.cumsum(words)])
        tokens, owner = [np.zeros(int((words == 0).sum()), np.uint64)], [np.flatnonzero(words == 0)]
        for size in range(1, shingle + 1):
            if size < shingle:
                begin = place[:-1][words == size]
            else:
                begin = np.flatnonzero(text[:max(0, len(text) - size + 1)] == text[size - 1:]) if len(text) >= size else np.zeros(0, np.int64)
            out = np.full(len(begin), size, np.uint64)
            for k in range(size):
                out = out * np.uint64(_STEP) + hashes[begin + k]
            tokens.append(_mix(out))
            owner.append(text[begin])
        yield i, j - i, np.concatenate(owner), np.concatenate(tokens)
        i = j


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _least_shared(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles, of ``n``, that a text of the similarity must have in common; long texts are let off the
    few whose hashes may be equal."""
    return np.ceil(similarity * n - 1e-9) - (n >> 12)


def sharing_rows(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``row`` of every text that shares enough of its shingles with other texts to have a near copy."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(22, max(8, int(chars // 6 // BUCKET_TOKENS).bit_length()))
    schema = "bucket int, batch long, tokens binary, places binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for base, many, owner, token in shingle_tokens(batch.column(1), shingle):
                for at in range(0, many, SEVERAL):
                    inside = (owner >= at) & (owner < at + SEVERAL)
                    yield from pack(ids[base + at:base + min(many, at + SEVERAL)], owner[inside] - at, token[inside])
        give_back()

    def pack(ids: np.ndarray, owner: np.ndarray, token: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = np.unique((token >> np.uint64(16) << np.uint64(16)) | owner.astype(np.uint64))
        owner, token = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
        new = np.r_[True, token[1:] != token[:-1]]
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        n, here = np.bincount(owner, minlength=len(ids)), np.bincount(owner[several], minlength=len(ids))
        place = np.where(several, SEVERAL, owner).astype(np.uint16)[new]
        token = token[new]
        bucket = (token >> np.uint64(48 - bits)).astype(np.int64)
        rest = (token >> np.uint64(max(0, 16 - bits))).astype(np.uint32)
        name = int(ids[0])  # rows are unique, so the first one names the batch
        cuts, ends = _runs(bucket)
        info = np.stack([ids, n, here], 1).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array([-1, *bucket[cuts].tolist()], pa.int32()), pa.array([name] * (len(cuts) + 1), pa.int64()),
            pa.array([info, *(rest[a:b].tobytes() for a, b in zip(cuts, ends, strict=True))], pa.binary()),
            pa.array([b"", *(place[a:b].tobytes() for a, b in zip(cuts, ends, strict=True))], pa.binary())], ["bucket", "batch", "tokens", "places"])

    def meet(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table([table.column("batch"), table.column("tokens"), pa.array([True] * len(table))], ["batch", "tokens", "info"])
        names = table.column("batch").to_numpy()
        parts = table.column("tokens").to_pylist()
        token = np.frombuffer(b"".join(parts), np.uint32)
        place = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint16)
        source = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) // 4 for p in parts])
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        same[:-1] |= same[1:]
        hit = order[same]
        hit = hit[place[hit] != SEVERAL]
        source, place = source[hit], place[hit]
        by = np.argsort(source, kind="stable")
        source, place = source[by], place[by]
        cuts, ends = _runs(source)
        found = [place[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        return pa.table([pa.array(names[source[cuts]], pa.int64()), pa.array(found, pa.binary()), pa.array([False] * len(found), pa.bool_())], ["batch", "tokens", "info"])

    def count(table: pa.Table) -> pa.Table:
        blobs = table.column("tokens").to_pylist()
        marks = table.column("info").to_pylist()
        ids, n, shared = np.frombuffer(blobs[marks.index(True)], np.int64).reshape(-1, 3).T
        for blob, mark in zip(blobs, marks, strict=True):
            if not mark:
                shared = shared + np.bincount(np.frombuffer(blob, np.uint16), minlength=len(ids))
        return pa.table([pa.array(ids[shared >= _least_shared(n, similarity)])], ["row"])

    own = F.when(F.col("bucket") < 0, F.col("batch")).otherwise(0)  # what a batch holds passes through by itself
    answers = rows.select("row", "text").mapInArrow(deal, schema).groupBy("bucket", own.alias("own")).applyInArrow(
        meet, "batch long, tokens binary, info boolean")
    return answers.groupBy("batch").applyInArrow(count, "row long")


def _firsts(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row, n (shingles), place, token, bits: the first shingles of each text that other texts have, too, and
    the parity of all its shingles by ``BITS`` parts of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for base, many, owner, token in shingle_tokens(batch.column(1), shingle):
                order = np.lexsort((token, owner))
                owner, token = owner[order], token[order]
                new = np.r_[True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])]
                owner, token = owner[new], token[new]
                n = np.bincount(owner, minlength=many)
                odd = np.bincount(owner * BITS + (token % np.uint64(BITS)).astype(np.int64), minlength=many * BITS).reshape(many, BITS) & 1
                some = ids[base:base + many]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n.astype(np.int32)), pa.nulls(many, pa.int64()),
                                                  pa.array([x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)], pa.binary())], ["row", "n", "token", "bits"])
                yield pa.RecordBatch.from_arrays([pa.array(some[owner]), pa.array(n[owner].astype(np.int32)), pa.array(token.view(np.int64)),
                                                  pa.nulls(len(token), pa.binary())], ["row", "n", "token", "bits"])
        give_back()

    both = materialize(texts.select("row", "text").mapInArrow(run, "row long, n int, token long, bits binary"), "tokens")
    tokens, bits = both.where("token is not null").select("row", "n", "token"), both.where("token is null").select("row", "bits")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = tokens.join(often, "token").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("listed"))
    alone = F.col("n") - F.size("listed")  # these come first
    wanted = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - alone
    firsts = listed.where(wanted > 0).select("row", "n", alone.alias("alone"), F.posexplode(F.slice("listed", F.lit(1), wanted.cast("int"))).alias("k", "first")).select(
        "row", "n", (F.col("alone") + F.col("k")).cast("int").alias("place"), F.col("first.token").alias("token"))
    return firsts.join(bits, "row")


def _in_groups(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """``firsts`` with the group of each row by the links so far."""
    grouped = materialize(connected_components(links), "groups-so-far")
    return firsts.join(_small(grouped.withColumnRenamed("node", "row")), "row", "left").withColumn("group", F.coalesce("component", "row")).drop("component")


def _may_reach(similarity: float, n, place, other_n, other_place) -> Column:
    """Whether the sizes of two texts, and the places of a shingle they share first, allow the similarity."""
    return (F.least(n, other_n) >= similarity * F.greatest(n, other_n) - 1e-9) & (
        F.least(n - place, other_n - other_place) >= similarity / (1 + similarity) * (n + other_n) - 1e-9)


def _stars(spread: DataFrame, seed: int, similarity: float) -> DataFrame:
    """Pairs a, b of rows of different groups: of the rows that share a first shingle, ``HEADS`` with each
    other. They are the rows of the lowest hashes, so shingles of one group mostly have the same ones, and
    a large group is joined without its pairs."""
    def first(k: int) -> Column:
        return F.min(F.struct(F.xxhash64(F.lit(seed * HEADS + k), "row").alias("draw"), F.struct("row", "n", "place", "group").alias("head")))["head"]

    heads = spread.groupBy("token").agg(F.array_distinct(F.array(*map(first, range(HEADS)))).alias("heads"), (F.min("group") != F.max("group")).alias("mixed")).where("mixed")
    met = spread.join(heads.select("token", "heads"), "token").select("*", F.explode("heads").alias("head")).where(
        (F.col("group") != F.col("head.group")) & _may_reach(similarity, F.col("n"), F.col("place"), F.col("head.n"), F.col("head.place")))
    return met.select(F.least("row", "head.row").alias("a"), F.greatest("row", "head.row").alias("b")).distinct()


def _meetings(similarity: float):
    """Pairs of rows of different groups that share a shingle and whose sizes, places and parities allow the similarity."""
    overlap = similarity / (1 + similarity)

    def pairs(token, n, place, group, row, bits):
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        mixed = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        rows = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[starts, len(token)])))
        token, n, place, group, row, bits = (c[rows] for c in (token, n, place, group, row, bits))
        left, d = np.arange(len(token)), 0
        while True:
            d += 1
            left = left[left + d < len(token)]
            right = left + d
            left = left[(token[left] == token[right]) & (n[left] >= similarity * n[right] - 1e-9)]
            if not len(left):
                return
            right = left + d
            most = np.minimum(n[left] - place[left], n[right] - place[right])
            meet = (group[left] != group[right]) & (most >= overlap * (n[left] + n[right]) - 1e-9)
            x, y = left[meet], right[meet]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)  # shingles in one of the two, at least
            near = n[x] + n[y] - apart >= 2 * overlap * (n[x] + n[y]) - 1e-9
            if near.any():
                a, b = row[x[near]], row[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(c.to_numpy() for c in batch.columns[:-1]), np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64)]
            if held and held[-1][0][-1] == now[0][0] == now[0][-1]:
                held.append(now)
                continue
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
            if held or cut:
                yield from pairs(*(np.concatenate(c) for c in zip(*held, [c[:cut] for c in now], strict=True)))
            held = [[c[cut:] for c in now]]
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
        give_back()

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs a, b of rows whose shingles reach the similarity."""
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle)
                shared = len(one & other)
                near.append(shared >= similarity * (len(one) + len(other) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))
        give_back()

    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")


def similar_groups(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """row and component (its smallest row) of every row that links reach; ``rows`` has unique longs
    ``row`` and ``text``, and must give the same rows each time it is read."""
    some = materialize(sharing_rows(rows, shingle, similarity), "sharing-rows")
    body = F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    texts = materialize(rows.join(_small(some), "row").select("row", "text", F.sha2(body, 256).alias("digest")), "sharing-texts")
    firsts = texts.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    equal = materialize(texts.select("row", "digest").join(_small(firsts), "digest").where("row <> first").select(
        F.col("first").alias("a"), F.col("row").alias("b")), "equal-texts")
    once = texts.join(_small(equal.select(F.col("b").alias("row"))), "row", "left_anti").select("row", "text")

    prints = materialize(fingerprints(once, "row", "text", shingle).select(F.col("doc_id").alias("row"), "fp"), "fingerprints")
    named = materialize(prints.groupBy("fp").agg(F.min("row").alias("first")), "words")
    forest = fingerprint_links(named, distance).join(named.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        named.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    alike = prints.join(named, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    links = _confirmed(materialize(forest.union(alike).distinct(), "near-prints"), once, shingle, similarity)

    firsts = materialize(_firsts(once, shingle, similarity), "first-shingles")
    spread = _in_groups(firsts, links)
    for seed in range(STAR_ROUNDS):
        links = links.union(_confirmed(materialize(_stars(spread, seed, similarity), "stars"), once, shingle, similarity))
        spread = _in_groups(firsts, links)
    spread = spread.select("token", "n", "place", "group", "row", "bits").repartition("token").sortWithinPartitions("token", "n")
    met = materialize(spread.mapInArrow(_meetings(similarity), "a long, b long").distinct(), "meetings")
    links = links.union(_confirmed(met, once, shingle, similarity)).union(equal)
    return materialize(connected_components(links), "similar-groups").select(F.col("node").alias("row"), "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
                     distance: int = 3) -> DataFrame:
    """One row of each group, with all columns: that of the smallest id (null ids lose to any other).

    Rows are linked if the Jaccard similarity of their sets of ``shingle`` words (A-Z in lower case) is
    ``similarity`` or more, and groups are what links reach. ``distance`` is that of the fingerprints
    searched first; it changes the work, not the result. Null and wordless texts are equal. Rows count by
    themselves: an id may repeat or be null. An empty table gives an empty one.
    """
    row, = unused(docs, "row")
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = kept.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = similar_groups(rows, shingle, similarity, distance)
    own = rows.select("row", "doc_id").join(_small(groups), "row").select(
        "row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"), "component")
    best = own.groupBy("component").agg(F.min("key").alias("best"))
    gone = own.join(_small(materialize(best, "kept-rows")), "component").where(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    return kept.join(_small(materialize(gone, "similar-copies")), row, "left_anti").drop(row)
