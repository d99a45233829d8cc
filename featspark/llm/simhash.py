"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are cut by Gray rank into blocks of about equal size, however they cluster.
A block's upper node keeps the bits that all its members share; a fingerprint visits the blocks from
whose shared bits it differs by no more than the distance. In a block, nested groups of Gray
neighbours keep their shared bits too, and a search drops a whole group as soon as the differences
that have added up exceed the distance. Each task returns a spanning forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .components import connected_components

#: Rows of bits counted at once, children of a node, pairs held at once.
CHUNK, FAN, PAIRS = 1 << 16, 16, 1 << 21


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is in over half of the XXH64 hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    body = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    begin = (end - size + 1)[:len(words) - shingle + 1].tolist()
    stop = end[shingle - 1:].tolist()
    n = len(begin)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = [xxh64_intdigest(body[a:b], seed) for a, b in zip(begin[i:i + CHUNK], stop[i:i + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def gray_rank(c: Column) -> Column:
    """Place of a 64-bit word in Gray order, as a long that sorts like the unsigned number."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Nested groups of words in Gray order; ``masks`` and ``patterns`` hold, by level from the top,
    the bits that all words below a node share."""

    def __init__(self, masks: np.ndarray, patterns: np.ndarray):
        """From the lowest level: of single words the mask is all ones."""
        self.masks, self.patterns = [masks], [patterns]
        while len(self.masks[0]) > FAN:
            starts = np.arange(0, len(self.masks[0]), FAN)
            anded = np.bitwise_and.reduceat(self.patterns[0] | ~self.masks[0], starts)
            ored = np.bitwise_or.reduceat(self.patterns[0] & self.masks[0], starts)
            shared = np.bitwise_and.reduceat(self.masks[0], starts) & ~(anded ^ ored)
            self.masks.insert(0, shared)
            self.patterns.insert(0, ored & shared)

    @classmethod
    def of_words(cls, words: np.ndarray) -> GrayIndex:
        rank = words.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        order = np.argsort(rank)
        index = cls(np.full(len(words), ~np.uint64(0)), words[order])
        index.order = order
        return index

    def search(self, queries: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's place and a lowest node's place that differ by ``distance`` shared bits at most."""
        step = max(1, PAIRS // FAN // 8)
        for i in range(0, len(queries), step):
            yield from self._down(np.arange(i, min(i + step, len(queries))), None, 0, queries, distance)

    def _down(self, query, node, level, queries, distance):
        if node is None:
            n = len(self.masks[0])
            query, node = np.repeat(query, n), np.tile(np.arange(n), len(query))
        else:
            n = len(self.masks[level])
            query = np.repeat(query, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = node < n
            query, node = query[inside], node[inside]
        apart = np.bitwise_count((queries[query] ^ self.patterns[level][node]) & self.masks[level][node])
        near = apart <= distance
        query, node = query[near], node[near]
        if level == len(self.masks) - 1:
            if len(query):
                yield query, node
            return
        for i in range(0, len(query), PAIRS // FAN):
            yield from self._down(query[i:i + PAIRS // FAN], node[i:i + PAIRS // FAN], level + 1, queries, distance)


class Forest:
    """Disjoint sets over places 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each pair; roots are the smallest places."""
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            up = self.up[r]
            if (up == r).all():
                self.up[x] = r
                return r
            r = up


def _words(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def fingerprint_links(words: DataFrame, distance: int = 2, block: int = 1024, most_blocks: int = 4096, visitors: int = 1 << 17) -> DataFrame:
    """Links a, b (fp values, as long) whose graph has the components of all pairs within ``distance``.

    ``words`` has distinct ``fp``. Blocks hold about ``block`` words, more once there would be more than
    ``most_blocks`` of them, which bounds what is broadcast; a block with more visitors than ``visitors``
    is searched by several tasks.
    """
    spark = words.sparkSession
    n = words.count()
    blocks = max(1, min(most_blocks, -(-n // block)))
    ranked = words.select("fp", gray_rank(F.col("fp")).cast("double").alias("rank"))
    cuts = ranked.agg(F.percentile_approx("rank", [k / blocks for k in range(1, blocks)], 10 * most_blocks)).first()[0] if blocks > 1 else []
    splits = [-float("inf"), *sorted(set(cuts or [])), float("inf")]
    number = Bucketizer(splits=splits, inputCol="rank", outputCol="block").transform(ranked) if len(splits) > 2 else ranked.withColumn("block", F.lit(0))
    placed = materialize(number.select("fp", F.col("block").cast("int").alias("block")), "gray-blocks")
    tops = sorted(placed.groupBy("block").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).collect(), key=lambda r: r["block"])
    numbers = np.array([r["block"] for r in tops], np.int32)
    every, some = (np.array([r[k] for r in tops], np.int64).view(np.uint64) for k in ("all", "any"))
    upper = spark.sparkContext.broadcast((numbers, ~(every ^ some), every & some & ~(every ^ some)))  # most_blocks nodes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, masks, patterns = upper.value
        index = GrayIndex(masks, patterns)
        for batch in batches:
            fp, home = _words(batch.column(0)), batch.column(1).to_numpy()
            for query, node in index.search(fp, distance):
                ahead = ids[node] > home[query]  # the pair is found from its earlier block
                yield pa.RecordBatch.from_arrays([pa.array(ids[node][ahead]), pa.array(fp[query][ahead].view(np.int64))], ["block", "fp"])

    visits = materialize(placed.select("fp", "block").mapInArrow(route, "block int, fp long"), "gray-visits")
    crowded = visits.groupBy("block").count().where(F.col("count") > visitors).select(
        "block", F.ceil(F.col("count") / visitors).cast("int").alias("parts"))  # a row a block at most
    parts = F.coalesce(F.col("parts"), F.lit(1))
    guests = visits.join(F.broadcast(crowded), "block", "left").select(
        "block", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), "fp", F.lit(False).alias("home"))
    hosts = placed.join(F.broadcast(crowded), "block", "left").select(
        "block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "fp", F.lit(True).alias("home"))

    def find(table: pa.Table) -> pa.Table:
        fp, home = _words(table.column("fp").combine_chunks()), table.column("home").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        first = table.column("part")[0].as_py() == 0
        index = GrayIndex.of_words(fp[home])
        queries = fp if first else fp[~home]  # residents among themselves once
        place = np.arange(len(fp)) if first else np.flatnonzero(~home)
        residents = np.flatnonzero(home)[index.order]
        forest = Forest(len(fp))
        for query, node in index.search(queries, distance):
            forest.link(place[query], residents[node])
        root = forest.roots(np.arange(len(fp)))
        linked = root != np.arange(len(fp))
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    return guests.unionByName(hosts).groupBy("block", "part").applyInArrow(find, "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2,
                          shingle: int = 3, seed: int = 42) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id that links reach, itself included).

    Null, empty and wordless texts have fingerprint zero, which links like any other. Rows of equal
    fingerprint are one word of the index, so thousands of copies cost no pairs. Null ids count for
    nothing in component_id; repeated rows give repeated results; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    words = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "words")
    groups = connected_components(fingerprint_links(words, distance))
    labelled = words.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(labelled.join(least, "component").select("fp", "n", "component_id"), "components")
    total = named.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(named.where(F.col("n") * 1000 > total).select("fp", "component_id"))  # under 1000 rows
    rare = named.where(F.col("n") * 1000 <= total).select("fp", "component_id")
    out = rows.join(common, "fp").unionByName(rows.join(common.select("fp"), "fp", "left_anti").join(rare, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
