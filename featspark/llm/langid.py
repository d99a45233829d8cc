"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from a bounded sample of labelled rows. A
text is reduced to lower-case letters and single spaces, cut into blocks so that the dictionary
counts in every part of a long text, and compressed with each dictionary; the language with the
fewest bytes wins. The margin is the share by which it beats the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, materialize

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language; the parameters used to compress with them."""

    dictionaries: dict[str, bytes]
    level: int = 5
    block: int = 1024


def normalize(text: str) -> str:
    """Lower-case letters, single spaces for everything else."""
    return NOT_LETTERS.sub(" ", text).strip().lower()


def fit_language_id(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                    dict_bytes: int = 110_000, sample_docs: int = 200, doc_chars: int = 2000) -> LanguageModel:
    """Learn dictionaries. The sample is bounded by parameters: about ``sample_docs`` rows a language
    (those of the lowest hash of the id, or of the text where the id is null; twice as many at most),
    ``doc_chars`` characters of each, ``dict_bytes`` in all. Rows repeated with one id and text count
    once; ids tell documents apart; rows with null or letterless text or null language teach nothing; no rows give an empty model."""
    drawn_by = F.coalesce(F.col(id_col).cast("string"), F.col(text_col))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           (F.pmod(F.xxhash64(drawn_by), F.lit(1 << 30)) / float(1 << 30)).alias("draw"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel({})
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    taken = (rows.where(F.col("draw") <= F.element_at(share, F.col("lang")))
             .select("lang", "draw", F.substring("text", 1, doc_chars).alias("text")).distinct()
             .withColumn("place", first).where(F.col("place") <= 2 * sample_docs).collect())
    by: dict[str, list[bytes]] = {}
    for r in sorted(taken, key=lambda r: (r["lang"], r["draw"], r["text"])):
        if text := normalize(r["text"]):
            by.setdefault(r["lang"], []).append(text.encode())
    return LanguageModel({lang: b" ".join(texts)[:dict_bytes] for lang, texts in by.items()})


def classifier(model: LanguageModel):
    """The function from text to (language, margin)."""
    return _classifier(*_plain(model))


def _plain(model: LanguageModel) -> tuple[dict[str, bytes], int, int]:
    """The model in built-in types: a broadcast is unpickled by executors that may lack this package."""
    return dict(model.dictionaries), model.level, model.block


def _classifier(dictionaries: dict[str, bytes], level: int, block: int):
    import zstandard

    coders = []
    for lang, data in sorted(dictionaries.items()):
        params = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=block, dict_size=len(data), min_match=3,
            write_checksum=False, write_content_size=False, write_dict_id=False)
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=params)
        coders.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress))

    def classify(text: str | None) -> tuple[str, float]:
        if not text or not coders:
            return UNKNOWN, 0.0
        letters = normalize(text)
        if not letters or not (letters[0].isalpha() or any(map(str.isalpha, letters))):
            return UNKNOWN, 0.0
        data = letters.encode()
        blocks = [data[i:i + block] for i in range(0, len(data), block)]
        sizes = sorted((sum(len(pack(b)) for b in blocks), lang) for lang, pack in coders)
        return sizes[0][1], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]

    return classify


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
                     min_margin: float = 0.002) -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang_pred, score (the margin, 0 to 1), rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is everything if
    the model is empty. A margin under ``min_margin`` rejects, the prediction stays. Equal sizes go to
    the first language in order. Whole texts are read, whatever their length; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))  # bounded: dict_bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(*shared.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin))


def keep_identified(docs: DataFrame, model: LanguageModel, min_margin: float = 0.002) -> DataFrame:
    """The rows whose language is accepted, with their columns as they are, whatever these are called.

    Rows of null, empty or letterless text go, and all rows if the model is empty; null ids and repeated
    rows are rows like any other; an empty table gives an empty one. The rows are written here, in the small
    batches of ``materialize``: whoever wrote them later would send up to 10,000 whole texts to Python at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))  # bounded: dict_bytes a language
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(*shared.value)
        for batch in batches:
            found = (classify(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_margin for lang, score in found], pa.bool_()))
        give_back()

    return materialize(docs.mapInArrow(run, docs.schema), "identified")


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
