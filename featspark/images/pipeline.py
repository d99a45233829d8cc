"""Image tables: steps run inside tasks, a few images at a time; profiles; PNG files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import plotdata
from ..sources.tables import read_images
from .steps import Step, like, png_bytes

PIXELS = "path string, shape array<int>, dtype string, data binary, error string"


def to_array(image, grayscale: bool = False) -> np.ndarray:
    """RGB (or gray) array of a struct of Spark's image source: channels turned, alpha dropped."""
    if image is None or image["height"] < 0:
        raise ValueError("the image cannot be decoded")
    a = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    if a.shape[2] == 1:
        return a[..., 0] if grayscale else np.repeat(a, 3, axis=2)
    rgb = np.ascontiguousarray(a[..., 2::-1])
    return like(rgb.astype(float) @ np.array([0.299, 0.587, 0.114]), rgb) if grayscale else rgb


@dataclass(frozen=True)
class ImagePipeline:
    """Steps in order; a pipeline is a step, too."""

    steps: Sequence[Step] = ()

    def __call__(self, image: np.ndarray) -> np.ndarray:
        for step in self.steps:
            image = step(image)
        return image

    def load_many(self, spark: SparkSession, path: str | list[str], grayscale: bool = False) -> DataFrame:
        """path, shape, dtype, data, error for every file; what cannot be read has an error and no data."""
        run = self

        def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for where, image in zip(part["path"], part["image"], strict=True):
                    try:
                        a = run(to_array(image, grayscale))
                        row = (where, list(a.shape), str(a.dtype), a.tobytes(), None)
                    except ValueError as e:
                        row = (where, None, None, None, str(e))
                    yield pd.DataFrame([row], columns=["path", "shape", "dtype", "data", "error"])

        return read_images(spark, path).mapInPandas(work, PIXELS)

    def load_in_order(self, spark: SparkSession, paths: Sequence[str], grayscale: bool = False, chunk: int = 4, ahead: int | None = None) -> Iterator[Row]:
        """Rows of ``load_many`` in the order of ``paths``, of which one may come twice; loaded lazily,
        ``ahead`` chunks at a time (two a task slot), so that is what the driver holds."""
        many = chunk * (ahead or 2 * spark.sparkContext.defaultParallelism)
        for i in range(0, len(paths), many):
            part = list(paths[i:i + many])
            found = {_plain_path(r["path"]): r for r in self.load_many(spark, sorted(set(part)), grayscale).collect()}
            yield from (found[_plain_path(p)] for p in part)

    def load(self, spark: SparkSession, path: str, grayscale: bool = False) -> np.ndarray:
        """One file; missing is a FileNotFoundError, undecodable a ValueError."""
        return self(read_image(spark, path, grayscale))


def _plain_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def from_row(row) -> np.ndarray:
    """The array of a row of ``load_many``."""
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(row["shape"])


def read_image(spark: SparkSession, path: str, grayscale: bool = False) -> np.ndarray:
    """RGB (or gray) array of one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return to_array(read_images(spark, path).first()["image"], grayscale)


def write_images(df: DataFrame, folder: str) -> int:
    """Rows of ``load_many`` as PNG files in ``folder``, named as their source; returns how many.

    Rows without data are left out; two of one name are an error. Each file is written aside and moved into
    place, so a task that runs twice does no harm. Executors reach the folder by ``pyarrow.fs``.
    """
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), "[.][^.]*$", "")
    rows = df.where("data is not null").withColumn("name", F.concat(stem, F.lit(".png")))
    if twice := rows.groupBy("name").count().where("count > 1").limit(1).collect():
        raise ValueError(f"two images of the name {twice[0]['name']!r}")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        for part in parts:
            for row in part.to_dict("records"):
                aside = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as out:
                    out.write(png_bytes(from_row(row)))
                fs.move(aside, f"{base}/{row['name']}")
            yield pd.DataFrame({"n": [len(part)]})

    return rows.mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


SUMMARY = ("path string, readable boolean, error string, width int, height int, aspect double, channels int, dtype string, file_kb double, "
           "brightness double, contrast double")


def summarize_images(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: size, channels, kilobytes, mean and deviation of the gray values; an error if unreadable."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        for part in parts:
            rows = []
            for where, image in zip(part["path"], part["image"], strict=True):
                try:
                    gray = to_array(image, grayscale=True)
                    h, w = gray.shape
                    rows.append((where, True, None, w, h, w / h, image["nChannels"], "uint8", None, float(gray.mean()), float(gray.std())))
                except ValueError as e:
                    rows.append((where, False, str(e), None, None, None, None, None, None, None, None))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({c: "Int32" for c in ("width", "height", "channels")} | {"file_kb": "float64"})

    # pixels are seen once, where they are read; file sizes join the small rows
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    sizes = spark.read.format("binaryFile").load(path).select(plain("path").alias("_at"), (F.col("length") / 1024).alias("_kb")).distinct()
    made = read_images(spark, path).mapInPandas(work, SUMMARY)
    return made.join(sizes, plain("path") == F.col("_at"), "left").withColumn("file_kb", F.col("_kb")).drop("_at", "_kb")


def image_sizes(summary: DataFrame) -> DataFrame:
    """width, height, n of readable images."""
    return summary.where("readable").groupBy("width", "height").agg(F.count("*").alias("n"))


def image_histograms(summary: DataFrame, bins: int = 20) -> DataFrame:
    """feature (aspect, brightness), low, high, n over equal parts of the range of the readable images."""
    made = [plotdata.histogram(summary.where("readable"), f, bins).select(F.lit(f).alias("feature"), "low", "high", "n") for f in ("aspect", "brightness")]
    return made[0].unionByName(made[1])


def image_totals(summary: DataFrame) -> DataFrame:
    """One row: files, unreadable, gray, with alpha."""
    return summary.agg(F.count("*").alias("files"), F.count_if(~F.col("readable")).alias("unreadable"), F.count_if(F.col("channels") == 1).alias("gray"), F.count_if(F.col("channels") == 4).alias("alpha"))
