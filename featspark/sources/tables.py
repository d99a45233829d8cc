"""Readers and writers: CSV with declared or inferred columns, Parquet, image folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, times: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV with a header. ``times`` maps text columns to the pattern of their zoneless timestamps;
    what does not parse is null. Without a schema types are inferred by an extra pass."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).option("preferDate", True).csv(path)
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(p)).cast("timestamp_ntz") for c, p in (times or {}).items()})


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, pruned to ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet folder, in partitions ``by``."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, image (the struct of Spark's image source), a row a file; undecodable files have height -1."""
    df = spark.read.format("image").option("dropInvalid", False).load(path)
    return df.select(F.col("image.origin").alias("path"), "image")


def date_range(spark: SparkSession, start: str, stop: str, step: str) -> DataFrame:
    """ts from ``start`` to ``stop`` by an interval such as ``1 hour``."""
    return spark.sql(f"SELECT explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{stop}', interval {step})) AS ts")
