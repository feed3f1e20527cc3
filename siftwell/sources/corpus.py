"""Corpora from any store and format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Documents as they lie in files: parquet, orc, json, csv, text and what else the session can read."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """index, text: a row a line. Numbers ascend with the file order and are not consecutive."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("index"), F.col("value").alias("text"))


def items(spark: SparkSession, texts: list[str]) -> DataFrame:
    """index, text of a list; anything but strings is refused."""
    if not all(isinstance(t, str) for t in texts):
        raise TypeError("items are strings")
    return spark.createDataFrame(list(enumerate(texts)), "index bigint, text string")
