"""CRC32 of texts, of rows and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc32(value: Column) -> Column:
    """The unsigned CRC32 of a text's UTF-8 bytes or of a binary value; null stays null."""
    return F.crc32(value.cast("binary"))


def row_crc32(df: DataFrame) -> Column:
    """The CRC32 of a row as JSON, its columns in the order of their names; nulls are left out of the JSON."""
    return crc32(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))))


def table_sum(df: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of their CRC32s: the same in whatever order or partitions the rows lie. One pass."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_crc32(df)), F.lit(0)).alias("sum")).first()
    return row["n"], row["sum"]
